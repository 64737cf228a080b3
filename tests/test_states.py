"""Stateful streams: order, expiry, restarts, chunks in any order."""

import datetime as dt
import random
import zlib

from pyspark.sql import Row

from folioforge.streaming import states

EVENT = "id string, seq long, event string, ts timestamp"


def run(spark, tmp_path, instalments, keep=dt.timedelta(minutes=5)):
    start = dt.datetime(2024, 1, 1)
    for rows in instalments:
        made = [(i, s, e, start + dt.timedelta(minutes=m)) for i, s, e, m in rows]
        spark.createDataFrame(made, EVENT).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        query = states.replay(states.item_states(stream, keep, "1 minute"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    return [(r.id, r.seq, r.status, r.attempts) for r in got], query


def test_items_go_on_after_a_restart_and_are_forgotten(spark, tmp_path):
    first = [("a", 2, "start", 1), ("a", 1, "enqueue", 1), ("b", 3, "enqueue", 1), ("a", 4, "finish", 2), ("a", 5, "enqueue", 3)]
    second = [("b", 6, "start", 30), ("a", 7, "enqueue", 31), ("b", 8, "error", 31), ("c", 9, "finish", 32)]
    got, _ = run(spark, tmp_path, [first, second])
    assert got == [
        ("a", 1, "queued", 0), ("a", 2, "running", 1), ("b", 3, "queued", 0), ("a", 4, "done", 1), ("a", 5, "done", 1),
        ("b", 6, "running", 1), ("a", 7, "queued", 0), ("b", 8, "queued", 1), ("c", 9, "new", 0),
    ]


def test_errors_fail_after_three_attempts(spark, tmp_path):
    tries = [("a", 10 * i + j, e, i) for i in range(4) for j, e in enumerate(("enqueue", "start", "error"))]
    got, _ = run(spark, tmp_path, [tries])
    assert [s for _, _, s, _ in got] == ["queued", "running", "queued", "queued", "running", "queued", "queued", "running", "failed", "queued", "running", "failed"]
    assert got[-1] == ("a", 32, "failed", 4)


def test_ended_items_leave_the_state(spark, tmp_path):
    ended = [(f"k{i}", 10 * i + j, e, j) for i in range(20) for j, e in enumerate(("enqueue", "start", "finish"))]
    _, query = run(spark, tmp_path, [ended, [("z", 1000, "enqueue", 600)], [("z", 1001, "start", 601)]])
    rows = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "item").load()
    assert [r.key.id for r in rows.collect()] == ["z"]


def test_uploads_in_any_order(spark, tmp_path):
    rnd, rows, whole = random.Random(2), [], {}
    for u in range(12):
        pieces = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 12))]
        whole[u], at = b"".join(pieces), 0
        for p in pieces:
            rows += [(u, at, len(p), bytearray(p))] * rnd.choice((1, 1, 2))
            at += len(p)
    rows = [r for r in rows if not (r[0] == 5 and r[1] == 0)] + [(5, 1, 3, bytearray(b"xyz"))]  # its first piece never comes
    rnd.shuffle(rows)
    schema = "upload_id int, offset long, size long, data binary"
    for lo in range(0, len(rows), 40):
        spark.createDataFrame(rows[lo : lo + 40], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    states.replay(states.uploads(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("upload_id", "offset").collect():
        data = got.get(r.upload_id, b"")
        assert r.offset == len(data)
        got[r.upload_id] = data + bytes(r.data)
        assert (r.received, r.crc32) == (len(got[r.upload_id]), zlib.crc32(got[r.upload_id]))
    assert got == {u: w for u, w in whole.items() if u != 5}


def test_an_upload_costs_one_read_and_one_write():
    calls, value, held = [], [], {}

    class Store:
        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "exists":
                    return bool(value)
                if name == "get":
                    return value[0] if value else None
                if name == "update":
                    value[:] = args
                if name == "updateValue":
                    held[args[0]] = args[1]
                return held.get(args[0]) if name == "getValue" else name == "containsKey" and args[0] in held

            return call

    class Handle:
        getValueState = getMapState = lambda self, *args: Store()

    upload = states.Uploads()
    upload.init(Handle())
    came = []
    for batch in ([(10, 5), (5, 5)], [(0, 5), (10, 5), (20, 5)]):
        rows = [Row(offset=at, size=size) for at, size in batch]
        came += [(r.offset, r.received) for r in upload.handleInputRows(("u",), iter(rows), None)]
    assert came == [(0, 5), (5, 10), (10, 15)]
    assert calls == ["get", "update"] * 2


def test_an_item_costs_one_read_and_one_write():
    calls, value = [], []

    class Store:
        def get(self):
            calls.append("get")
            return value[0] if value else None

        def update(self, state):
            calls.append("update")
            value[:] = [state]

    class Handle:
        getValueState = lambda self, *args: Store()
        registerTimer = lambda self, at: calls.append(("timer", at))

    item = states.QueueItems(dt.timedelta(seconds=1))
    item.init(Handle())
    came = []
    for batch in ([(2, 5, "start"), (1, 6, "enqueue"), (2, 4, "view")], [(3, 7, "finish")]):
        rows = [Row(seq=seq, event=event, ms=ms) for ms, seq, event in batch]
        came += [(r.seq, r.status, r.attempts) for r in item.handleInputRows(("k",), iter(rows), None)]
    assert came == [(6, "queued", 0), (4, "queued", 0), (5, "running", 1), (7, "done", 1)]
    assert calls == ["get", "update", "get", "update", ("timer", 1004)]
