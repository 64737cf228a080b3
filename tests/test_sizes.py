"""Uploads from chunks without bytes: any order, repeats, overlaps, restarts, batches that are replayed, and growth."""

import glob
import os
import random

from folioforge.streaming import states

SCHEMA = "upload_id string, offset long, size int"


def put(spark, tmp_path, rows, files=1):
    for k in range(files):
        spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def run(spark, tmp_path, files=2):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    states.replay_sizes(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    return sorted((str(r.upload_id), r.offset, r.size, r.received) for r in rows)


def followed(rows):
    """Offsets of an upload that follow each other from 0; no two chunks begin at one place with different sizes."""
    out = []
    for u in {r[0] for r in rows}:
        sizes, at = {o: n for v, o, n in rows if v == u and n and n > 0}, 0
        while at in sizes:
            out.append((str(u), at, sizes[at], at + sizes[at]))
            at += sizes[at]
    return sorted(out)


def test_sizes_in_any_order(spark, tmp_path):
    rnd, rows = random.Random(3), []
    for u in range(25):
        at = 0
        for _ in range(rnd.randrange(1, 12)):
            size = rnd.randrange(1, 9)
            rows += [(f"u{u}", at, size)] * rnd.choice((1, 1, 2))
            at += size + (rnd.random() < 0.05)
    rows += [("over", 0, 10), ("over", 5, 10), ("over", 10, 5), ("over", 15, 1), ("zero", 0, 0), ("zero", 0, 2), ("less", -4, 4), ("none", None, 3), ("none", 0, None), (None, 0, 3), (None, 3, 1)]
    rnd.shuffle(rows)
    put(spark, tmp_path, rows[:70], 3)
    first = run(spark, tmp_path)
    put(spark, tmp_path, rows[70:], 3)
    got = run(spark, tmp_path)
    assert set(first) < set(got) and got == followed(rows)  # a restart goes on, and a piece comes out once
    assert sorted(os.listdir(f"{tmp_path}/state/uploads")) == ["batch=2", "batch=3"]


def test_a_batch_that_is_replayed_replaces_what_it_wrote(spark, tmp_path):
    put(spark, tmp_path, [("a", 5, 5), ("b", 0, 1)])
    run(spark, tmp_path, 1)
    put(spark, tmp_path, [("a", 0, 5), ("c", 1, 1)])
    before = run(spark, tmp_path, 1)
    for name in (f"{tmp_path}/state/commits/1", *glob.glob(f"{tmp_path}/state/commits/.1.crc")):
        os.remove(name)
    assert run(spark, tmp_path, 1) == before == [("a", 0, 5, 5), ("a", 5, 5, 10), ("b", 0, 1, 1)]


def test_what_waits_is_kept_before_what_comes(spark, tmp_path):
    for row in (("a", 2, 3), ("a", 2, 7), ("a", 0, 2)):
        put(spark, tmp_path, [row])
        got = run(spark, tmp_path)
    assert got == [("a", 0, 2, 2), ("a", 2, 3, 5)]


def test_upload_stream_needs_no_python_worker(spark, monkeypatch):
    from folioforge.plans import streamed  # noqa: F401
    from folioforge.plans.catalogue import QUERIES
    from tests.oracle import same

    def refused(*_):
        raise AssertionError("a key costs a round trip to Python")

    monkeypatch.setattr(states, "uploads", refused)
    same(spark, *QUERIES["upload_stream"])
