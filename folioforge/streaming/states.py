"""Arbitrary state of keys over streams: queue items with expiry, and uploads put together from chunks.

State is kept in RocksDB under the checkpoint, a value and a map per key; a restart goes on where the last committed
batch ended.  A task holds the rows that one key has in one batch.  A call to the store costs a round trip to Python, so
uploads whose chunks come without their bytes are put together by a table of state a batch instead (``replay_sizes``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

MAX_ATTEMPTS = 3
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDED = ("done", "failed")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The store that values, maps and timers need, for the queries started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


# ---------------------------------------------------------------- queue items
def step(status: str, attempts: int, event: str) -> tuple[str, int]:
    """R2: queued -> running -> done or failed; an error requeues until ``MAX_ATTEMPTS``; what does not fit is ignored."""
    if event == "enqueue" and status in ("new", "failed"):
        return "queued", attempts
    if event == "start" and status == "queued":
        return "running", attempts + 1
    if event == "finish" and status == "running":
        return "done", attempts
    if event == "error" and status == "running":
        return ("queued" if attempts < MAX_ATTEMPTS else "failed"), attempts
    return status, attempts


class QueueItems(StatefulProcessor):
    """One item: its state, kept until ``keep`` after it has ended, by a timer of event time.

    Rows, not frames: a key has few rows in a batch, and a frame a key costs more than all of them.
    """

    def __init__(self, keep: timedelta):
        self.keep = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "status string, attempts int, ended long")

    def handleInputRows(self, key, rows, timerValues):
        status, attempts, ended = self.item.get() or ("new", 0, None)
        before = ended
        for now, seq, event in sorted(((r["ms"], r["seq"], r["event"]) for r in rows), key=lambda x: x[:2]):
            if ended is not None and now > ended + self.keep:
                status, attempts, ended = "new", 0, None  # forgotten, whether or not the timer has fired yet
            was = status
            status, attempts = step(status, attempts, event)
            if status != was:
                ended = now if status in ENDED else None
            yield Row(id=key[0], seq=seq, status=status, attempts=attempts)
        self.item.update((status, attempts, ended))
        if ended != before:
            if before is not None:
                self.handle.deleteTimer(before + self.keep + 1)
            if ended is not None:
                self.handle.registerTimer(ended + self.keep + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.item.get()
        if state and state[2] is not None:
            self.item.clear()
        return iter(())

    def close(self) -> None:
        pass


def item_states(events: DataFrame, keep: timedelta = timedelta(minutes=5), late: str = "1 hour") -> DataFrame:
    """The state of a queue item after each of its events (id, seq, event, ts).

    A key's events are applied by time, then ``seq``.  An item that ended longer than ``keep`` ago begins anew, and its
    state is dropped once the watermark says so.  Ids are strings.
    """
    watched = events.withWatermark("ts", late).select("id", "seq", "event", F.unix_millis("ts").alias("ms")).groupBy("id")
    return watched.transformWithState(QueueItems(keep), "id string, seq long, status string, attempts int", "Append", "EventTime")


# ---------------------------------------------------------------- uploads
class Uploads(StatefulProcessor):
    """One upload: bytes received without a gap, and the chunks that wait for others, by offset.

    Every call to the store is a round trip, so where chunks wait is kept in the value itself: a key costs one call to
    read and one to write.  Only the bytes of waiting chunks are in a map; the
    size of a chunk that has some there is negative.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("received", "bytes long, crc long, offsets array<long>, sizes array<long>")
        self.waiting = handle.getMapState("waiting", "at long", "data binary")

    def handleInputRows(self, key, rows, timerValues):
        at, crc, offsets, sizes = self.state.get() or (0, 0, (), ())
        before, held = (at, len(offsets)), dict(zip(offsets, sizes, strict=True))
        come: dict[int, tuple[int, bytes | None]] = {}
        for row in rows:
            offset, size = row["offset"], row["size"]
            if size > 0 and offset >= at and offset not in held:  # what was received comes again: ignored
                come.setdefault(offset, (size, row["data"] if "data" in row else None))
        while at in come or at in held:
            if at in come:
                size, piece = come.pop(at)
            else:
                size, piece = held.pop(at), None
                if size < 0:
                    size, piece = -size, self.waiting.getValue((at,))[0]
                    self.waiting.removeKey((at,))
            crc = zlib.crc32(bytes(piece), crc) if piece is not None else crc
            yield Row(upload_id=key[0], offset=at, size=size, data=piece, received=at + size, crc32=crc)
            at += size
        for offset, (size, piece) in come.items():
            held[offset] = size if piece is None else -size
            if piece is not None:
                self.waiting.updateValue((offset,), (piece,))
        if (at, len(held)) != before:
            self.state.update((at, crc, list(held), list(held.values())))

    def close(self) -> None:
        pass


def uploads(chunks: DataFrame) -> DataFrame:
    """Chunks (upload_id, offset, size[, data]) in any order, repeated or not, as the pieces that follow each other from the first byte.

    Each piece comes out once, as soon as all before it are there, with the bytes received by then and the checksum of
    them.  Only chunks that wait for others are kept.
    """
    schema = f"upload_id {chunks.schema['upload_id'].dataType.simpleString()}, offset long, size long, data binary, received long, crc32 long"
    return chunks.groupBy("upload_id").transformWithState(Uploads(), schema, "Append", "None")


def replay(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Run what is there through a stateful stream into the table ``sink``, then stop."""
    with rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _in_a_row(uploads: DataFrame) -> DataFrame:
    """Of each upload (upload_id, at, chunks by offset): ``at`` after the chunks that follow, these as ``taken``, and those ``waiting``."""
    # Of chunks at one offset the first is kept: what waits comes before what is new.
    once = F.filter("chunks", lambda x, i: (x["offset"] >= F.col("at")) & ((i == 0) | (F.get("chunks", i - 1)["offset"] != x["offset"])))
    end = F.aggregate("once", F.col("at"), lambda at, x: F.when(x["offset"] == at, at + x["size"]).otherwise(at))
    rows = uploads.withColumn("once", once).withColumn("end", end).withColumn("before", F.filter("once", lambda x: x["offset"] < F.col("end")))
    # Sizes that add up to the way say that nothing before its end overlaps; only else the way is gone step by step.
    added = F.aggregate("before", F.col("at"), lambda at, x: at + x["size"])
    none = F.struct(F.col("at").alias("at"), F.slice("before", 1, 0).alias("on"))
    on = lambda a, x: F.struct((a["at"] + x["size"]).alias("at"), F.concat(a["on"], F.array(x)).alias("on"))
    stepped = F.aggregate("before", none, lambda a, x: F.when(x["offset"] == a["at"], on(a, x)).otherwise(a))["on"]
    taken = F.when(added == F.col("end"), F.col("before")).otherwise(stepped)
    return rows.select("upload_id", F.col("end").alias("at"), F.filter("once", lambda x: x["offset"] > F.col("end")).alias("waiting"), taken.alias("taken"))


def replay_sizes(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """S22, R9 as ``uploads`` for chunks (upload_id, offset, size) without bytes, and without Python: what is there is run into ``sink``.

    A piece comes out once (upload_id, offset, size, received), as soon as all before it are there.  A batch's chunks meet those
    that wait in one shuffle; what has been received and what waits is a table under the checkpoint, written whole by each
    batch and read by the next.  A batch that is replayed reads the same table again and replaces what it had written.
    """
    folder = f"{checkpoint}/uploads"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        size, offset = F.col("size").cast("long"), F.col("offset").cast("long")
        chunk = F.struct(offset.alias("offset"), F.lit(True).alias("new"), size.alias("size"))
        rows = batch.filter("size > 0").select("upload_id", F.lit(0).cast("long").alias("at"), chunk.alias("chunk"))
        if batch_id:
            known = spark.read.parquet(f"{folder}/batch={batch_id - 1}").select("upload_id", "at", F.explode_outer("waiting").alias("w"))
            held = F.struct(F.col("w.offset").alias("offset"), F.lit(False).alias("new"), F.col("w.size").alias("size"))
            rows = rows.unionByName(known.select("upload_id", "at", F.when(F.col("w").isNotNull(), held).alias("chunk")))
        met = rows.groupBy("upload_id").agg(F.max("at").alias("at"), F.sort_array(F.collect_list("chunk")).alias("chunks"))
        _in_a_row(met).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        piece = spark.read.parquet(f"{folder}/batch={batch_id}").select("upload_id", F.explode("taken").alias("p"))
        piece = piece.select("upload_id", "p.offset", "p.size", (F.col("p.offset") + F.col("p.size")).alias("received"))
        piece.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        if batch_id > 1:  # the batch before may be needed again
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch_id - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
