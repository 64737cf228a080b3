"""Incremental ingestion as Structured Streaming: the checkpoint is the durable queue.

A file stream discovers new files, a batch function registers, extracts, analyses and upserts them, and a
restart resumes where the last committed batch ended.  Keys are path and content hash, so a file seen
again unchanged is skipped and the same content at two paths is two sources.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators import analyze
from folioforge.sources import files

FILE_STREAM = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """New files below ``root``, at most ``per_batch`` a batch."""
    return (
        spark.readStream.format("binaryFile").schema(FILE_STREAM).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
        .select(F.col("path").alias("relativePath"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    )


def new_files(batch: DataFrame, sink: str, batch_id: int) -> DataFrame:
    """The files of a batch that no earlier batch wrote to ``sink``, one row per path and content hash.

    What was ingested is looked up in the sink, so the stream keeps no state that grows; a batch that is replayed does
    not see what it had written itself.
    """
    spark, key = batch.sparkSession, ["relativePath", "sha256"]
    rows = batch.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(key)
    if not batch_id:
        return rows
    seen = spark.read.schema("relativePath string, sha256 string, batch long").parquet(sink).filter(F.col("batch") < batch_id)
    return rows.join(seen.select(*key), key, "left_anti")


def document_rows(batch: DataFrame, analyser: Callable = analyze.offline) -> DataFrame:
    """C5 for a batch of files: extracted, analysed, with a status each."""
    done = files.extract(batch)
    ok = ~F.col("metadata_only") & (F.coalesce("markdown", F.lit("")) != "")
    title = F.regexp_replace(F.regexp_extract("relativePath", "([^/]*)$", 1), "\\.[^.]*$", "")
    info = F.when(ok, analyser(title, F.col("markdown")))
    return done.withColumn("analysis", info).withColumn("status", F.when(ok, "ready").otherwise("failed")).withColumn("title", F.coalesce("analysis.title", title))


def run_once(spark: SparkSession, root: str, sink: str, checkpoint: str, analyser: Callable = analyze.offline) -> StreamingQuery:
    """Ingest all files not yet ingested into the table ``sink``, then stop.

    A batch is written under its own id, so a batch that is replayed replaces what it had written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = document_rows(new_files(batch, sink, batch_id), analyser)
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return file_stream(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recover(queue: DataFrame) -> DataFrame:
    """After a crash, what was running is queued again."""
    return queue.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def circuit_broken(analyse: Callable[[str, str], dict], offline: Callable[[str, str], dict], schema: str) -> Callable[[DataFrame], DataFrame]:
    """Rows (title, text) through ``analyse``; once it has failed, the run goes on with ``offline``.

    The returned function is the run: before each batch one row is tried, so a model that is gone is called once in
    all, however many tasks there are.  If it goes away during a batch, each task that meets that stops calling it.
    """
    gone = []

    def through(rows: DataFrame, alive: bool) -> DataFrame:
        def run(batches):
            works = alive
            for pdf in batches:
                out = []
                for title, text in zip(pdf["title"], pdf["text"], strict=True):
                    if works:
                        try:
                            out.append(analyse(title, text))
                            continue
                        except Exception:  # the model is gone; the offline analyser takes over
                            works = False
                    out.append(offline(title, text))
                yield pd.DataFrame(out)

        return rows.select("title", "text").mapInPandas(run, schema)

    def works(rows: DataFrame) -> bool:
        def run(batches):
            for pdf in batches:
                for title, text in zip(pdf["title"], pdf["text"], strict=True):
                    try:
                        analyse(title, text)
                        yield pd.DataFrame({"ok": [True]})
                    except Exception:
                        yield pd.DataFrame({"ok": [False]})

        return all(r.ok for r in rows.select("title", "text").limit(1).coalesce(1).mapInPandas(run, "ok boolean").collect())

    def apply(rows: DataFrame) -> DataFrame:
        if not gone and not works(rows):
            gone.append(True)
        return through(rows, not gone)

    return apply


def event_counts(events: DataFrame, minutes: int = 60) -> DataFrame:
    """An extension: windowed counts with a watermark for late events (ts, event_type)."""
    late = events.withWatermark("ts", f"{minutes} minutes")
    return late.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
