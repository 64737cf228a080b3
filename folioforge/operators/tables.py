"""Scratch and output tables in folders that all executors reach, and ranks that no single task computes.

Scratch tables cut a lineage and outlive executors; they go to the folder that ``spark.checkpoint.dir`` names.
Outputs stay: they go below the warehouse, or where ``spark.folioforge.output`` says.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_known: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, which shares its folders with itself."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors reach: ``spark.checkpoint.dir``, else the checkpoint directory set on the context.

    Only a local session may do without: it gets a temp folder.  Anywhere else executors would write to disks of
    their own and later reads would silently miss the files, so that is an error.
    """
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key) or spark.conf.get("spark.folioforge.tables", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        root = f"file://{tempfile.mkdtemp(prefix='folioforge-')}"
        spark.conf.set("spark.folioforge.tables", root)
    return root.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """This application's scratch folder.  It is deleted when the driver's Python ends: no lazy result can be read after that."""
    own = f"{shared_root(spark)}/folioforge/{spark.sparkContext.applicationId}"
    if own not in _known:
        _known.add(own)
        atexit.register(_delete, spark, own)
    return own


def output_path(spark: SparkSession, name: str) -> str:
    """A new path for an output that outlives the session."""
    root = spark.conf.get("spark.folioforge.output", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/folioforge"
    return f"{root.rstrip('/')}/{name}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"


def _delete(spark: SparkSession, folder: str) -> None:
    scheme, sep, rest = folder.partition("://")
    if not sep or scheme == "file":
        shutil.rmtree(rest if sep else folder, ignore_errors=True)
    elif spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that long texts do not add up in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:  # zero and less: no limit
        spark.conf.set(key, str(rows))


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of a table, dealt out if the tasks that read it would leave cores idle: a file may have all its rows in one task.

    What a task reads is counted first, without any column.  Rows are dealt by their place, so that no key gathers them.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    if max(counts, default=0) * cores <= 2 * sum(counts):
        return rows
    return rows.withColumn("_place", F.monotonically_increasing_id()).repartition(4 * cores, "_place").drop("_place")


#: A side of a join is broadcast only if a count says that it has no more rows.
BROADCAST_ROWS = 100_000
#: So many rows are ranked in one task.
FEW = 100_000


def ranked(rows: DataFrame, *order: Column, to: str, save=materialise) -> DataFrame:
    """``rows`` with their 0-based place along ``order`` in ``to``, and no task that ranks more than ``FEW`` by itself.

    Where there are more, rows are dealt to ordered ranges and ranked inside each; a range is offset by the counts before it.
    """
    rows = save(rows, "rows")
    if rows.count() <= FEW:
        return rows.withColumn(to, F.row_number().over(Window.orderBy(*order)) - 1)  # a size that is checked
    parts = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    parts = save(parts, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))  # a row per shuffle partition
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_first")
    return parts.join(F.broadcast(starts), "_range").withColumn(to, place).drop("_range", "_first")


def numbered(rows: DataFrame, key: str, *order: Column, to: str) -> DataFrame:
    """``rows`` with their 1-based place among the rows of their ``key`` along ``order`` in ``to``.

    Rows are dealt to ranges of (key, order), so that a key's rows may lie in several tasks.  Ranges are in order, hence
    a key goes on in a range only as that range's first: the counts to add are at most one row a range.
    """
    parts = materialise(rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_range", key).count()
    earlier = F.sum("count").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("_before", earlier).filter("_before IS NOT NULL").select(F.col("_range").alias("_r"), F.col(key).alias("_k"), "_before")
    place = F.row_number().over(Window.partitionBy("_range", key).orderBy(*order)) + F.coalesce("_before", F.lit(0))
    same = (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k"))
    return parts.join(F.broadcast(before), same, "left").withColumn(to, place).drop("_range", "_r", "_k", "_before")


#: Below so many rows a join's hot keys are left to one task.
HOT_LEAST = 100_000
#: A key is hot if it holds more than this share of the rows, so there are a thousand at most.
HOT_SHARE = 0.001


def look_up(rows: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``value`` of the row of ``values`` - one at most for a key - that has their ``key``; null without one.

    Rows of hot keys do not move: the few values under those keys, a number that ``HOT_SHARE`` bounds, are broadcast.
    """
    total = rows.count()
    if total <= HOT_LEAST:
        return rows.join(values, key, "left")
    often = rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > total * HOT_SHARE).select(key)
    often = materialise(often, "hot")
    found = materialise(values.join(F.broadcast(often), key), "hot_values")
    is_hot = rows.join(F.broadcast(often.withColumn("_hot", F.lit(True))), key, "left")
    hot = is_hot.filter("_hot").drop("_hot").join(F.broadcast(found), key, "left")
    return is_hot.filter("_hot IS NULL").drop("_hot").join(values.hint("merge"), key, "left").unionByName(hot)
