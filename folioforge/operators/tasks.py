"""Research tasks: equal active tasks are one, a few run at a time, the rest wait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTIVE = ("queued", "running")
MAX_RUNNING = 2


def same_request() -> Column:
    """What makes two requests equal: topic, queries in order, model."""
    return F.sha2(F.concat_ws("\x1f", F.lower(F.trim("topic")), F.array_join(F.coalesce("queries", F.array().cast("array<string>")), "\x1e"), F.coalesce("modelId", F.lit(""))), 256)


def submit(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that no active task equals, one of each, as queued tasks."""
    active = tasks.filter(F.col("status").isin(*ACTIVE)).select(same_request().alias("_k"))
    new = requests.withColumn("_k", same_request())
    one = new.groupBy("_k").agg(F.min_by(F.struct(*requests.columns), "createdAt").alias("r")).join(active, "_k", "left_anti")
    return one.select("r.*").withColumn("status", F.lit("queued"))


def admit(tasks: DataFrame, most: int = MAX_RUNNING) -> DataFrame:
    """The tasks that run now: those running, then the longest queued, ``most`` in all."""
    rank = F.when(F.col("status") == "running", 0).otherwise(1)
    first = tasks.filter(F.col("status").isin(*ACTIVE)).orderBy(rank, "createdAt", "id").limit(most).select("id")
    return tasks.join(first, "id", "left_semi").withColumn("status", F.lit("running"))


def deletable(tasks: DataFrame) -> DataFrame:
    """Tasks that may be deleted."""
    return tasks.filter(~F.col("status").isin(*ACTIVE))


def latest_step(steps: DataFrame) -> DataFrame:
    """The last state of each task's steps (task_id, step, status, at)."""
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("at"), F.desc("step")))
    return steps.withColumn("_r", rank).filter("_r = 1").drop("_r")
