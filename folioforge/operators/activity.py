"""Queue and registry activity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUEUE_STATUS = ("queued", "running", "done", "failed")
SOURCE_STATUS = ("queued", "ingesting", "ready", "skipped", "failed")
ACTIVE = ("queued", "running", "ingesting")
#: Shares of a limited view that failed and finished items may take.
FAILED_SHARE, DONE_SHARE = 0.2, 0.25
MAX_LIMIT = 5000


def status_counts(items: DataFrame, statuses: tuple[str, ...] = QUEUE_STATUS, by: tuple[str, ...] = (), status: str = "status") -> DataFrame:
    """A1, A2: a column per status and the total."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts)


def progress(queue: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A4: figures of a queue (id, status, updatedAt, ord) and its first running and first queued item."""
    first = lambda s: F.min_by(F.when(F.col("status") == s, F.col("id")), F.when(F.col("status") == s, F.col("ord")))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in QUEUE_STATUS]
    g = queue.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts, F.max("updatedAt").alias("updatedAt"), first("running").alias("active"), first("queued").alias("next"))
    g = g.withColumn("processed", F.col("done") + F.col("failed"))
    waiting = F.col("active").isNotNull() | F.col("next").isNotNull()
    index = F.when(waiting, F.least("total", F.col("processed") + 1)).otherwise(F.col("processed"))
    percent = F.when(F.col("total") > 0, F.floor(100 * F.col("processed") / F.col("total"))).otherwise(0)
    return g.withColumn("percent", percent.cast("long")).withColumn("currentIndex", index)


def with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Queue items with what the registry knows of their source."""
    known = sources.select(F.col("id").alias("sourceId"), "fileName", "title", "kind", "size")
    name = F.coalesce("fileName", F.regexp_extract("relativePath", "([^/]*)$", 1))
    return items.join(known, "sourceId", "left").withColumn("fileName", name)


def limit_of(value: int | None, fallback: int) -> int:
    """Z5, N1."""
    return fallback if not value or value <= 0 else min(MAX_LIMIT, int(value))


def quota_sample(queue: DataFrame, limit: int) -> DataFrame:
    """A limited view of a queue (id, status, createdAt, updatedAt, ord).

    All running items, the newest failed up to a fifth and the newest finished up to a quarter of the
    limit, then queued ones; shown by status, then time.  A queue within the limit is shown whole.  Each
    status is cut by a bounded heap of its own, so no task ranks the queue.
    """
    up = lambda share: -int(-limit * share // 1)
    known = F.col("status").isin("running", "failed", "done")
    heaps = (
        (0, F.col("status") == "running", F.col("ord").asc(), limit),
        (1, F.col("status") == "failed", F.col("ord").desc(), up(FAILED_SHARE)),
        (2, F.col("status") == "done", F.col("ord").desc(), up(DONE_SHARE)),
        (3, ~F.coalesce(known, F.lit(False)), F.col("ord").asc(), limit),
    )
    parts = []
    for group, which, order, cap in heaps:
        some = queue.filter(which).orderBy(order).limit(limit)
        place = F.row_number().over(Window.orderBy(order))  # at most ``limit`` rows
        parts.append(some.withColumn("_r", place).withColumn("_g", F.lit(group)).withColumn("_cap", F.lit(cap)))
    total = queue.agg(F.count(F.lit(1)).alias("_n"))
    cut = reduce(DataFrame.unionByName, parts).crossJoin(F.broadcast(total))  # one row
    cut = cut.filter((F.col("_n") <= limit) | (F.col("_r") <= F.col("_cap")))
    taken = cut.orderBy("_g", "_r").limit(limit)
    late = F.when(F.col("status") == "queued", F.lit(None)).otherwise(F.coalesce("updatedAt", "createdAt"))
    early = F.when(F.col("status") == "queued", F.col("createdAt"))
    return taken.orderBy("_g", F.desc(late), early, "ord").drop("_r", "_g", "_n", "_cap")


def recent_with_active(items: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` active items, filled up with the newest others; in stored order."""
    active = F.col("status").isin(*ACTIVE)
    return items.orderBy(F.desc(active), F.desc("ord")).limit(limit).orderBy("ord")


def within_ttl(rows: DataFrame, ts: str, now: Column, minutes: int, active: Column | None = None) -> DataFrame:
    """Rows that are active or were updated in the last ``minutes``."""
    fresh = F.col(ts) >= now - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return rows.filter(fresh if active is None else fresh | active)


def latest_by(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last row of each key, as an aggregation with map-side combine."""
    others = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(ts, tie))
    return rows.groupBy(key).agg(last.alias("_r")).select(key, "_r.*")


def compact(rows: DataFrame, most: int = 500) -> DataFrame:
    """A listing without summaries and with short errors."""
    return rows.drop("summary").withColumn("error", F.substring("error", 1, most))


def newly_done(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items finished since the last look."""
    return after.filter("status = 'done'").join(before.filter("status = 'done'").select("id"), "id", "left_anti")


def view(queue: DataFrame, sources: DataFrame, queue_limit: int | None = None, source_limit: int | None = None) -> dict[str, DataFrame]:
    """The parts of an activity view, each a plan of its own."""
    return {
        "queue": with_source(quota_sample(queue, limit_of(queue_limit, 500)), sources),
        "sources": compact(recent_with_active(sources, limit_of(source_limit, 500))),
        "queue_stats": status_counts(queue, QUEUE_STATUS),
        "source_stats": status_counts(sources, SOURCE_STATUS),
        "bytes": sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")),
        "progress": progress(queue),
    }
