"""Topic pages that follow their sources: a ledger of notes, changed by signed differences.

Below one folder ``notes`` holds every note that counts - (kind, key, path, topic, title, ord, evidence) and the run it
first came in - and ``pages`` the pages made of them.  A source that is deleted takes its notes with it; one that is noted
again replaces all it had said.  What is taken away and what is added meet as -1 and +1; what adds up to nothing is no
change, and only the topics of the rest are ranked and put together again.  A topic without notes has no page.

Both tables are published whole (``sinks.replace_table``), the ledger first.  A run that ends between the two leaves pages that
are behind; ``repair`` finds these by comparing, however often it is called, and so does the next change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import topics
from folioforge.operators.tables import materialise
from folioforge.sources.sinks import read_table, replace_table

TOPIC = ["kind", "key"]
NOTE = ["kind", "key", "path", "topic", "title", "ord", "evidence"]


def differences(ledger: DataFrame, removed: DataFrame, noted: DataFrame) -> DataFrame:
    """(note, sign): -1 for each note of a removed or newly noted source, +1 for each new one, those that cancel left out."""
    gone = removed.select("path").unionByName(noted.select("path")).distinct()
    minus = ledger.select(*NOTE).join(gone, "path", "left_semi").select(*NOTE, F.lit(-1).alias("sign"))
    both = minus.unionByName(noted.select(*NOTE, F.lit(1).alias("sign")))
    return both.groupBy(*NOTE).agg(F.sum("sign").alias("sign")).filter("sign <> 0")


def _first_run(spark: SparkSession, noted: DataFrame, root: str) -> DataFrame:
    ledger = noted.limit(0).withColumn("run", F.lit(0).cast("long")).select(*NOTE, "run")
    have = read_table(spark, f"{root}/notes", missing_ok=True)
    return ledger if have is None else have


def change(root: str, noted: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
    """Bring the pages below ``root`` up to new notes (``topics.notes``) and removed sources (path); numbers of notes and topics touched."""
    spark = noted.sparkSession
    removed = noted.select("path").limit(0) if removed is None else removed
    ledger = _first_run(spark, noted, root)
    run = (ledger.agg(F.max("run").alias("n")).first().n or 0) + 1
    delta = materialise(differences(ledger, removed, noted), "differences")
    touched = materialise(delta.select(*TOPIC).distinct(), "touched")
    # A source that a topic has already keeps its place there, whatever it says now.
    place = ledger.select(*TOPIC, "path", F.col("run").alias("_run"))
    plus = delta.filter("sign > 0").join(place, [*TOPIC, "path"], "left").select(*NOTE, F.coalesce("_run", F.lit(run)).alias("run"))
    minus = delta.filter("sign < 0").select(*TOPIC, "path")
    after = materialise(ledger.join(minus, [*TOPIC, "path"], "left_anti").unionByName(plus), "ledger")
    replace_table(after, f"{root}/notes")
    pages = read_table(spark, f"{root}/pages", missing_ok=True)
    made = topics.merge(after.join(touched, TOPIC, "left_semi"))
    replace_table(made if pages is None else pages.join(touched, TOPIC, "left_anti").unionByName(made), f"{root}/pages")
    row = delta.agg(F.count_if(F.col("sign") > 0).alias("added"), F.count_if(F.col("sign") < 0).alias("taken")).first()
    return {"added": row.added, "taken": row.taken, "topics": touched.count()}


def repair(spark: SparkSession, root: str) -> int:
    """Make again the pages that do not agree with the ledger; how many there were."""
    right = materialise(topics.merge(read_table(spark, f"{root}/notes")), "right")
    have = read_table(spark, f"{root}/pages", missing_ok=True)
    if have is None:
        replace_table(right, f"{root}/pages")
        return right.count()
    said = lambda df, name: df.select(*TOPIC, F.xxhash64("topic", "sources", F.to_json("notes")).alias(name))
    wrong = said(right, "a").join(said(have, "b"), TOPIC, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*TOPIC)
    n = materialise(wrong, "wrong").count()
    if n:
        replace_table(right, f"{root}/pages")
    return n


def pages(spark: SparkSession, root: str) -> DataFrame:
    """(kind, key, topic, sources, notes) of all topics."""
    return read_table(spark, f"{root}/pages")
