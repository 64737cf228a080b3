"""Mixing sources to target weights with hash-threshold histograms, in native DataFrame functions only.

Every document has a size and a hash.  Sizes are summed by (source, top bits of the hash); along these
buckets each source's budget is found; only the bucket in which the budget ends is split by the next
bits, until one hash is left there.  Documents are then taken by comparing hashes: nothing is sorted, and
a larger budget takes a superset of a smaller one.

A source's target may be up to ``MAX_REPEAT`` times its size: it is taken whole floor(target / size)
times and the rest by threshold.  Documents are taken whole; at the threshold the last one is taken if
that is nearer to the target (a tie takes it).

Null text and text without words have size 0 and ``taken`` 0.  A null source is a source of its own,
last in order.  Long texts are counted whole.  Repeated rows - equal id and text - share a hash; where the threshold
falls on it, as many of them are taken as come nearest to the target, and only they are numbered, in parts, however
many they are.  An empty table gives an empty result.  ``plan`` returns the columns it is asked to keep (none may have
the name of a result); other columns are ignored by it and passed through by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm.shared import SALTS, lookup, materialise
from folioforge.operators.tables import ranked

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HASH_BITS = 60
#: Bits of the hash that each histogram resolves: at most 4096 buckets a source.
STEP_BITS = 12


def word_count(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 over id and text, as any SQL engine can compute it."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, source: str) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    Weights go round by rank, and no task ranks all sources.  The share level is then raised
    until no source is above its limit; each round is one aggregate over the sources.
    """
    ranked_ = ranked(sources, F.col(source).asc_nulls_last(), to="_i", save=materialise)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_i") % len(WEIGHTS) + 1).cast("int"))
    weighted = materialise(ranked_.select(source, "source_size", weight.cast("long").alias("weight")), "weights")
    level = 0.0
    while True:
        held = F.col("weight") * F.lit(level) >= MAX_REPEAT * F.col("source_size")
        row = weighted.agg(
            F.sum("source_size"),
            F.sum(F.when(held, F.lit(MAX_REPEAT) * F.col("source_size")).otherwise(F.lit(0))),
            F.sum(F.when(held, F.lit(0)).otherwise(F.col("weight"))),
        ).first()
        if not row[0] or not row[2]:
            break
        now = (row[0] - row[1]) / row[2]
        if now <= level:
            break
        level = now
    return weighted.withColumn("target", F.least(F.col("weight") * F.lit(level), (F.lit(MAX_REPEAT) * F.col("source_size")).cast("double")))


def thresholds(sized: DataFrame, budgets: DataFrame, source: str, n_sources: int) -> DataFrame:
    """(source, limit, edge, k): documents of the source with a hash of at most ``limit`` fill its rest budget, with
    ``k`` of those of the hash ``edge`` where only some of these fit.

    ``sized``: (source, size, h); ``budgets``: (source, rest).  Level by level the boundary bucket of each
    source is split; only documents inside boundary buckets are read on.
    """
    done = []
    open_ = budgets.select(source, "rest", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("prefix"))
    shift = HASH_BITS
    while shift > 0:
        shift -= STEP_BITS
        # Buckets of the open sources: those whose hash begins with the boundary bucket's bits.
        inside = sized
        if shift < HASH_BITS - STEP_BITS:
            edge = open_.select(source, F.col("prefix").alias("_prefix"))
            inside = lookup(sized, edge, source, n_sources, F.col("h")).filter(F.shiftrightunsigned("h", shift + STEP_BITS) == F.col("_prefix"))
        hist = inside.groupBy(source, F.shiftrightunsigned("h", shift).alias("b")).agg(
            F.sum("size").alias("s"), F.count(F.lit(1)).alias("c"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        run = Window.partitionBy(source).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        right = open_.withColumnRenamed(source, "_key")
        cum = hist.join(right, hist[source].eqNullSafe(right["_key"])).drop("_key").withColumn("_after", F.col("base") + F.sum("s").over(run))
        # The boundary: the first bucket after which more than the rest is taken.
        edge = cum.filter(F.col("_after") > F.col("rest")).groupBy(source).agg(F.min_by(F.struct("b", "s", "c", "lo", "hi", "_after", "rest"), "b").alias("e"))
        edge = materialise(edge.select(source, "e.*"), "edges")
        one = (F.col("lo") == F.col("hi")) | F.lit(shift == 0)
        before = F.col("_after") - F.col("s")
        # Rows of one hash have one size; the k-th is taken if that is no farther from the target.
        k = F.floor((F.col("rest") - before) * F.col("c") / F.col("s") + 0.5)
        all_ = F.when(k >= F.col("c"), F.col("hi")).otherwise(F.col("lo") - 1)
        some = (k > 0) & (k < F.col("c"))
        done.append(edge.filter(one).select(source, all_.alias("limit"), F.when(some, F.col("lo")).alias("edge"), F.when(some, k).cast("long").alias("k")))
        open_ = edge.filter(~one).select(source, "rest", before.alias("base"), F.col("b").alias("prefix"))
        if open_.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


RESULT = ("size", "source_size", "target", "taken", "times")


def _first_of_edge(rows: DataFrame) -> DataFrame:
    """``rows`` (source, kept, k, ...) of the edge hashes with ``in_``: whether they are among the first k of their source.

    They stand in the order of a hash of all that is kept of them, so every run takes the same; rows that agree in all of it are the
    same row.  They are numbered inside (source, salt of that hash) and offset by the counts of the salts before.
    """
    order = F.sha2(F.to_json(F.struct("kept")), 256)
    rows = rows.withColumn("order", order).withColumn("salt", F.pmod(F.xxhash64("order"), F.lit(SALTS)))
    before = Window.partitionBy("_source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_source", "salt").count()  # at most SALTS rows a source
    starts = starts.select(F.col("_source").alias("_key"), F.col("salt").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("_source", "salt").orderBy("order"))
    both = rows.withColumn("place", place).join(starts, F.col("_source").eqNullSafe(F.col("_key")) & (F.col("salt") == F.col("_s")))
    return both.withColumn("in_", F.col("place") + F.col("first") <= F.col("k")).drop("place", "first", "_key", "_s", "order", "salt")


def plan(docs: DataFrame, *keep: str, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``keep`` columns with size, source_size, target, times and taken of every document."""
    if set(keep) & set(RESULT):
        raise ValueError(f"columns to keep may not be named {', '.join(RESULT)}")
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("string")
    sized = docs.select(
        kept.alias("kept"), F.col(f"`{source}`").alias("_source"), word_count(F.col(f"`{text}`")).alias("size"),
        doc_hash(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("h"),
    )
    sized = materialise(sized, "sized")
    narrow = sized.select("_source", "size", "h")
    totals = targets(narrow.groupBy("_source").agg(F.sum("size").alias("source_size")), "_source")
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEAT))).otherwise(0).cast("long")
    totals = materialise(totals.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "targets")
    n = totals.count()
    limits = thresholds(narrow, totals.filter("copies < 3 AND source_size > 0").select("_source", "rest"), "_source", n)
    right = limits.withColumnRenamed("_source", "_key")
    table = materialise(
        totals.join(right, totals["_source"].eqNullSafe(right["_key"]), "left").select(
            "_source", "source_size", "target", "copies", F.coalesce("limit", F.lit(-1)).cast("long").alias("limit"), "edge", "k"
        ),
        "mix",
    )
    out = lookup(sized, table, "_source", n, F.col("h"))
    at_edge = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    taken = out.withColumn("in_", F.col("h") <= F.col("limit"))
    if not table.filter("k IS NOT NULL").isEmpty():
        taken = taken.filter(~at_edge).unionByName(_first_of_edge(out.filter(at_edge)))
    taken = taken.withColumn("times", F.col("copies") + F.col("in_").cast("long")).withColumn("taken", F.col("size") * F.col("times"))
    return taken.select(*(["kept.*"] if keep else []), *RESULT)


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed documents: each row as often as the mix takes it (documents without words not at all)."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{source}`").alias("_src"), F.col(f"`{text}`").alias("_text"))
    mixed = plan(row, "_row", doc_id="_id", source="_src", text="_text").filter("taken > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("_row.*")
