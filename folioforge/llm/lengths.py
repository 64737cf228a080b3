"""Exact length histogram of encoded documents.

Documents are encoded whole and aggregated by their number of ids: one small row per distinct length
leaves the text.  Suffix sums over the histogram answer every question about a context limit L exactly:
documents of at least L ids, their ids, and the corpus's ids if each document is cut at L.  Suffix sums
are built in two levels - within ranges of ``SPAN`` lengths, and over the ranges' totals - so no task
holds the histogram, and a question is answered by looking up the next length above it.

Null and empty text has length 0 and counts as a document.  Long texts are encoded whole.  Repeated rows count
each.  An empty table gives an empty histogram, whose quantiles are null.  Other columns are not read by
``histogram``; ``encoded_lengths`` keeps those it is asked to (one named ``length`` is replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm.shared import materialise, modest_batches
from folioforge.llm.wavelet import encoder

SPAN = 256


def encoded_lengths(docs: DataFrame, tokenizer: str, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns and ``length``, the number of ids of the whole text."""
    modest_batches(docs.sparkSession)
    keep = tuple(c for c in keep if c != "length")
    schema = docs.select(*keep).withColumn("length", F.lit(0).cast("long")).schema

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            *cols, texts = batch.columns
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(enc.encode(texts)[1]), pa.int64())], schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def histogram(lengths: DataFrame, length: str = "length") -> DataFrame:
    """(length, n_docs, n_tokens) and the suffix sums at each length:

    docs_at_least, tokens_at_least, and truncated_tokens: all ids when documents are cut at this length.
    """
    h = materialise(lengths.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    h = h.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("_span", F.floor(F.col("length") / SPAN))
    inner = Window.partitionBy("_span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    spans = h.groupBy("_span").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    spans = spans.select(  # a row per SPAN lengths
        F.col("_span"),
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("_docs"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("_tokens"),
        F.sum("t").over(everything).alias("_all"),
    )
    out = h.withColumn("d", F.sum("n_docs").over(inner)).withColumn("t", F.sum("n_tokens").over(inner)).join(spans, "_span")
    docs, tokens = F.col("d") + F.col("_docs"), F.col("t") + F.col("_tokens")
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("_all") - tokens + F.col("length") * docs).alias("truncated_tokens"),
    )


def at_limits(hist: DataFrame, limits: DataFrame, limit: str = "context_limit") -> DataFrame:
    """Figures for each distinct ``limit``: documents and ids over it, and ids left when cut there.

    They are the suffix sums of the next length above the limit, which is in the limit's span or the first of a later
    one; so a limit meets the lengths of one span.  A null limit has null figures.
    """
    at = F.col("x")
    sums = F.struct(F.col("docs_at_least").alias("docs"), F.col("tokens_at_least").alias("tokens"))
    marks = hist.select(F.col("length").alias("x"), F.lit(0).alias("asked"), sums.alias("sums"))
    asked = limits.select(F.col(f"`{limit}`").cast("long").alias("x"), F.lit(1).alias("asked")).distinct()
    both = marks.unionByName(asked, allowMissingColumns=True).withColumn("span", F.floor(at / SPAN))
    later = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    near = F.first("sums", ignorenulls=True).over(later(Window.partitionBy("span").orderBy("x", "asked")))
    spans = both.groupBy("span").agg(F.min_by("sums", F.when(F.col("asked") == 0, at)).alias("first"))  # a row per SPAN lengths
    spans = spans.select("span", F.first("first", ignorenulls=True).over(later(Window.orderBy("span"))).alias("beyond"))
    total = hist.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"))
    found = both.withColumn("near", near).filter("asked = 1").join(spans, "span", "left")
    found = found.withColumn("over", F.coalesce("near", "beyond")).crossJoin(F.broadcast(total))  # one row
    figure = lambda c: F.when(at.isNotNull(), F.coalesce(c, F.lit(0)))
    out = found.select(at.alias(limit), figure(F.col("over.docs")).alias("docs_over"), figure(F.col("over.tokens")).alias("tokens_over"), "all")
    return out.withColumn("tokens_kept", F.col("all") - F.col("tokens_over") + F.col(limit) * F.col("docs_over")).drop("all")


def quantile(hist: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    total = hist.agg(F.sum("n_docs").alias("_all"))
    reach = hist.crossJoin(F.broadcast(total)).filter(F.col("_all") - F.col("docs_at_least") + F.col("n_docs") >= F.lit(share) * F.col("_all"))
    return reach.agg(F.min("length").alias("length"))
