"""Plumbing the training-data operators share: scratch tables, bounded lookups, Bloom filters, components.

Nothing here keeps per-document data on the driver.  What is cut out of a lineage goes to the
folder named by ``spark.checkpoint.dir`` so every executor can read it and a lost executor costs
nothing but its running tasks.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.operators.tables import scratch_root

#: A side of at most this many rows may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Ways a hot key is split where one side is repeated (salted join).
SALTS = 64


def integral(docs: DataFrame, doc_id: str) -> Column:
    """``doc_id`` as a long; a column of another type is refused, since no order or smallest id would be right."""
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"{doc_id} must be of an integer type, not {kind.simpleString()}")
    return F.col(f"`{doc_id}`").cast("long").alias("doc_id")


# ---------------------------------------------------------------- scratch tables
def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again; what was made from them must be written by then."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables.  Call only when no lazy result still reads them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- bounded lookups
def lookup(big: DataFrame, small: DataFrame, key: str, small_rows: int, salt: Column | None = None) -> DataFrame:
    """Left join of ``small`` (unique ``key``, null is a value) onto ``big``.

    Up to ``BROADCAST_ROWS`` rows ``small`` is broadcast.  Beyond, ``small`` is repeated once per
    salt, so that a key holding a third of ``big`` is dealt to ``SALTS`` tasks.
    """
    right = small.withColumnRenamed(key, "_key")
    if small_rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), big[key].eqNullSafe(right["_key"]), "left").drop("_key")
    salted = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pick = salt if salt is not None else F.xxhash64(*[big[c] for c in big.columns])
    left = big.withColumn("_salt", F.pmod(pick, F.lit(SALTS)).cast("int"))
    joined = left.join(salted, left[key].eqNullSafe(salted["_key"]) & (left["_salt"] == salted["_s"]), "left")
    return joined.drop("_key", "_s", "_salt")


#: A key is hot if it holds more than this share of a join's rows; so there are at most as many as its inverse.
HOT_SHARE = 1 / 1000
HOT_LEAST = 1000


def hot_keys(counts: DataFrame, key: str, many: str) -> list:
    """The keys that hold more than ``HOT_SHARE`` of all rows, from a table of rows by key: at most 1/``HOT_SHARE``."""
    total = counts.agg(F.sum(many)).first()[0] or 0
    if total <= HOT_LEAST:
        return []
    return [r[0] for r in counts.filter(F.col(many) > max(HOT_LEAST, total * HOT_SHARE)).select(key).collect()]


def attach(big: DataFrame, small: DataFrame, keys: list[str], hot: list, by: str, how: str, small_rows: int | None = None) -> DataFrame:
    """Join of ``small`` onto ``big`` by ``keys``, of which the first may be ``hot``.

    Rows of hot keys are dealt to ``SALTS`` tasks by a hash of the column ``by``; only the rows of ``small`` under hot
    keys are repeated for that.  With hot keys the result has the salt as ``salt_``.  ``small`` is broadcast only if it is
    known to have few rows.
    """
    if small_rows is not None and small_rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    if not hot:
        return big.join(small.hint("merge"), keys, how)
    is_hot = F.col(keys[0]).isin(hot)
    left = big.withColumn("salt_", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(small.withColumn("salt_", F.explode(salts)).hint("merge"), [*keys, "salt_"], how)


# ---------------------------------------------------------------- Bloom filters of bounded size
BLOOM_MAX_BITS = 1 << 27


class Bloom:
    """Two-probe Bloom filter over 64-bit keys, at most ``BLOOM_MAX_BITS`` bits (16 MB).

    Only used to leave out rows early: a join that follows is exact, so a full filter costs time
    and never changes a result.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the set; where few pass the first probe, the second is for those only."""
        keys = keys.astype(np.uint64, copy=False)
        out = self._probe(keys & np.uint64(0xFFFFFFFF))
        some = np.flatnonzero(out)
        if 2 * len(some) > len(keys):
            return out & self._probe(keys >> np.uint64(32))
        out[some] = self._probe(keys[some] >> np.uint64(32))
        return out


def bloom_of(df: DataFrame, key: str, rows: int) -> Bloom:
    """Filter over the long column ``key``, sized by ``rows`` up to the fixed maximum."""
    bits = 1 << 16
    while bits < min(16 * rows, BLOOM_MAX_BITS):
        bits <<= 1
    probes = F.array(F.col(key).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1)))
    at = df.select(F.explode(probes).alias("p"))
    words = at.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("b")
    )
    out = np.zeros(bits >> 6, np.int64)
    got = words.toArrow()  # at most BLOOM_MAX_BITS / 64 rows of two longs
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return Bloom(out.view(np.uint64), bits)


# ---------------------------------------------------------------- connected components
def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000003))")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (u, v): root is the smallest node reachable.

    Alternating large-star and small-star steps as aggregates and joins back: no neighbour list is
    ever collected, a hub's edges are dealt to several tasks, and each round is a scratch table.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = _digest(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("many"))
        hot = hot_keys(near, "u", "many")
        low = near.select("u", F.least("u", "m").alias("m"))
        large = attach(both.filter("v > u"), low, ["u"], hot, "v", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "cc")
        discard(edges)
        near = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many"))
        hot = hot_keys(near, "u", "many")
        low = near.select("u", "m")
        small = attach(large, low, ["u"], hot, "v", "inner")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        edges = materialise(small.distinct(), "cc")
        discard(large)
        now = _digest(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that long texts do not add up in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
