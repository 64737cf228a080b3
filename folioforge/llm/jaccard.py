"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct ``WORDS_IN_SHINGLE``-word shingles.  The global shingle order runs from
rare to frequent (frequency classes from a counting sketch over the whole corpus, of 2^20 counters and more for a large
one; any order is correct, a good one is fast).  It is cut into ``FRAGMENTS`` fragments; a pair's overlap is counted in each
fragment by itself and summed per pair.

1. Equal sets are one class (``sig``); only classes are joined, so copies are never expanded.
2. Candidates share a token of their prefixes - the n - ceil(t n) + 1 rarest shingles - and pass the length
   bound and the positional bound.  First every entry of a token's list is paired with the list's leader
   (the set with the fewest rarer tokens, nearest to what the list has in common) and verified; linked
   classes are merged.  Then only entries not in their leader's
   component are paired, with every entry of the list in another component.  Any pair that this leaves out
   lies inside a component already, so no link that matters is lost and a large group of near copies costs
   as many pairs as it has members, not their square.
3. Components of the verified links; a document's class is the smallest doc_id in its component.

Where one token, leader or set holds more than a thousandth of a join's rows, these are dealt to several tasks and its
row on the other side is repeated for each.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer words than a shingle are one whole shingle.
Shingles are compared by 64-bit hashes, sets by 128-bit hashes
(a 64-bit name, checked to be unique).  Texts null or without words have an empty
set, link with nothing and are their own class.  Long texts are taken whole.  Repeated rows fall into one class; of rows
of one doc_id and set ``one_of_each`` keeps one.  A null doc_id takes part; it names a class only if all its members have
none.  doc_id must be of an integer type.  An empty table gives an empty result.  Other columns are not read by
``classes`` and pass through ``one_of_each`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import bytescan
from folioforge.llm.shared import Bloom, attach, bloom_of, components, discard, hot_keys, integral, materialise, modest_batches, union_all

WORDS_IN_SHINGLE = 4
PERCENT = 85
#: Near copies of which ``one_of_each`` keeps one.
COPY_WORDS = 5
COPY_PERCENT = 80
FRAGMENTS = 4
#: Bits of the frequency sketch's number of counters: least and most, and the bytes of input up to which the least will do.
LEAST_BITS, MOST_BITS, LEAST_INPUT = 20, 24, 1 << 30
_ROWS = 64


def shingle_sets(texts: pa.Array, k: int = WORDS_IN_SHINGLE):
    """(row, sorted distinct shingle hashes) of each text that has words."""
    for a, b, buf, offs in bytescan.chunks(texts):
        words = bytescan.Words(buf, offs, bytescan.SPACED)
        all_, of = words.shingles(k), words.of
        for r in range(b - a):
            i, j = int(of[r]), int(of[r + 1])
            if j - i >= k:
                yield a + r, np.unique(all_[i : j - k + 1])
            elif j > i:
                yield a + r, bytescan.combine([words.hash[x : x + 1] for x in range(i, j)])


def signature(s: np.ndarray, salt: int) -> tuple[int, int]:
    """Two signed 64-bit halves of a hash of the set: the class's name, and the check that no other set has it."""
    x = hashlib.blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def sketch_bits(docs: DataFrame) -> int:
    """One bit more for each doubling of the input, as far as Spark knows its size."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    more = (size // LEAST_INPUT).bit_length() if size < 1 << 60 else 0
    return min(MOST_BITS, LEAST_BITS + more)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


class Order:
    """The global shingle order: frequency class first, then hash; and its cut into fragments."""

    def __init__(self, counts: np.ndarray):
        by = np.argsort(counts, kind="stable")
        self.bits = len(counts).bit_length() - 1
        self.rank = np.empty(len(counts), np.uint32)
        self.rank[by] = np.arange(len(counts), dtype=np.uint32)
        mass = np.cumsum(counts[by])
        self.cut = np.empty(len(counts), np.int8)
        self.cut[by] = np.minimum(FRAGMENTS - 1, mass * FRAGMENTS // max(1, mass[-1] + 1))

    def sort(self, s: np.ndarray) -> np.ndarray:
        key = self.rank[_bucket(s, self.bits)].astype(np.uint64) << np.uint64(64 - self.bits)
        return s[np.argsort(key | (s >> np.uint64(self.bits)), kind="stable")]

    def fragment(self, s: np.ndarray) -> np.ndarray:
        return self.cut[_bucket(s, self.bits)]


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any linked set."""
    return -(-percent * n // 100)


def _profile(docs: DataFrame, k: int, salt: int) -> DataFrame:
    """(doc_id, sig, half, n) of every text and, at each task's end, its part of the frequency sketch."""
    names = ["doc_id", "sig", "half", "n", "block", "counts"]
    bits = sketch_bits(docs)

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            size = batch.num_rows
            n, sig, half, sets = [0] * size, [None] * size, [None] * size, []
            for r, s in shingle_sets(batch.column(1), k):
                n[r], (sig[r], half[r]) = len(s), signature(s, salt)
                sets.append(s)
            if sets:
                at, many = np.unique(_bucket(np.concatenate(sets), bits), return_counts=True)
                counts[at] += many.astype(np.uint32)
            none = pa.nulls(size)
            cols = [batch.column(0), pa.array(sig, pa.int64()), pa.array(half, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, none.cast(pa.int32()), none.cast(pa.binary())], names)
        pack = zstandard.ZstdCompressor(level=1)
        parts = [pack.compress(x.tobytes()) for x in counts.reshape(_ROWS, -1)]
        none = pa.nulls(_ROWS).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(_ROWS), pa.int32()), pa.array(parts, pa.binary())], names)

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sig long, half long, n long, block int, counts binary")
    return materialise(out, "profile")


def _order(profile: DataFrame) -> Order:
    """Sum the tasks' sketches block by block; the result has a fixed size."""

    def add(batches):
        unpack = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(unpack.decompress(x), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"]
        )

    rows = profile.filter("block IS NOT NULL").select("block", "counts").repartition(_ROWS, "block").mapInArrow(add, "block int, counts binary").collect()
    counts = {b: np.frombuffer(x, np.int64) for b, x in rows}
    return Order(np.concatenate([counts[b] for b in range(_ROWS)]) if counts else np.zeros(1 << LEAST_BITS, np.int64))


def _prefixes(docs: DataFrame, order, k: int, percent: int, salt: int, only: Bloom | None = None) -> DataFrame:
    """(token, sig, n, pos) of every set's prefix; of copies that one task sees, only the first.

    ``only``: tokens that are surely not in it are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, sigs, sizes = [], [], []
            for _, s in shingle_sets(batch.column(0), k):
                sig = signature(s, salt)[0]
                if sig in seen:
                    continue
                seen.add(sig)
                tokens.append(order.value.sort(s)[: len(s) - needed(len(s), percent) + 1])
                sigs.append(sig)
                sizes.append(len(s))
            if not tokens:
                continue
            lens = np.array([len(t) for t in tokens])
            which = np.repeat(np.arange(len(tokens)), lens)
            pos = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            token = np.concatenate(tokens)
            if held.value is not None:
                some = held.value.has(token)
                token, which, pos = token[some], which[some], pos[some]
            cols = [token.view(np.int64), np.array(sigs, np.int64)[which], np.array(sizes, np.int32)[which], pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "sig", "n", "pos"])

    return docs.select("text").mapInArrow(run, "token long, sig long, n int, pos int")


def _bounds(percent: int):
    """Length bound and positional bound of entries (n, pos) and (n2, pos2) of one token."""
    length = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return length & ((100 + percent) * most >= percent * (F.col("n") + F.col("n2")))


def _doc_key():
    return F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")))


def _fragments(docs: DataFrame, order, wanted: Bloom, k: int, salt: int) -> DataFrame:
    """(sig, f, part): the fragments of the sets of documents that may be wanted; a class once for each task."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            at = np.flatnonzero(held.value.has(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            sigs, frags, parts = [], [], []
            for _, s in shingle_sets(batch.column(0).take(pa.array(at)), k):
                sig, of = signature(s, salt)[0], order.value.fragment(s)
                if sig in seen:
                    continue
                seen.add(sig)
                for f in range(FRAGMENTS):
                    part = s[of == f]
                    if len(part):
                        sigs.append(sig)
                        frags.append(f)
                        parts.append(part.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs, pa.int64()), pa.array(frags, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["sig", "f", "part"]
            )

    return docs.select("text", _doc_key().alias("key")).mapInArrow(run, "sig long, f int, part array<long>")


def classes(docs: DataFrame, k: int = WORDS_IN_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, sig, root, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    ``sig`` names the row's set and ``root`` its component; both are null without words.
    """
    return _classes(docs, k, percent)[0]


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, int]:
    """The classes and the salt with which ``signature`` gave the names."""
    spark = docs.sparkSession
    modest_batches(spark)
    docs = docs.select(integral(docs, "doc_id"), "text")
    salt = 0
    while True:  # again only if two different sets should share a 64-bit name
        profile = _profile(docs, k, salt)
        reps = profile.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("half").alias("a"), F.max("half").alias("b"))
        reps = materialise(reps, "reps")
        if reps.filter("a <> b").isEmpty():
            break
        salt += 1
    reps = reps.select("sig", "rep")
    order = spark.sparkContext.broadcast(_order(profile))
    rows = profile.filter("block IS NULL").select("doc_id", "sig", "n")
    named = rows.filter("sig IS NOT NULL")

    # Tokens that occur in more than one prefix; the entries of those tokens; each token's leader.
    tokens = _prefixes(docs, order, k, percent, salt).select("token").groupBy("token").count().filter("count > 1").select("token")
    tokens = materialise(tokens, "tokens")
    shared = bloom_of(tokens, "token", tokens.count())
    entries = materialise(_prefixes(docs, order, k, percent, salt, shared), "entries")
    place = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    leaders = entries.groupBy("token").agg(
        F.min_by("sig", place).alias("sig2"), F.min(place).alias("at"), F.min("sig").alias("a"), F.max("sig").alias("b"), F.count(F.lit(1)).alias("many")
    )
    leaders = leaders.filter("a <> b").select(
        "token", "sig2", F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("n2"), F.shiftright("at", 32).cast("int").alias("pos2"), "many"
    )
    leaders = materialise(leaders, "leaders")
    hot = hot_keys(leaders, "token", "many")
    lists = attach(entries, leaders.drop("many"), ["token"], hot, "sig", "inner")
    lists = materialise(lists.dropDuplicates(["token", "salt_", "sig"] if hot else ["token", "sig"]).drop("salt_"), "lists")
    hot_leaders = hot_keys(leaders.groupBy("sig2").agg(F.sum("many").alias("many")), "sig2", "many")
    discard(tokens, entries, leaders)

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose overlap, summed over the fragments, is enough."""
        pairs = materialise(pairs, "pairs")
        wanted = materialise(pairs.select(F.explode(F.array("u", "v")).alias("sig")).distinct().join(reps, "sig"), "wanted")
        bloom = bloom_of(wanted.select(F.col("rep").alias("doc_id")).select(_doc_key().alias("key")), "key", wanted.count())
        parts = materialise(_fragments(docs, order, bloom, k, salt), "fragments")
        # Both joins are by class and fragment, so the fragments are dealt out once; a hot class's pairs are dealt on.
        many = pairs.select(F.explode(F.array("u", "v")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("many"))
        hot = hot_keys(many, "sig", "many")
        each = pairs.withColumn("f", F.explode(F.array([F.lit(f) for f in range(FRAGMENTS)])))
        first = parts.select(F.col("sig").alias("v"), "f", F.col("part").alias("b"))
        second = parts.select(F.col("sig").alias("u"), "f", F.col("part").alias("a"))
        both = attach(attach(each, first, ["v", "f"], hot, "u", "inner").drop("salt_"), second, ["u", "f"], hot, "v", "inner")
        partial = both.select("u", "v", "nu", "nv", "f", F.size(F.array_intersect("a", "b")).alias("o"))
        # A class may come from several tasks; its fragments are the same, so one count of each stays.
        partial = partial.groupBy("u", "v", "nu", "nv", "f").agg(F.max("o").alias("o"))
        total = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("o").alias("o"))
        enough = total.filter((100 + percent) * F.col("o") >= percent * (F.col("nu") + F.col("nv"))).select("u", "v")
        linked = materialise(enough, "links")
        discard(pairs, wanted, parts)
        return linked

    star = lists.filter("sig <> sig2").filter(_bounds(percent))
    star = star.select(F.col("sig").alias("u"), F.col("sig2").alias("v"), F.col("n").alias("nu"), F.col("n2").alias("nv")).distinct()
    links = verify(star)
    roots = materialise(components(links), "roots")
    n_roots = roots.count()

    def rooted(df: DataFrame, sig: str, to: str, hot=()) -> DataFrame:
        small = roots.select(F.col("node").alias(sig), F.col("root").alias(to))
        return attach(df, small, [sig], hot, "sig", "left", n_roots).drop("salt_").withColumn(to, F.coalesce(to, sig))

    marked = rooted(rooted(lists, "sig", "root"), "sig2", "root2", hot_leaders)
    marked = materialise(marked.select("token", "sig", "n", "pos", "root", "sig2", "root2"), "marked")
    strays = marked.filter("root <> root2").select("token", "sig", "n", "pos", "root", "sig2")
    others = marked.select("token", F.col("sig").alias("s"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("root").alias("r"))
    # A hot token's strays are dealt to several tasks, each with all others of its list.
    rest = attach(strays, others, ["token"], hot, "sig", "inner").filter("root <> r AND s <> sig2").filter(_bounds(percent))
    rest = rest.select(
        F.greatest("sig", "s").alias("u"),
        F.least("sig", "s").alias("v"),
        F.when(F.col("sig") > F.col("s"), F.col("n")).otherwise(F.col("n2")).alias("nu"),
        F.when(F.col("sig") > F.col("s"), F.col("n2")).otherwise(F.col("n")).alias("nv"),
    ).distinct()
    rest = materialise(rest, "rest")
    if not rest.isEmpty():
        links = union_all([links, verify(rest)])
        roots = materialise(components(links), "roots")
        n_roots = roots.count()

    labelled = rooted(reps, "sig", "root")
    lowest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    table = labelled.join(lowest, "root").select("sig", "root", "component_id")
    copies = hot_keys(named.groupBy("sig").agg(F.count(F.lit(1)).alias("many")), "sig", "many")
    out = attach(named, table, ["sig"], copies, "doc_id", "inner").drop("salt_")
    alone = rows.filter("sig IS NULL").withColumn("root", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return out.unionByName(alone).withColumnRenamed("n", "n_shingles").select("doc_id", "sig", "root", "n_shingles", "component_id"), salt


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = COPY_WORDS, percent: int = COPY_PERCENT) -> DataFrame:
    """The rows of ``docs`` but for later members of a class: of each, the smallest doc_id stays.

    Rows of one doc_id are told apart by their sets; repeated rows count as one document.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), integral(docs, doc_id), F.col(f"`{text}`").alias("text"))
    found, salt = _classes(rows.select("doc_id", "text"), k, percent)
    cls = materialise(found, "classified")
    ids = cls.filter("sig IS NOT NULL").groupBy("doc_id").count()
    if ids.filter("doc_id IS NULL OR count > 1").isEmpty():
        gone = cls.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
        return rows.join(gone, "doc_id", "left_anti").select("row.*")
    # Some doc_id names several rows or none: rows are told apart by their sets, too.
    stay = cls.filter("sig IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sig")).alias("m"))
    stay = stay.select(F.col("m.doc_id").alias("id"), F.col("m.sig").alias("key"))
    marked = rows.withColumn("sig", _signature_column(F.col("text"), k, salt))
    first = marked.join(stay, (F.col("sig") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    one = first.groupBy("doc_id", "sig").agg(F.min_by("row", F.struct(F.xxhash64("text"), F.xxhash64("row"))).alias("row"))
    return one.select("row").unionByName(marked.filter("sig IS NULL").select("row")).select("row.*")


def _signature_column(text, k: int, salt: int):
    """``sig`` as ``_classes`` gives it under ``salt``, as a column."""

    @F.arrow_udf("long")
    def sig(texts: pa.Array) -> pa.Array:
        out: list[int | None] = [None] * len(texts)
        for r, s in shingle_sets(texts, k):
            out[r] = signature(s, salt)[0]
        return pa.array(out, pa.int64())

    return sig(text)
