"""How far sources of one language are from each other, and the terms that set a source apart.

Terms are runs of letters and of everything beyond ASCII, A-Z lower-cased.  Each language keeps the terms that
``LEAST_DOCS`` of its documents hold.  A group - the documents of a source in a language - and the language itself give
each kept term a smoothed share in billionths, ``1 + floor(10^9 (count + 2) / (N + 2 V))``; two shares diverge by
``floor((p - q)^2 / (p + q))``.  All of it is integer arithmetic in 64 bits, exact while a language has fewer than 4.6 * 10^15
kept occurrences.

Counts come from one scan: each task adds up its documents before anything is shuffled (``HELD`` terms at most), and what
is shuffled is aggregated by (language, source, term), whoever holds most of the rows.

``pairs``: two-dimensional group-block tiling.  A language's groups are numbered and cut into blocks of ``BLOCK``; its kept terms are dealt to
chunks of about ``CHUNK``.  The counts of a block in a chunk are one packed record.  A tile is a pair of blocks, and every
record is sent to the tiles of its block; there the records arrive chunk after chunk, so a tile holds two dense ``BLOCK`` by ``CHUNK``
arrays and its submatrix of sums, whatever the vocabulary and the number of sources.  Terms that neither block has
diverge alike for a pair and are added at the end.

``terms``: each group's kept terms whose share is above the language's, best ``TOP`` ones.

Null text, language and source are ''.  Groups without terms, and languages without kept terms (all values 0), are
reported.  Equal values are ranked by the item's bytes.  Long texts are counted whole, repeated rows each count.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm.shared import lookup, materialise, modest_batches

#: Documents of a language that must hold a term.
LEAST_DOCS = 10
#: Terms that a counting task holds.
HELD = 400_000
#: Groups of a block and, on average, terms of a chunk.
BLOCK, CHUNK = 64, 1024
TOP = 10
BILLION = 1_000_000_000

#: Bytes of terms, A-Z lower-cased; all others are white space.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), in long division so that nothing overflows."""
    rest, out = np.asarray(count, np.int64) + 2, 0
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        rest = rest - digit * total
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _share(count: Column, total: Column) -> Column:
    """``share`` as a Column."""
    rest, out = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        digit = F.call_function("div", rest * 1000, total)
        rest, out = rest * 1000 - digit * total, out * 1000 + digit
    return out + 1


# ---------------------------------------------------------------- counts
def group_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents that hold it; a group's null term counts its documents."""
    modest_batches(docs.sparkSession)

    def count(batches):
        held: dict[tuple, list] = {}
        size = 0

        def hand_on():
            rows = []
            for (lang_, source_), (rows_, n, docs_) in held.items():
                rows.append((lang_, source_, None, 0, rows_))
                rows += [(lang_, source_, t, c, docs_[t]) for t, c in n.items()]
            cols = zip(*rows, strict=True)
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(out, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang_, source_, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = t.translate(_TERM).split()
                got = held.setdefault((lang_, source_), [0, Counter(), Counter()])
                got[0] += 1
                size -= len(got[1])
                got[1].update(words)
                got[2].update(set(words))
                size += len(got[1])
                if size > HELD:
                    yield hand_on()
                    held.clear()
                    size = 0
        if held:
            yield hand_on()

    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))
    parts = rows.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return parts.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Counts:
    """Scratch tables of the audit: kept counts of groups, the groups, and the languages."""

    def __init__(self, docs: DataFrame, lang: str, source: str, text: str):
        counted = materialise(group_terms(docs, lang, source, text), "group_terms")
        kept = counted.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        kept = kept.filter(F.col("docs") >= LEAST_DOCS).drop("docs")
        kept = materialise(kept, "kept_terms")
        totals = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
        langs = counted.select("lang", "source").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
        langs = langs.join(totals, "lang", "left").fillna(0, ["v", "lang_total"])
        self.langs = materialise(langs, "langs")
        self.n_langs = self.langs.count()
        # Places of terms in chunks: the chunk by hash, the place within it by rank among its some CHUNK terms.
        chunks = F.greatest(F.lit(1), F.call_function("div", F.col("v"), F.lit(CHUNK).cast("long")))
        placed = lookup(kept, self.langs.select("lang", "v", "lang_total"), "lang", self.n_langs)
        placed = placed.withColumn("chunk", F.pmod(F.xxhash64("term"), chunks))
        placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
        self.terms = materialise(counted.filter("term IS NOT NULL").drop("docs").join(placed, ["lang", "term"]), "kept_counts")
        sums = self.terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counted.filter("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["total"])
        self.groups = materialise(_numbered(groups), "groups")


def _numbered(groups: DataFrame) -> DataFrame:
    """Groups with block and place: dealt to blocks by rank within hash parts, so that no task numbers a whole language."""
    parts = groups.withColumn("_part", F.pmod(F.xxhash64("source"), F.lit(64)))
    place = F.row_number().over(Window.partitionBy("lang", "_part").orderBy("source")) - 1
    sizes = parts.groupBy("lang", "_part").agg(F.count(F.lit(1)).alias("_n"))  # at most 64 rows a language
    first = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_first", first).drop("_n")
    numbered = parts.withColumn("_place", place).join(sizes, ["lang", "_part"]).withColumn("_place", F.col("_place") + F.col("_first"))
    return numbered.select("lang", "source", "total", F.floor(F.col("_place") / BLOCK).alias("block"), (F.col("_place") % BLOCK).cast("int").alias("g"))


# ---------------------------------------------------------------- pairs, by tiles
def tile_records(counts: Counts) -> DataFrame:
    """Packed records, each sent to all tiles of its block: names and totals of its groups (chunk -1), then counts by chunk."""
    keys = ["lang", "block"]
    member = F.struct("g", "source", "total")
    heads = counts.groups.groupBy(*keys).agg(F.collect_list(member).alias("members"))  # at most BLOCK
    heads = heads.withColumn("chunk", F.lit(-1).cast("long"))
    cells = counts.terms.join(counts.groups.select("lang", "source", "block", "g"), ["lang", "source"])
    cell = F.struct("g", "at", "n")
    packed = cells.groupBy(*keys, "chunk").agg(F.collect_list(cell).alias("cells"))  # at most BLOCK times a chunk's terms
    records = heads.unionByName(packed, allowMissingColumns=True)
    blocks = F.call_function("div", F.col("sources") + (BLOCK - 1), F.lit(BLOCK).cast("long"))
    wide = lookup(records, counts.langs.select("lang", "v", blocks.alias("blocks")), "lang", counts.n_langs)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    sent = wide.select("lang", "v", "block", "chunk", "members", "cells", other)
    return sent.select(
        "lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "chunk", "v", "members", "cells"
    )


def _dense(cells: pa.Array, places: np.ndarray) -> np.ndarray:
    """Counts of a block by its groups and the terms at ``places`` of a chunk."""
    out = np.zeros((BLOCK, len(places)), np.int64)
    if cells is not None:
        g, at, n = (x.to_numpy(zero_copy_only=False) for x in cells.flatten())
        out[g, np.searchsorted(places, at)] = n
    return out


class _Tile:
    """One pair of blocks: adds up its submatrix chunk by chunk."""

    def __init__(self, lang: str, i: int, j: int, v: int):
        self.lang, self.i, self.j, self.v = lang, i, j, v
        self.members: dict[int, list] = {}
        self.sums = np.zeros((BLOCK, BLOCK), np.int64)
        self.chunk, self.cells, self.seen = -1, {}, 0

    def take(self, block: int, chunk: int, members: list, cells: pa.Array) -> None:
        if chunk < 0:
            self.members[block] = members
            return
        if chunk != self.chunk:
            self._add()
            self.chunk = chunk
        self.cells[block] = cells

    def _totals(self, block: int) -> list[int]:
        totals = [1] * BLOCK  # of places without a group, which are not read
        for m in self.members[block]:
            totals[m["g"]] = m["total"] + 2 * self.v
        return totals

    def _shares(self, block: int, counts: np.ndarray) -> np.ndarray:
        return share(counts, np.array(self._totals(block), np.int64)[:, None])

    def _add(self) -> None:
        if not self.cells:
            return
        places = np.unique(np.concatenate([c.field("at").to_numpy(zero_copy_only=False) for c in self.cells.values()]))
        self.seen += len(places)
        p = self._shares(self.i, _dense(self.cells.get(self.i), places))
        q = p if self.i == self.j else self._shares(self.j, _dense(self.cells.get(self.j), places))
        for m in self.members[self.i]:
            self.sums[m["g"]] += divergence(p[m["g"]], q).sum(axis=1)
        self.cells = {}

    def rows(self) -> list[tuple]:
        self._add()
        if self.v > self.seen:  # terms that neither block has
            p, q = (self._shares(b, np.zeros((BLOCK, 1), np.int64)) for b in (self.i, self.j))
            self.sums += (self.v - self.seen) * divergence(p, q.T)
        out = []
        for a in self.members[self.i]:
            for b in self.members[self.j]:
                if self.i == self.j and a["g"] >= b["g"]:
                    continue
                value = int(self.sums[a["g"], b["g"]])
                out += [(self.lang, a["source"], b["source"], value), (self.lang, b["source"], a["source"], value)]
        return out


def pairs(counts: Counts) -> DataFrame:
    """(lang, source, item, value): divergence of every two sources of a language, both ways."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches):
        tile = None
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = zip(*[col[n].to_pylist() for n in ("lang", "i", "j", "v", "block", "chunk", "members")], strict=True)
            for at, (lang, i, j, v, block, chunk, members) in enumerate(keys):
                if tile is None or (tile.lang, tile.i, tile.j) != (lang, i, j):
                    if tile is not None:
                        yield from send(tile)
                    tile = _Tile(lang, i, j, v)
                tile.take(block, chunk, members, None if chunk < 0 else col["cells"].slice(at, 1).flatten())
        if tile is not None:
            yield from send(tile)

    def send(tile):
        rows = tile.rows()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    tiles = tile_records(counts).repartition("lang", "i", "j").sortWithinPartitions("lang", "i", "j", "chunk")
    return tiles.mapInArrow(run, "lang string, source string, item string, value long")


# ---------------------------------------------------------------- terms
def terms(counts: Counts) -> DataFrame:
    """(lang, source, item, value): kept terms of a group whose share is above the language's."""
    t = counts.terms.filter("n > 0").join(counts.groups.select("lang", "source", "total"), ["lang", "source"])
    p = _share(F.col("n"), F.col("total") + 2 * F.col("v"))
    q = _share(F.col("lang_n"), F.col("lang_total") + 2 * F.col("v"))
    t = t.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    return t.select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources of a language, and each group's ``TOP`` terms."""
    counts = Counts(docs, lang, source, text)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    cols = ["lang", "source", "part", "item", "value", "rank"]
    of_pairs = pairs(counts).select("*", F.lit("pair").alias("part"), rank)
    of_terms = terms(counts).select("*", F.lit("term").alias("part"), rank).filter(F.col("rank") <= TOP)
    return of_pairs.select(cols).unionByName(of_terms.select(cols))
