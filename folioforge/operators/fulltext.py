"""A persistent search index: search without reading the pages.

The index answers exactly what ``search.page_hits`` answers.  Its parts, below one folder:

* ``store``: pages in segments, cut into chunks of ``CHUNK`` pages: chunk, place, path, title, type, body.
* ``postings``: for each chunk and each run of two or three characters ("gram") of the lower-cased title and body, the
  pages that have it as differences, how often each has it, and whether its title does; in ``BUCKETS`` folders by gram.
  A gram's list in a chunk may come in parts.
* ``live``: path, signature, chunk and place of the current version of each page; published as a whole (``sinks.replace_table``).

A query's needles - its tokens and the query itself - are cut into grams too.  A page in the lists of all of a needle's grams may have the needle,
at most as often as the scarcest gram; that bounds its score.  The pages of the best bounds are fetched and scored; the k-th best score
is a floor, and only pages whose bound reaches it are fetched after that.  All others cannot be among the best, so nothing is lost.

Queries come as a table and are answered together: the lists of a chunk meet all queries (``BLOCK`` at a time) in one task, so a list is
moved once, however many needles and queries have its gram, and each query keeps a bounded number of pages a chunk in the first
round.  A needle is counted once in a page, and texts are left behind as soon as it is.

A Python worker's memory does not grow with the pages: it holds a batch of at most a thousand texts (Spark ends one at 64 MB),
``HELD`` grams and one page more, or the lists of a few chunks.  Small tables are made by SQL, because rows from the driver's Python
go through workers of another kind, which stay beside these.

``refresh`` adds a segment of what is new or changed by signature and publishes the new ``live``; what is gone or
was replaced stays in its segment, unreachable, until the index is built anew.  A refresh that fails leaves the old state.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions import paths
from folioforge.functions.query import search_tokens
from folioforge.functions.text import is_low_quality, occurrences
from folioforge.operators.search import SEARCH_LIMIT
from folioforge.operators.tables import BROADCAST_ROWS, materialise, modest_batches
from folioforge.sources.sinks import read_table, replace_table

#: Pages of a chunk, and folders of postings.
CHUNK, BUCKETS = 4096, 64
#: Grams of all queries that are put into the scan as a filter; beyond, they are joined.
FILTERED_GRAMS = 5_000
#: Queries that meet a chunk's lists in one task.
BLOCK = 512
#: Grams that a task holds before it makes lists of them.
HELD = 2_000_000
#: A third character that none is: marks a gram of two.
_PAIR = (1 << 21) - 1
#: So often or oftener: no bound is known.
_MANY = (1 << 15) - 1


def _low() -> Column:
    """What a page is searched by."""
    return F.lower(F.concat("title", F.lit(" "), "body"))


# ---------------------------------------------------------------- grams
def grams_of(text: str) -> np.ndarray:
    """The grams of a text at all places, 21 bits a character; those of two only where one of them is not ASCII."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    threes = c[:-2] << 42 | c[1:-1] << 21 | c[2:] if len(c) > 2 else c[:0]
    twos = (c[:-1] << 42 | c[1:] << 21 | _PAIR)[(c[:-1] > 127) | (c[1:] > 127)] if len(c) > 1 else c[:0]
    return np.concatenate([threes, twos])


def needle_grams(needle: str) -> np.ndarray | None:
    """Distinct grams that every text with the needle has; None if it is too short for any."""
    g = grams_of(needle)
    if len(needle) > 2:
        g = g[(g & _PAIR) != _PAIR]
    return np.unique(g) if len(g) else None


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


_STORED = "chunk long, at int, path string, title string, type string, body string, signature string"
_POSTED = "gram long, chunk long, pages binary, often binary"


def _numbered(pages: DataFrame, segment: int) -> DataFrame:
    """Pages with chunk and place, in the order in which the tasks read them."""

    def run(batches):
        first, at = (segment << 40) | (TaskContext.get().partitionId() << 16), 0
        for b in batches:
            place = np.arange(at, at + b.num_rows)
            at += b.num_rows
            cols = [pa.array(first + place // CHUNK), pa.array((place % CHUNK).astype(np.int32)), *b.columns]
            yield pa.RecordBatch.from_arrays(cols, names=["chunk", "at", *b.schema.names])

    return pages.select("path", "title", "type", "body", "signature").mapInArrow(run, _STORED)


def _posted(store: DataFrame) -> DataFrame:
    """The postings of stored pages: a task puts the lists of the pages that it reads together, ``HELD`` grams at a time.

    No page's grams are shuffled.  A chunk that two tasks read, or that has more grams, has its lists in parts.
    """

    def run(batches):
        held, size, now = [], 0, None
        for b in batches:
            for chunk, at, low, title in zip(*b.columns, strict=True):
                chunk = chunk.as_py()
                if held and (chunk != now or size >= HELD):
                    yield from lists(now, held)
                    held, size = [], 0
                now = chunk
                grams, often = np.unique(grams_of(low.as_py()), return_counts=True)
                titled = np.isin(grams, grams_of(title.as_py()))
                held.append((at.as_py(), grams, (np.minimum(often, _MANY) << 1 | titled).astype(np.uint16)))
                size += len(grams)
        if held:
            yield from lists(now, held)

    def lists(chunk, held):
        held.sort(key=lambda x: x[0])
        grams = np.concatenate([g for _, g, _ in held])
        at = np.repeat(np.array([x for x, _, _ in held], np.uint16), [len(g) for _, g, _ in held])
        often = np.concatenate([o for _, _, o in held])
        held.clear()
        order = np.argsort(grams, kind="stable")
        grams, at, often = grams[order], at[order], often[order]
        begins = np.append(True, grams[1:] != grams[:-1])[: len(grams)]
        step = np.where(begins, at, np.diff(at, prepend=np.uint16(0)))
        edges = np.append(np.flatnonzero(begins), len(grams))
        for lo in range(0, len(edges) - 1, 20_000):
            e = edges[lo : lo + 20_001]
            offsets = pa.py_buffer(((e - e[0]) * 2).astype(np.int32).tobytes())
            packed = [pa.Array.from_buffers(pa.binary(), len(e) - 1, [None, offsets, pa.py_buffer(x[e[0] : e[-1]].tobytes())]) for x in (step, often)]
            yield pa.RecordBatch.from_arrays([pa.array(grams[e[:-1]]), pa.array(np.full(len(e) - 1, chunk, np.int64)), *packed], names=["gram", "chunk", "pages", "often"])

    return store.select("chunk", "at", _low().alias("low"), F.lower("title").alias("t")).mapInArrow(run, _POSTED)


# ---------------------------------------------------------------- building and keeping
def signed(pages: DataFrame) -> DataFrame:
    """Pages that a search may return, with their signature: evidence paths, readable texts."""
    ok = paths.is_evidence(F.col("path")) & ~is_low_quality(F.col("title"), F.col("body"))
    kept = pages.filter(F.coalesce(ok, F.lit(False)) & F.col("title").isNotNull())
    return kept.select("path", "title", "type", "body", F.sha2(F.concat_ws("\x1f", "title", "type", "body"), 256).alias("signature"))


def _live(spark: SparkSession, root: str) -> DataFrame | None:
    return read_table(spark, f"{root}/live", missing_ok=True)


def refresh(pages: DataFrame, root: str) -> dict[str, int]:
    """Bring the index below ``root`` to ``pages`` (one row a path); numbers of pages added, changed, removed and kept.

    ``pages`` are read twice, for their signatures and for the texts of what is new: no copy of all texts is made to compare
    them.  A page that changes in between has the signature of the text that is indexed.
    """
    spark = pages.sparkSession
    modest_batches(spark)
    old = _live(spark, root)
    if old is None:
        old = spark.sql("SELECT '' AS path, '' AS signature, 0L AS chunk, 0 AS at WHERE false")
    known = old.select("path", F.col("signature").alias("_old"), "chunk", "at")
    both = signed(pages).select("path", "signature").join(known, "path", "full_outer")
    same = F.col("signature").eqNullSafe(F.col("_old"))
    kind = F.when(F.col("signature").isNull(), "removed").when(F.col("_old").isNull(), "added").when(same, "kept").otherwise("changed")
    both = materialise(both.withColumn("kind", kind), "compared")
    counts = {r["kind"]: r["count"] for r in both.groupBy("kind").count().collect()}
    live = both.filter("kind = 'kept'").select("path", "signature", "chunk", "at")
    if counts.get("added", 0) + counts.get("changed", 0):
        # A segment has a folder of its own, named by it only once it is whole.
        segment = (old.agg(F.coalesce(F.max(F.shiftright("chunk", 40)), F.lit(0)).alias("n")).first().n or 0) + 1
        name = f"{segment}-{uuid.uuid4().hex}"
        new, kept = signed(pages), both.filter("kind = 'kept'").select("path")
        if 0 < counts.get("kept", 0) <= BROADCAST_ROWS:
            new = new.join(F.broadcast(kept), "path", "left_anti")
        elif counts.get("kept", 0):
            told = both.filter("kind IN ('added', 'changed')").select("path")
            few = counts.get("added", 0) + counts.get("changed", 0) <= BROADCAST_ROWS
            new = new.join(F.broadcast(told) if few else told, "path", "left_semi")
        small = {"compression": "zstd", "parquet.block.size": str(8 << 20)}
        _numbered(new, segment).write.options(**small).parquet(f"{root}/store/{name}")
        stored = spark.read.schema(_STORED).parquet(f"{root}/store/{name}")
        posted = _posted(stored).withColumn("bucket", _bucket(F.col("gram")))
        posted.repartition("bucket").sortWithinPartitions("bucket", "gram").write.options(**small).partitionBy("bucket").parquet(f"{root}/postings/{name}")
        live = live.unionByName(stored.select("path", "signature", "chunk", "at"))
        _add_segment(spark, root, name)
    replace_table(live, f"{root}/live")
    return {k: counts.get(k, 0) for k in ("added", "changed", "removed", "kept")}


def _add_segment(spark: SparkSession, root: str, name: str) -> None:
    have = read_table(spark, f"{root}/segments", missing_ok=True)
    one = spark.sql("SELECT :name AS segment", {"name": name})
    replace_table(one if have is None else have.unionByName(one), f"{root}/segments")


def _parts(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame | None:
    segments = read_table(spark, f"{root}/segments", missing_ok=True)
    names = [r.segment for r in segments.collect()] if segments is not None else []  # a row a refresh
    out = None
    for n in names:
        part = spark.read.schema(schema).parquet(f"{root}/{kind}/{n}")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- searching
_NEEDLES = "query long, needle string, weight long, whole boolean"


def needles(queries: DataFrame) -> DataFrame:
    """(query, needle, weight, whole) of a table (query, text): tokens by length, and the query itself with its bonus."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, text in zip(pdf["query"], pdf["text"], strict=True):
                if not text:
                    continue
                tokens, whole = search_tokens(text), text.strip().lower()
                rows += [(key, t, min(6, max(2, len(t))), False) for t in tokens]
                if whole:
                    rows.append((key, whole, max(12, 2 * len(whole)) if tokens else 1, True))
            yield pd.DataFrame(rows, columns=["query", "needle", "weight", "whole"])

    return queries.select("query", "text").mapInPandas(run, _NEEDLES)


def _gram_rows(needed: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [g for n in b.column(0).to_pylist() for g in needle_grams(n)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(found))], names=["gram"])

    return needed.select("needle").distinct().mapInArrow(run, "gram long").distinct()


def _candidates(lists: DataFrame, asked: DataFrame, chunks: int, limit: int) -> DataFrame:
    """(query, chunk, at, bound): of each chunk a query's ``limit`` best bounds, or all that reach the query's ``floor``.

    The lists of a chunk and a block of queries with their needles meet in one task.
    """

    def run(_, found, needles):
        needles = needles.combine_chunks()
        wanted = dict.fromkeys(needles.column("needle").to_pylist())
        rows = list(zip(*[needles.column(c).to_pylist() for c in ("query", "needle", "weight", "whole", "floor")], strict=True))
        rows.sort(key=lambda r: r[0])
        out = [[], [], [], []]
        gram_col, chunk_col = found.column("gram").to_numpy(), found.column("chunk").to_numpy()
        pages_col, often_col = found.column("pages").combine_chunks(), found.column("often").combine_chunks()
        often_at = np.zeros(CHUNK, np.int64)
        title_at = np.zeros(CHUNK, bool)

        def read(parts):
            got = [(np.cumsum(np.frombuffer(pages_col[i].as_buffer(), np.uint16), dtype=np.uint16), np.frombuffer(often_col[i].as_buffer(), np.uint16)) for i in parts]
            return got[0] if len(got) == 1 else tuple(map(np.concatenate, zip(*got, strict=True)))

        def bound(needle, where):
            """Pages that may have the needle, at most how often, and whether their title may; the shortest list first."""
            parts = [where.get(g) for g in needle_grams(needle).tolist()]
            if None in parts:
                return None
            pages = most = titled = None
            for pages_, often_ in sorted(map(read, parts), key=lambda x: len(x[0])):
                often, title = (often_ >> 1).astype(np.int64), (often_ & 1).astype(bool)
                often[often == _MANY] = 1 << 31
                if pages is None:
                    pages, most, titled = pages_, often, title
                    continue
                often_at[pages_], title_at[pages_] = often, title
                most, titled = np.minimum(most, often_at[pages]), titled & title_at[pages]
                often_at[pages_], title_at[pages_] = 0, False
                keep = most > 0
                pages, most, titled = pages[keep], most[keep], titled[keep]
                if not len(pages):
                    return None
            return pages, most.astype(np.uint32), titled

        for chunk in np.unique(chunk_col):
            where: dict[int, list[int]] = {}
            for i in np.flatnonzero(chunk_col == chunk).tolist():
                where.setdefault(int(gram_col[i]), []).append(i)
            bounds = {n: bound(n, where) for n in wanted}
            for at, (query, *_, floor) in enumerate(rows):
                if at and rows[at - 1][0] == query:
                    continue
                sums = np.zeros(CHUNK, np.int64)
                for i in range(at, len(rows)):
                    if rows[i][0] != query:
                        break
                    if (b := bounds[rows[i][1]]) is not None:
                        sums[b[0]] += rows[i][2] if rows[i][3] else rows[i][2] * b[1].astype(np.int64) * (1 + 3 * b[2])
                if floor:
                    best = np.flatnonzero(sums >= floor)
                else:
                    best = np.argsort(-sums, kind="stable")[:limit]
                    best = best[sums[best] > 0]
                for to, x in zip(out, (np.full(len(best), query), np.full(len(best), chunk), best, sums[best]), strict=True):
                    to.append(x)
        kinds = (np.int64, np.int64, np.int32, np.int64)
        cols = [np.concatenate(x).astype(t) if x else np.zeros(0, t) for x, t in zip(out, kinds, strict=True)]
        return pa.table([pa.array(c) for c in cols], names=["query", "chunk", "at", "bound"])

    blocks = -(-asked.select("query").distinct().count() // BLOCK) or 1
    block, part = F.pmod(F.xxhash64("query"), F.lit(blocks)), F.pmod(F.xxhash64("chunk"), F.lit(chunks))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    lists = lists.withColumn("part", part).withColumn("block", numbers(blocks))
    asked = asked.withColumn("block", block).withColumn("part", numbers(chunks))
    return lists.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(run, "query long, chunk long, at int, bound long")


def _stored(found: DataFrame, store: DataFrame, live: DataFrame) -> DataFrame:
    """The live pages at the (chunk, at) of ``found``; only their chunks' row groups are read, and few pages are found without a shuffle."""
    keys = found.select("chunk", "at").distinct()
    chunks = [r.chunk for r in keys.select("chunk").distinct().limit(FILTERED_GRAMS + 1).collect()]
    if len(chunks) <= FILTERED_GRAMS:
        store, live = store.filter(F.col("chunk").isin(chunks)), live.filter(F.col("chunk").isin(chunks))
    live = live.select("chunk", "at")
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        live = F.broadcast(live.join(F.broadcast(keys), ["chunk", "at"], "left_semi"))
    else:
        live = live.join(keys, ["chunk", "at"], "left_semi")
    return store.drop("signature").join(live, ["chunk", "at"])


def _scored(found: DataFrame, store: DataFrame, live: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, chunk, at, path, score): exact scores of found pages, those of former versions left out.

    A page's needles are counted once for all queries that found it.
    """
    pairs = found.select("query", "chunk", "at").join(asked.select("query", "needle", "weight", "whole"), "query")
    each = pairs.groupBy("chunk", "at").agg(F.collect_set("needle").alias("needles"))  # a page's: those of all queries at most
    # Dealt out by number, or the few pages that are found would be counted in one task.
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = _stored(found, store, live).select("chunk", "at", "path", "title", "body").repartition(tasks, "chunk", "at").join(each, ["chunk", "at"])
    pages = pages.select("chunk", "at", "path", F.lower("title").alias("_title"), _low().alias("_low"), "needles")
    # The explosion stands between: a text is lower-cased once, not once a needle.
    rows = pages.select("chunk", "at", "path", "_title", "_low", F.explode("needles").alias("needle"))
    often = occurrences(F.col("_low"), F.col("needle")).alias("often")
    counts = rows.select("chunk", "at", "path", "needle", often, F.col("_title").contains(F.col("needle")).alias("titled")).filter("often > 0")
    points = F.when(F.col("whole"), F.col("weight")).otherwise(F.col("often") * F.col("weight") * F.when(F.col("titled"), F.lit(4)).otherwise(F.lit(1)))
    return pairs.join(counts, ["chunk", "at", "needle"]).groupBy("query", "chunk", "at", "path").agg(F.sum(points).alias("score")).filter("score > 0")


def search_all(root: str, queries: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The best ``limit`` pages of every query of a table (query, text): (query, place, path, title, type, score, body).

    A query too short to have a gram (one character, or two of ASCII) is answered by scoring all live pages.
    """
    spark = queries.sparkSession
    modest_batches(spark)
    asked = materialise(needles(queries), "needles")
    live, store = _live(spark, root), _parts(spark, root, "store", _STORED)
    postings = _parts(spark, root, "postings", f"{_POSTED}, bucket int")
    if postings is None:
        return spark.createDataFrame([], "query long, place long, path string, title string, type string, score long, body string")
    short = (F.length("needle") < 2) | ((F.length("needle") == 2) & ~F.col("needle").rlike("[^\\x00-\\x7F]"))
    long = asked.filter(~short)
    grams = materialise(_gram_rows(long).withColumn("bucket", _bucket(F.col("gram"))), "grams")
    few = grams.limit(FILTERED_GRAMS + 1).collect()
    if len(few) <= FILTERED_GRAMS:
        lists = postings.filter(F.col("bucket").isin(sorted({r.bucket for r in few})) & F.col("gram").isin([r.gram for r in few])).drop("bucket")
    else:
        lists = postings.drop("bucket").join(grams.select("gram"), "gram", "left_semi")
    chunks = live.select("chunk").distinct().count() or 1
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "chunk", "at"))
    first = _candidates(lists, long.withColumn("floor", F.lit(0).cast("long")), chunks, 2 * limit)
    first = materialise(first.withColumn("_r", rank).filter(F.col("_r") <= 2 * limit).drop("_r"), "first")
    first = materialise(_scored(first, store, live, asked), "scored")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "path")
    floors = first.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == limit).select("query", F.col("score").alias("floor"))
    floors = long.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long")))
    rest = _candidates(lists, floors, chunks, limit).join(first.select("query", "chunk", "at"), ["query", "chunk", "at"], "left_anti")
    every = first.unionByName(_scored(materialise(rest, "rest"), store, live, asked))
    tiny = [r.query for r in asked.filter(short).select("query").distinct().limit(limit + 1).collect()]
    if len(tiny) > limit:
        raise ValueError(f"at most {limit} queries without a gram are answered at once")
    if tiny:
        all_live = live.select(F.explode(F.array(*map(F.lit, tiny))).alias("query"), "chunk", "at")
        every = every.join(spark.createDataFrame([(q,) for q in tiny], "query long"), "query", "left_anti")
        every = every.unionByName(_scored(materialise(all_live, "all"), store, live, asked))
    top = materialise(every.withColumn("place", F.row_number().over(best).cast("long")).filter(F.col("place") <= limit), "top")
    return top.drop("path").join(_stored(top, store, live), ["chunk", "at"]).select("query", "place", "path", "title", "type", "score", "body")
