"""Benchmark decontamination by a prefix-filtered set join with exact verification.

A benchmark item yields windows of ``WINDOW`` consecutive words (an item of fewer words is one window).
A window's tokens are its word shingles of ``SHINGLE`` words, ordered by rarity: how often each occurs in
the whole corpus.  Since a window must be contained entirely, its necessary prefix is one token, the
rarest; a document is looked at only where that token occurs.  There the positional bound fixes where the
window would start, the length bound asks that it fits into the document, and all its words are compared.

Two passes over the documents, whatever the benchmark's size: counts of benchmark tokens (a Bloom filter of bounded
size finds them, an aggregation counts them), then the join.  Documents are never shuffled.  Windows with a token that
no document has are left out.  The others are broadcast in blocks of about ``BLOCK_WINDOWS``; a worker that has several
takes ``BUFFER_BYTES`` of text at a time and loads one block after the other, so a large benchmark costs it more
look-ups and no more memory.  The driver holds one block at a time, too.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; they are compared by 64-bit
hashes of their bytes.  Null and empty text has no words and is clean; long texts are scanned whole.  Each row is judged
by itself, so ties and repeated rows need no rule.  Items without words have no windows; long items have all of theirs.
Items of one id count once, a null id is the empty string.  With an empty benchmark all documents are clean.  Other
columns pass through ``clean`` unchanged and are not read by ``annotate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm import bytescan
from folioforge.llm.shared import bloom_of, materialise, modest_batches

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 200_000
#: Text that a worker holds while it goes through several blocks.
BUFFER_BYTES = 32 << 20
_SLICE = 1 << 20


def _tokens(words: np.ndarray) -> np.ndarray:
    """The tokens of windows (rows of word hashes), by their place in the window."""
    k = min(SHINGLE, words.shape[1])
    return np.stack([bytescan.combine([words[:, i + j] for j in range(k)]) for i in range(words.shape[1] - k + 1)], 1)


class Block:
    """Windows by length: their words, items, and prefix tokens with the places they have."""

    def __init__(self, rows: pa.Table):
        """``rows``: words (hashes as bytes), items, shift and token of each window."""
        sizes = np.array([len(w) // 8 for w in rows["words"].to_pylist()], np.int64)
        self.tables, names = [], {}
        for n in np.unique(sizes).tolist():
            some = rows.take(pa.array(np.flatnonzero(sizes == n)))
            words = np.frombuffer(b"".join(some["words"].to_pylist()), np.uint64).reshape(-1, n)
            runs = [[names.setdefault(x, len(names)) for x in items] for items in some["items"].to_pylist()]
            token, shift = some["token"].to_numpy().view(np.uint64), some["shift"].to_numpy()
            by = np.argsort(token, kind="stable")
            distinct, first = np.unique(token[by], return_index=True)
            self.tables.append({
                "n": n, "k": min(SHINGLE, n), "words": words, "item": np.array([x for r in runs for x in r], np.int64), "ends": np.cumsum([0, *map(len, runs)]),
                "token": distinct, "window": by, "shift": shift[by], "runs": np.append(first, len(by)), "maybe": _maybe(distinct),
            })
        self.items = list(names)


def _maybe(sorted_hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(sorted_hashes >> np.uint64(44)).astype(np.int64)] = True
    return bits


def _find(hashes: np.ndarray, table: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``hashes``, indexes in sorted ``table``) of equal values."""
    at = np.flatnonzero(maybe[(hashes >> np.uint64(44)).astype(np.int64)])
    i = np.searchsorted(table, hashes[at])
    i[i == len(table)] = 0
    same = table[i] == hashes[at]
    return at[same], i[same]


def _hits(words: bytescan.Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Verified occurrences: (start word, length, document, item runs as (document, item) pairs)."""
    starts, lengths, pairs = [], [], []
    of, hashes = words.of, words.hash
    for t in block.tables:
        n, k = t["n"], t["k"]
        shingles = words.shingles(k)
        at, i = _find(shingles, t["token"], t["maybe"])
        if not len(at):
            continue
        count = t["runs"][i + 1] - t["runs"][i]
        total = np.concatenate([[0], np.cumsum(count)])
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, total[a] + _SLICE, "right")) - 1)
            c = count[a:b]
            e = np.repeat(t["runs"][i[a:b]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            w, start = t["window"][e], np.repeat(at[a:b], c) - t["shift"][e]
            doc = np.searchsorted(of, np.repeat(at[a:b], c), "right") - 1
            fits = (start >= of[doc]) & (start + n <= of[doc + 1])
            w, start, doc = w[fits], start[fits], doc[fits]
            for j in range(n):
                same = hashes[start + j] == t["words"][w, j]
                w, start, doc = w[same], start[same], doc[same]
            starts.append(start)
            lengths.append(np.full(len(start), n))
            dw = np.unique(np.stack([doc, w], 1), axis=0)
            c = t["ends"][dw[:, 1] + 1] - t["ends"][dw[:, 1]]
            e = np.repeat(t["ends"][dw[:, 1]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            pairs.append(np.unique(np.stack([np.repeat(dw[:, 0], c), t["item"][e]], 1), axis=0))
            a = b
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(pairs), axis=0)
    return np.concatenate(starts), np.concatenate(lengths), pairs[:, 0], pairs[:, 1]


def scan(texts: pa.Array, blocks: list) -> Iterator[tuple[int, int, set]]:
    """(n_words, n_hit, item ids) of each text; blocks are loaded one at a time."""
    parts = [bytescan.Words(buf, offs, bytescan.ALNUM) for _, _, buf, offs in bytescan.chunks(texts)]
    edges = [np.zeros(len(w.hash) + 1, np.int64) for w in parts]
    items: list[list[set]] = [[set() for _ in range(len(w.of) - 1)] for w in parts]
    for held in blocks:
        block = held.value
        for words, edge, found in zip(parts, edges, items, strict=True):
            start, length, doc, item = _hits(words, block)
            np.add.at(edge, start, 1)
            np.subtract.at(edge, start + length, 1)
            for d, x in zip(doc.tolist(), item.tolist(), strict=True):
                found[d].add(block.items[x])
        if len(blocks) > 1:
            del block
            vars(held).pop("_value", None)  # a broadcast keeps what it has loaded
    for words, edge, found in zip(parts, edges, items, strict=True):
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        yield from zip(np.diff(words.of).tolist(), np.diff(hit[words.of]).tolist(), found, strict=True)


def _buffers(batches, blocks: list) -> Iterator[pa.RecordBatch]:
    """Batches one by one; where there are several blocks, joined up to ``BUFFER_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if len(blocks) < 2 or size >= BUFFER_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(words, items): the distinct windows of the benchmark, as the bytes of their word hashes."""

    def cut(batches):
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                words = bytescan.Words(*next(iter(bytescan.chunks(pa.array([value.as_py()], pa.string()))))[2:], bytescan.ALNUM).hash
                n = min(WINDOW, len(words))
                every = np.lib.stride_tricks.sliding_window_view(words, n) if n else words.reshape(0, 1)
                for a in range(0, len(every), BLOCK_WINDOWS):
                    some = np.unique(every[a : a + BLOCK_WINDOWS], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in some], pa.binary()), pa.array([name] * len(some), pa.string())], ["words", "item"])

    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")), F.col(f"`{text}`"))
    return rows.mapInArrow(cut, "words binary, item string").groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _window_tokens(windows: DataFrame) -> DataFrame:
    """(words, shift, token) of every window."""

    def cut(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            sizes = np.array([len(w) // 8 for w in words], np.int64)
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                tokens = _tokens(np.frombuffer(b"".join(words[i] for i in at), np.uint64).reshape(-1, n))
                many = tokens.shape[1]
                cols = [batch.column(0).take(pa.array(np.repeat(at, many))), np.tile(np.arange(many, dtype=np.int32), len(at)), tokens.ravel().view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["words", "shift", "token"])

    return windows.select("words").mapInArrow(cut, "words binary, shift int, token long")


def token_counts(docs: DataFrame, text: str, tokens: DataFrame, widths: list[int]) -> DataFrame:
    """(token, n): how often the tokens occur in all documents, in one scan for all of them."""
    held = docs.sparkSession.sparkContext.broadcast(bloom_of(tokens, "token", tokens.count()))

    def count(batches):
        for batch in batches:
            for _, _, buf, offs in bytescan.chunks(batch.column(0)):
                words = bytescan.Words(buf, offs, bytescan.ALNUM)
                found = [np.zeros(0, np.uint64)]
                for k in widths:
                    s = words.shingles(k)
                    at = np.flatnonzero(held.value.has(s))
                    at = at[at + k <= words.of[np.searchsorted(words.of, at, "right")]]  # within one document
                    found.append(s[at])
                token, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def index(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> list:
    """The benchmark's windows by prefix token, the rarest (ties: the smallest hash), as broadcast blocks of bounded size."""
    spark = docs.sparkSession
    modest_batches(spark)
    every = materialise(windows(benchmark, item, item_text), "windows")
    widths = [r[0] for r in every.select(F.least(F.lit(SHINGLE), F.octet_length("words") / 8).cast("int").alias("k")).distinct().collect()]  # 1 to SHINGLE
    if not widths:
        return []
    tokens = materialise(_window_tokens(every), "tokens")
    counts = token_counts(docs, text, tokens.select("token").distinct(), widths)
    seen = tokens.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = seen.groupBy("words").agg(F.min(F.struct("n", "token", "shift")).alias("p")).filter("p.n > 0")
    chosen = materialise(every.join(first, "words").select("words", "items", "p.shift", "p.token"), "prefixes")
    blocks = -(-chosen.count() // BLOCK_WINDOWS)
    out = []
    for i in range(blocks):
        rows = chosen.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == i).toArrow()
        out.append(spark.sparkContext.broadcast(Block(rows)))
        if blocks > 1:
            vars(out[-1]).pop("_value", None)  # the driver's copy is on disk
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every document; ``items`` sorted as strings."""
    blocks = index(docs, benchmark, text)

    def run(batches):
        for batch in _buffers(batches, blocks):
            n_words, n_hit, items = [], [], []
            for w, h, x in scan(batch.column(1), blocks):
                n_words.append(w)
                n_hit.append(h)
                items.append(sorted(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "items"],
            )

    kind = docs.schema[doc_id].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]
    )
    return docs.select(f"`{doc_id}`", f"`{text}`").mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    blocks = index(docs, benchmark, text)
    at = docs.columns.index(text)

    def run(batches):
        for batch in _buffers(batches, blocks):
            keep = [h == 0 for _, h, _ in scan(batch.column(at), blocks)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

