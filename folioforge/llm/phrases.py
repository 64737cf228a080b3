"""Exact removal of repeated byte strings, by prefix-free parsing.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else in the corpus is removed;
strings never cross texts and are judged on the input.

Prefix-free parsing turns a repetitive corpus into a dictionary of distinct phrases and a parse, the sequence of phrases
of each text; suffix arrays of both give the order of the corpus's suffixes.  Here suffixes are compared by their first
``LENGTH`` bytes, which is what the task asks for: strings that occur again are neighbours of one rank in that order.

A trigger is the smallest rolling hash of ``GRAM`` bytes (rightmost on ties) among the first ``SPAN`` positions of a
``LENGTH``-byte window.  So each window has exactly one trigger, chosen by nothing but its own bytes, equal windows have
theirs at the same offset, and consecutive windows share theirs: the windows of one trigger and the bytes they cover are
a phrase.  Neighbouring phrases overlap, so every window lies in one phrase as a whole.

1. Parse: each trigger's core, the bytes from it that all its possible windows share, is counted over the
   corpus.  A core seen once rules out all its windows; this is where most text ends.
2. Suffix array of the parse: since a phrase covers its windows, its suffixes need to be compared by their first phrase
   only.  In that order the occurrences of a phrase stand together, and a phrase seen twice repeats as a whole.  So does
   every core with a single phrase, by definition.
3. Suffix array of the dictionary: only where a core has several phrases can single windows repeat in part, at the two
   ends of a match.  Equal windows have equal cores, so the distinct phrases of cores are dealt out by core, and each
   task builds the suffix arrays of its share by prefix doubling (``bytescan.suffix_array``), cut into groups of cores.
   Windows of one rank there are equal.  A core of over ``HOT_PHRASES`` phrases, too much for one task, has its windows
   counted by hash instead; the result is the same.
4. Combined: runs of repeated windows are joined back to the texts that the parse has them in, and the bytes cut.

Windows that no phrase order needs to tell apart are never sorted; the order of cores among each other would not change
what is equal, so it is not built.  Cores and phrases are named by 64-bit hashes of their bytes.

Null text is empty.  Texts under ``LENGTH`` bytes keep everything, long ones are parsed whole.  Repeated rows are
separate texts, so each loses what they share.  Rows of equal doc_id are told apart by a hash of their text.  An empty
table gives an empty result.  doc_id must be of an integer type; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import bytescan
from folioforge.llm.shared import Bloom, bloom_of, discard, integral, materialise, modest_batches

LENGTH = 200
GRAM = 16
SPAN = 84
#: Cores of more phrases are counted by window, not in one task.
HOT_PHRASES = 50_000
#: Bytes of phrases that one suffix array is built of; a core is never split.
FLUSH_BYTES = 3 << 19


def _window_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by block prefixes and suffixes."""
    n = len(key)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Phrases:
    """The phrases of a chunk of texts: ``row``, ``lo``/``hi`` (first and last window start), ``at`` (trigger)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int):
        self.length, self.core_bytes = length, length - SPAN + 1
        self.total, grams = bytescan.rolling(buf, GRAM)
        windows = len(buf) - length + 1
        self.lo = self.hi = self.at = self.row = np.zeros(0, np.int64)
        if windows <= 0:
            return
        # Hash above, inverted position below: the minimum is the smallest hash, rightmost on ties.
        low = np.uint64((1 << 31) - 1)
        place = np.arange(len(grams), dtype=np.uint64)
        best = _window_min((grams & ~low) | (low - place), SPAN)[:windows]
        trigger = (low - (best & low)).astype(np.int64)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:windows]
        inside = np.arange(windows) + length <= offs[row + 1]
        first = np.ones(windows, bool)
        first[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
        first &= inside
        self.lo = np.flatnonzero(first)
        last = np.ones(windows, bool)
        last[:-1] = first[1:] | ~inside[1:]
        last &= inside
        self.hi = np.flatnonzero(last)
        self.at, self.row = trigger[self.lo], row[self.lo]

    def cores(self) -> np.ndarray:
        return bytescan.piece(self.total, self.at, self.at + self.core_bytes)

    def contents(self, some: np.ndarray) -> np.ndarray:
        """Hash of the phrase's bytes and of where its trigger and its windows are."""
        lo, hi = self.lo[some], self.hi[some]
        h = bytescan.piece(self.total, lo, hi + self.length)
        return bytescan.combine([h, (self.at[some] - lo).astype(np.uint64), (hi - lo).astype(np.uint64)])


def _phrases(texts: pa.Array, length: int):
    for a, _, buf, offs in bytescan.chunks(texts):
        yield a, offs, Phrases(buf, offs, length)


def _core_counts(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, _, p in _phrases(batch.column(0), length):
                core, n = np.unique(p.cores(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(n)], ["core", "n"])

    counts = docs.select("text").mapInArrow(run, "core long, n long").groupBy("core").agg(F.sum("n").alias("n"))
    return counts.filter("n > 1").select("core")


def _parse(docs: DataFrame, cores: Bloom, length: int) -> DataFrame:
    """(doc_id, h, core, phrase, lo, n): the phrases whose core may repeat; lo: first window, n: windows."""
    held = docs.sparkSession.sparkContext.broadcast(cores)

    def run(batches):
        for batch in batches:
            for a, offs, p in _phrases(batch.column(2), length):
                core = p.cores()
                some = np.flatnonzero(held.value.has(core))
                row = p.row[some]
                take = pa.array(a + row)
                cols = [core[some].view(np.int64), p.contents(some).view(np.int64), p.lo[some] - offs[row], (p.hi - p.lo)[some].astype(np.int32) + np.int32(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, cols)], ["doc_id", "h", "core", "phrase", "lo", "n"]
                )

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, core long, phrase long, lo long, n int")


def _covers(docs: DataFrame, cores: Bloom, length: int) -> DataFrame:
    """(core, phrase, cover): the bytes of the phrases whose core may be wanted, once for each task."""
    held = docs.sparkSession.sparkContext.broadcast(cores)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for a, b, buf, offs in bytescan.chunks(batch.column(0)):
                p = Phrases(buf, offs, length)
                core = p.cores()
                some = np.flatnonzero(held.value.has(core))
                at, names, covers = [], [], []
                for i, name in zip(some.tolist(), p.contents(some).tolist(), strict=True):
                    if name not in seen:
                        seen.add(name)
                        at.append(i)
                        names.append(name)
                        covers.append(buf[p.lo[i] : p.hi[i] + length].tobytes())
                if at:
                    cols = [core[at].view(np.int64), np.array(names, np.uint64).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(covers, pa.binary())], ["core", "phrase", "cover"])

    return docs.select("text").mapInArrow(run, "core long, phrase long, cover binary")


def _windows(cover: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the phrases one after the other; phrase, index in it and place in the bytes of every window)."""
    sizes = np.array([len(c) for c in cover])
    n = sizes - length + 1
    row = np.repeat(np.arange(len(cover)), n)
    index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(b"".join(cover), np.uint8), row, index, np.repeat(np.cumsum(sizes) - sizes, n) + index


def _partial(covers: DataFrame, length: int) -> DataFrame:
    """(phrase, some): the windows of each phrase that another phrase of its core, or another place in it, has."""

    def flush(core, phrase, cover):
        phrase, first = np.unique(np.array(phrase, np.int64), return_index=True)
        data, row, index, start = _windows([cover[i] for i in first], length)
        order, rank = bytescan.suffix_array(data, start, length)
        alike = rank[1:] == rank[:-1]
        again = np.zeros(len(start), bool)
        again[order[1:][alike]] = again[order[:-1][alike]] = True
        row, index = row[again], index[again].astype(np.int32)
        has, start = np.unique(row, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(index))
        return pa.RecordBatch.from_arrays([pa.array(phrase[has]), lists], ["phrase", "some"])

    def run(batches):
        core, phrase, cover, held = [], [], [], 0
        for batch in batches:
            for c, p, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held > FLUSH_BYTES and c != core[-1]:
                    yield flush(core, phrase, cover)
                    core, phrase, cover, held = [], [], [], 0
                core.append(c)
                phrase.append(p)
                cover.append(x)
                held += len(x)
        if core:
            yield flush(core, phrase, cover)

    # A phrase comes from every task that saw it; one copy of each goes to its core's task.
    once = covers.dropDuplicates(["core", "phrase"])
    return once.repartition("core").sortWithinPartitions("core").mapInArrow(run, "phrase long, some array<int>")


def _partial_hot(covers: DataFrame, length: int) -> DataFrame:
    """The same by a sum over windows, for cores of more phrases than one task should hold."""

    def run(batches):
        for batch in batches:
            phrase, cover = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            data, row, index, start = _windows(cover, length)
            w = bytescan.piece(bytescan.rolling(data, length)[0], start, start + length)
            yield pa.RecordBatch.from_arrays([pa.array(phrase[row]), pa.array(index.astype(np.int32)), pa.array(w.view(np.int64))], ["phrase", "i", "w"])

    windows = covers.select("phrase", "cover").dropDuplicates(["phrase"]).mapInArrow(run, "phrase long, i int, w long")
    windows = materialise(windows, "windows")
    again = windows.groupBy("w").count().filter("count > 1").select("w")
    return windows.join(again, "w", "left_semi").groupBy("phrase").agg(F.sort_array(F.collect_list("i")).alias("some"))


def repeats(docs: DataFrame, length: int = LENGTH, hot_phrases: int = HOT_PHRASES) -> DataFrame:
    """(doc_id, h, lo, n): runs of ``n`` repeated windows from byte ``lo``; ``docs`` has doc_id, h, text."""
    cores = materialise(_core_counts(docs, length), "cores")
    parse = materialise(_parse(docs, bloom_of(cores, "core", cores.count()), length), "parse")
    discard(cores)
    counts = materialise(parse.groupBy("core", "phrase").agg(F.count(F.lit(1)).alias("c")), "dictionary")
    whole = counts.filter("c > 1").select("phrase")
    # Only cores of several phrases can have windows that repeat though their phrase does not.
    mixed = materialise(counts.groupBy("core").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "mixed")
    covers = _covers(docs, bloom_of(mixed, "core", mixed.count()), length)
    hot = mixed.filter(F.col("k") > hot_phrases).select("core")
    if hot.isEmpty():
        part = _partial(covers, length)
    else:
        covers = materialise(covers, "covers")
        part = _partial(covers.join(hot, "core", "left_anti"), length)
        part = part.unionByName(_partial_hot(covers.join(hot, "core", "left_semi"), length))
    part = part.join(whole, "phrase", "left_anti")
    runs = materialise(part.unionByName(whole.withColumn("some", F.lit(None).cast("array<int>"))), "runs")
    discard(counts, mixed)
    out = parse.join(runs, "phrase").select("doc_id", "h", "lo", "n", "some")
    starts = F.filter("some", lambda x, k: (k == 0) | (F.get("some", k - 1) != x - 1))
    ends = F.filter("some", lambda x, k: F.coalesce(F.get("some", k + 1) != x + 1, F.lit(True)))
    pieces = F.when(F.col("some").isNull(), F.array(F.struct(F.col("lo").alias("a"), (F.col("lo") + F.col("n")).alias("b")))).otherwise(
        F.zip_with(starts, ends, lambda a, b: F.struct((F.col("lo") + a).alias("a"), (F.col("lo") + b + 1).alias("b")))
    )
    return out.select("doc_id", "h", F.explode(pieces).alias("p")).select("doc_id", "h", F.col("p.a").alias("lo"), (F.col("p.b") - F.col("p.a")).alias("n"))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(integral(docs, doc_id), F.xxhash64(f"`{text}`").alias("h"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def remove(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what remains of every text, as bytes."""
    modest_batches(docs.sparkSession)
    rows = keyed(docs, doc_id, text)
    found = repeats(rows, length)
    # Runs of one text as one sorted array; a text's runs are bounded by its length.
    spans = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("lo", "n"))).alias("runs"))
    spans = materialise(spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h"), "spans")
    both = rows.join(spans, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "runs.lo", "runs.n")

    def cut(batches):
        for batch in batches:
            size, removed, n_spans, kept = [], [], [], []
            for t, lo, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = t.encode()
                size.append(len(data))
                out, at, gone, k = [], 0, 0, 0
                end = -1
                for a, m in zip(lo or (), n or (), strict=True):
                    b = a + m - 1 + length
                    if a > end:
                        k += 1
                        out.append(data[at:a])
                    gone += b - max(a, end) if b > end else 0
                    end = at = max(end, b)
                out.append(data[at:])
                removed.append(gone)
                n_spans.append(k)
                kept.append(b"".join(out))
            cols = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
