"""Alignment of two tokenizers over a corpus: which of A's tokens cover which of B's, and how usual each link is.

Both encode every whole text (A a space and the text, B the text, to which it adds the space).  Two tokens are linked
where their byte ranges overlap; places where tokens of both end cut a document into groups.  A pair of ids counts as
often as the corpus links it, and a link is *best* if no pair of the same B id counts more.

Method: id-striped dense count matrices.

1. ``encoded``: one scan leaves, for each chunk of documents, a packed record a stripe of ``STRIPE`` consecutive B ids - the
   chunk's pairs, and for each the documents that have it - and what the task counted of each pair.
2. ``pair_counts``: these counts are dealt to the stripes; a stripe's task adds them into a dense block (B ids of the stripe
   by all A ids) with ``np.add.at``.
3. ``annotate``: a stripe's counts and its records meet in one task, counts first: they fill the block, row maxima are the
   best counts, and the records that follow are scored against it while they stream by.  A stripe of more than
   ``STRIPE_LINKS`` links is dealt to several tasks by chunk, its counts to each of them.
4. Partial sums of a chunk's documents meet by chunk and are added up.

A task holds one block (``STRIPE`` x A's ids x 8 bytes, 103 MB for 50,257), and one record at a time; no link list of a token,
a document or a stripe is ever collected.  A stripe's counts are at most as many as the block has cells.

Neither tokenizer joins tokens over a space between two characters that are not white space, so texts are cut there, and what each such
unit gives - ids, groups, links - is worked out once and remembered (``MEMO_UNITS``, then forgotten); a text is put together
from its units, with the same result as encoding it whole (tests).  Where a unit's bytes do not come back from the
tokens, the text is encoded whole.  Strings of special tokens in a text are plain text.

Null or empty text, and text that the tokens' bytes do not give back (as one with U+2581), has no tokens: zeros and an
empty digest.  Very long texts are encoded whole, and their links are sent in slices.  Repeated rows each count and
each have their row; equal counts are all best.  An empty table gives an empty result.  Other columns are ignored, or, named in ``keep``, passed on.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.shared import integral, materialise, modest_batches

#: B ids of a stripe.
STRIPE = 256
#: Links of a stripe that one task is meant to score.
STRIPE_LINKS = 64_000_000
#: Units, and their links, that a worker remembers.
MEMO_UNITS, MEMO_LINKS = 500_000, 8_000_000
#: Bytes of text of a chunk of documents, documents of it, and links that are sorted at once.
CHUNK_BYTES, CHUNK_DOCS, SLICE_LINKS = 8 << 20, 1 << 16, 2_000_000
#: Pairs that a counting task holds before it hands them on.
HELD_PAIRS = 2_000_000

_RUN, _CUT = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")
#: Both of A's implementations split texts of these characters alike (test); others go to the tokenizers library.
_PLAIN = re.compile("[\x00-\u024f]*")


def byte_of_char() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself where it is visible, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """The two tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_file: str, b_file: str, ranks_file: str | None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        back = byte_of_char()
        known = {i: t for t, i in self.a.get_vocab().items()}
        special = self.a.get_added_tokens_decoder()
        self.a_bytes = [
            special[i].content.encode() if i in special else bytes(back[c] for c in known.get(i, "")) for i in range(max(known) + 1)
        ]
        self.fast = _ranked(ranks_file) if ranks_file else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        # Units may be encoded by themselves only if no piece goes on after a space that follows something else.
        self.by_units = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("a pair of ids takes 32 bits: at most 65,536 ids a side")
        self.a_lengths = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for units that begin with the space."""
        if self.fast is None:
            hard = list(range(len(units)))
            a = [[]] * len(units)
        else:
            hard = [i for i, u in enumerate(units) if _hard(u)]
            a = list(map(self.fast, units)) if not hard else [[] if _hard(u) else self.fast(u) for u in units]
        for i, e in zip(hard, self.a.encode_batch([units[i] for i in hard], add_special_tokens=False), strict=True):
            a[i] = e.ids
        return a, self.b.encode([u[1:] for u in units], num_threads=1)


def _hard(unit: str) -> bool:
    return not (unit.isascii() or _PLAIN.fullmatch(unit))


def _ranked(file: str):
    """A's vocabulary in the quicker library, from its table of ranks."""
    import public_tokenizers
    import tiktoken

    with open(file, "rb") as f:
        ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _by_unit(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by unit, of which each has ``sizes`` of them."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - sizes]


class Units:
    """What each unit gives: place in the arrays by text, digest, numbers of tokens, groups and links, and its links."""

    def __init__(self, pair: Pair):
        self.pair = pair
        n_a, n_b = len(pair.a_bytes), len(pair.b_bytes)
        # Digest pieces by 2 * id + (whether the id ends its group's list).
        self.a_text = np.array([f"{i // 2}{',|'[i % 2]}" for i in range(2 * n_a)], object)
        self.b_text = np.array([f"{i // 2}{',;'[i % 2]}" for i in range(2 * n_b)], object)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[str] = []
        self.facts = np.zeros((0, 5), np.int64)  # valid, A tokens, B tokens, groups, links
        self.links = np.zeros(0, np.uint32)  # B id << 16 | A id, unit after unit
        self.starts = np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> None:
        """Work out and remember units that are not known yet."""
        pair = self.pair
        a_ids, b_ids = pair.encode(units)
        ok = self._given_back(units, a_ids, b_ids)
        for i in np.flatnonzero(~ok):
            a_ids[i], b_ids[i] = [], []
        a, a_sizes = _flat(a_ids)
        b, b_sizes = _flat(b_ids)
        a_ends, b_ends = np.cumsum(pair.a_lengths[a]), np.cumsum(pair.b_lengths[b])
        cuts = np.concatenate([a_ends, b_ends])
        cuts.sort(kind="stable")  # two ascending runs
        cuts = cuts[np.concatenate([cuts[1:] != cuts[:-1], [True]])] if len(cuts) else cuts
        # Between two cuts lies what one token of each shares: a link.
        a_at, b_at = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        links = (b[b_at] << 16 | a[a_at]).astype(np.uint32)
        a_last, b_last = (np.zeros(len(x), bool) for x in (a, b))
        both = (a_ends[a_at] == cuts) & (b_ends[b_at] == cuts)
        a_last[a_at[both]] = b_last[b_at[both]] = True
        groups = _by_unit(a_last, a_sizes)
        n_links = a_sizes + b_sizes - groups
        # A group's A ids, then its B ids.
        out = np.empty(len(a) + len(b), object)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        total = int(a_last.sum())
        b_until, a_until = np.bincount(b_group, minlength=total + 1), np.bincount(a_group, minlength=total + 1)
        out[np.arange(len(a)) + (np.cumsum(b_until) - b_until)[a_group]] = self.a_text[2 * a + a_last]
        out[np.arange(len(b)) + np.cumsum(a_until)[b_group]] = self.b_text[2 * b + b_last]
        pieces, at = out.tolist(), 0
        first = len(self.text)
        for u, n in zip(units, (a_sizes + b_sizes).tolist(), strict=True):
            self.place[u] = first
            self.text.append("".join(pieces[at : at + n]))
            at += n
            first += 1
        begin = len(self.links) + np.cumsum(n_links) - n_links
        self.facts = np.concatenate([self.facts, np.stack([ok, a_sizes, b_sizes, groups, n_links], 1)])
        self.links = np.concatenate([self.links, links])
        self.starts = np.concatenate([self.starts, begin])

    def _given_back(self, units: list[str], *sides: list[list[int]]) -> np.ndarray:
        """Whether the tokens of both sides are a unit's bytes: all at once, and one by one only where that fails."""
        raw = [u.encode() for u in units]
        whole = b"".join(raw)
        tables = self.pair.a_bytes, self.pair.b_bytes
        ok = np.ones(len(units), bool)
        for ids, table in zip(sides, tables, strict=True):
            flat, sizes = _flat(ids)
            lengths = self.pair.a_lengths if table is tables[0] else self.pair.b_lengths
            alike = _by_unit(lengths[flat], sizes) == np.fromiter(map(len, raw), np.int64, len(raw))
            if alike.all() and b"".join(map(table.__getitem__, flat.tolist())) == whole:
                continue
            ok &= np.fromiter((r == b"".join([table[i] for i in x]) for r, x in zip(raw, ids, strict=True)), bool, len(raw))
        return ok

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The places of each text's units; none where a text has no tokens."""
        if len(self.text) > MEMO_UNITS or len(self.links) > MEMO_LINKS:
            self.forget()
        cut = [self._cut(t) if t else [] for t in texts]
        new = set().union(*cut) - self.place.keys()
        if new:
            self.learn(list(new))
        found = [np.fromiter(map(self.place.__getitem__, c), np.int64, len(c)) for c in cut]
        for i, f in enumerate(found):
            if len(f) and not self.facts[f, 0].all():
                whole = " " + texts[i]
                if whole not in self.place:
                    self.learn([whole])
                at = self.place[whole]
                found[i] = np.array([at] if self.facts[at, 0] else [], np.int64)
        return found

    def _cut(self, text: str) -> list[str]:
        if not self.pair.by_units:
            return [" " + text]
        if text[0] == " " or text[-1] == " " or _RUN.search(text):
            return [" " + w for w in _CUT.split(text)]
        return [" " + w for w in text.split(" ")]

    def links_of(self, places: np.ndarray) -> np.ndarray:
        sizes = self.facts[places, 4]
        before = np.cumsum(sizes) - sizes
        return self.links[np.repeat(self.starts[places] - before, sizes) + np.arange(int(sizes.sum()))]


@cache
def _units(*files: str | None) -> Units:
    return Units(Pair(*files))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of pieces of a batch."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py()
        if held and (size + len(t or "") > CHUNK_BYTES or len(held) == CHUNK_DOCS):
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t or "")
    if held:
        yield first, held


# ---------------------------------------------------------------- counts of pairs
_COUNTS = "stripe int, kind int, chunk long, p binary, q binary, r binary"


def _record(schema: T.StructType | pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_PACKED = pa.schema([("stripe", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("p", pa.binary()), ("q", pa.binary()), ("r", pa.binary())])


def _by_stripe(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(stripe, where) of ascending keys."""
    stripe = (keys >> np.uint32(16)) // STRIPE
    edges = np.flatnonzero(np.diff(stripe)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(keys)], strict=True):
        if hi > lo:
            yield int(stripe[lo]), slice(lo, hi)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def pair_counts(encoded: DataFrame, width: int) -> DataFrame:
    """(stripe, links, p, q): ascending pairs (B id << 16 | A id, unsigned 32-bit) of a stripe, their counts (64-bit) and the sum of these."""

    def add_up(batches):
        for stripe, block in _filled(batches, width):
            keys = np.flatnonzero(block)
            for lo in range(0, len(keys), 1 << 20):
                k = keys[lo : lo + (1 << 20)]
                b, a = np.divmod(k, width)
                packed = ((b + stripe * STRIPE) << 16 | a).astype(np.uint32)
                yield _record(_PACKED, [(stripe, 0, int(block.ravel()[k].sum()), packed.tobytes(), block.ravel()[k].tobytes(), None)])

    parts = encoded.filter("kind = 0").select("stripe", "p", "q")
    dealt = parts.repartition(_tasks(encoded), "stripe").sortWithinPartitions("stripe")
    return dealt.mapInArrow(add_up, _COUNTS).withColumnRenamed("chunk", "links").select("stripe", "links", "p", "q")


def _tasks(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def _add(block: np.ndarray, row: dict) -> None:
    keys = np.frombuffer(row["p"], np.uint32).astype(np.int64)
    np.add.at(block, ((keys >> 16) - row["stripe"] * STRIPE, keys & 0xFFFF), np.frombuffer(row["q"], np.int64))


def _filled(batches, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(stripe, its block) from count records in the order of stripes; the block is used again for the next."""
    block, at = np.zeros((STRIPE, width), np.int64), None
    for row in _rows(batches):
        if row["stripe"] != at:
            if at is not None:
                yield at, block
                block[:] = 0
            at = row["stripe"]
        _add(block, row)
    if at is not None:
        yield at, block


# ---------------------------------------------------------------- links and scores
_FACTS = ("n_a", "n_b", "n_groups", "n_links")


def _sent(docs_of: np.ndarray, keys: np.ndarray, chunk: int) -> list[tuple]:
    """Records of links: a stripe's distinct pairs, how many links each has, and their documents' places in the chunk."""
    both = keys.astype(np.uint64) << np.uint64(16) | docs_of.astype(np.uint64)
    both.sort()
    keys = (both >> np.uint64(16)).astype(np.uint32)
    docs_of = (both & np.uint64(0xFFFF)).astype(np.uint16)
    rows = []
    for stripe, w in _by_stripe(keys):
        k = keys[w]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        many = np.diff(np.append(first, len(k))).astype(np.uint32)
        rows.append((stripe, 1, chunk, k[first].tobytes(), many.tobytes(), docs_of[w].tobytes()))
    return rows


def encoded(docs: DataFrame, files: tuple[str | None, ...], keep: tuple[str, ...], text: str) -> DataFrame:
    """Records of the corpus: counts of pairs (kind 0), links (1) and a chunk's documents (2)."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    facts = [T.StructField(n, T.LongType()) for n in _FACTS] + [T.StructField("sha", T.StringType())]
    inner = T.StructType([T.StructField("row", docs.select(row).schema["row"].dataType), *facts])
    sent_type = T.StructType([*T._parse_datatype_string(_COUNTS).fields, T.StructField("docs", T.ArrayType(inner))])

    def counted(held, none):
        keys, counts = _counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        if packed := [(s, 0, 0, keys[w].tobytes(), counts[w].tobytes(), None) for s, w in _by_stripe(keys)]:
            yield _with_docs(packed, none)

    def send(batches):
        units = _units(*files)
        number = TaskContext.get().partitionId() << 32
        held, size, none = [], 0, None
        for batch in batches:
            kept = batch.column(0)
            for first, texts in _chunks(batch.column(1)):
                found = units.of(texts)
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                places = np.concatenate([np.zeros(0, np.int64), *found])
                facts = units.facts[places]
                sums = [_by_unit(facts[:, k], sizes) for k in range(1, 5)]
                sha = [hashlib.sha256("".join([units.text[i] for i in f.tolist()])[:-1].encode()).hexdigest() if len(f) else "" for f in found]
                rows = pa.StructArray.from_arrays(
                    [kept.slice(first, len(texts)), *[pa.array(s, pa.int64()) for s in sums], pa.array(sha, pa.string())],
                    ["row", *_FACTS, "sha"],
                )
                none = rows.slice(0, 0)
                yield _with_docs([(-1, 2, number, None, None, None)], rows)
                # Links in slices, so that a long text adds nothing to what is sorted at once.
                ends, of_doc = np.cumsum(facts[:, 4]), np.repeat(np.arange(len(found)), sizes)
                at = 0
                while at < len(places):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_LINKS, "right")))
                    part = places[at:to]
                    if packed := _sent(np.repeat(of_doc[at:to], facts[at:to, 4]), units.links_of(part), number):
                        yield _with_docs(packed, none)
                    at = to
                number += 1
                seen, often = np.unique(places, return_counts=True)
                held.append(_counted(units.links_of(seen), np.repeat(often, units.facts[seen, 4])))
                size += len(held[-1][0])
                if size > HELD_PAIRS:
                    yield from counted(held, none)
                    held, size = [], 0
        if held:
            yield from counted(held, none)

    return docs.select(row, F.col(f"`{text}`")).mapInArrow(send, sent_type)


def annotate(docs: DataFrame, files: tuple[str | None, ...], *keep: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``files``: A's tokenizer, B's model, and A's table of ranks or None.
    """
    modest_batches(docs.sparkSession)
    integral(docs, doc_id)
    keep = tuple(dict.fromkeys((doc_id, *keep)))
    width = len(_units(*files).pair.a_bytes)
    sent = materialise(encoded(docs, files, keep, text), "links", **{"parquet.block.size": str(16 << 20)})  # records are read by row groups
    sent_type = sent.schema
    counts = materialise(pair_counts(sent, width), "pair_counts")
    links = {r.stripe: r.links for r in counts.groupBy("stripe").agg(F.sum("links").alias("links")).collect()}  # a row a stripe
    stripes = max(links, default=-1) + 1
    ways = F.array(*[F.lit(-(-links.get(s, 0) // STRIPE_LINKS) or 1) for s in range(stripes)], F.lit(1))
    way = F.get(ways, F.col("stripe"))

    def score(batches):
        block = best = at = None
        for batch in batches:
            carried = batch.column(batch.schema.names.index("docs"))
            out, through = [], []
            for i, r in enumerate(_rows([batch.select(["stripe", "way", "kind", "chunk", "p", "q", "r"])])):
                if r["kind"] == 2:
                    through.append(i)
                    continue
                if (r["stripe"], r["way"]) != at:
                    at, best = (r["stripe"], r["way"]), None
                    block = np.zeros((STRIPE, width), np.int64) if block is None else block
                    block[:] = 0
                if r["kind"] == 0:
                    _add(block, r)
                    continue
                if best is None:
                    best = block.max(axis=1)
                keys = np.frombuffer(r["p"], np.uint32).astype(np.int64)
                many, of_doc = np.frombuffer(r["q"], np.uint32), np.frombuffer(r["r"], np.uint16)
                b = (keys >> 16) - r["stripe"] * STRIPE
                often = block[b, keys & 0xFFFF]
                touched, where = np.unique(of_doc, return_inverse=True)
                sums, bests = np.zeros(len(touched), np.int64), np.zeros(len(touched), np.int64)
                np.add.at(sums, where, np.repeat(often, many))
                np.add.at(bests, where, np.repeat((often == best[b]).astype(np.int64), many))
                out.append((-1, 1, r["chunk"], touched.tobytes(), bests.tobytes(), sums.tobytes()))
            if out:
                yield _with_docs(out, carried.flatten().slice(0, 0))
            for i in through:
                r = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([r.column(r.schema.names.index(n)) for n in sent_type.names], names=sent_type.names)

    def add_up(batches):
        at = rows = bests = sums = None

        def done():
            flat = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
            row_type = rows.type.field("row").type
            cols = [*flat["row"].flatten(), *[flat[n] for n in _FACTS], pa.array(bests), pa.array(sums), flat["sha"]]
            return pa.RecordBatch.from_arrays(cols, names=[*[f.name for f in row_type], *_FACTS, "n_best", "count_sum", "groups_sha256"])

        for batch in batches:
            carried = batch.column(batch.schema.names.index("docs"))
            for i, r in enumerate(_rows([batch.select(["kind", "chunk", "p", "q", "r"])])):
                if r["chunk"] != at:
                    if at is not None:
                        yield done()
                    at = r["chunk"]
                if r["kind"] == 2:  # a chunk's documents come first
                    rows = carried.slice(i, 1).flatten()
                    bests, sums = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                    continue
                touched = np.frombuffer(r["p"], np.uint16)
                bests[touched] += np.frombuffer(r["q"], np.int64)
                sums[touched] += np.frombuffer(r["r"], np.int64)
        if at is not None:
            yield done()

    spread = F.when(F.col("kind") == 1, F.pmod(F.xxhash64("chunk"), way)).when(F.col("kind") == 2, F.pmod(F.xxhash64("chunk"), F.lit(1 << 16))).otherwise(F.lit(0))
    first = counts.select(
        "stripe", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), "p", "q", F.lit(None).cast("binary").alias("r"),
        F.lit(None).cast(sent_type["docs"].dataType).alias("docs"), F.explode(F.sequence(F.lit(0).cast("long"), (way - 1).cast("long"))).alias("way"),
    )
    both = sent.filter("kind > 0").withColumn("way", spread.cast("long")).unionByName(first)
    tasks = max(_tasks(docs), sum(-(-n // STRIPE_LINKS) for n in links.values()))
    dealt = both.repartition(tasks, "stripe", "way").sortWithinPartitions("stripe", "way", "kind")
    scored = dealt.mapInArrow(score, sent_type)
    chunks = scored.repartition(tasks, "chunk").sortWithinPartitions("chunk", F.desc("kind"))
    result = T.StructType([
        *docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields,
        *[T.StructField(n, T.LongType()) for n in (*_FACTS, "n_best", "count_sum")],
        T.StructField("groups_sha256", T.StringType()),
    ])
    return chunks.select("kind", "chunk", "p", "q", "r", "docs").mapInArrow(add_up, result)


def _with_docs(rows: list[tuple], docs: pa.Array) -> pa.RecordBatch:
    """Records with the documents of a chunk in the first one (``docs`` empty: in none)."""
    packed = _record(_PACKED, rows)
    offsets = pa.array([0] + [len(docs)] * len(rows), pa.int32())
    return pa.RecordBatch.from_arrays([*packed.columns, pa.ListArray.from_arrays(offsets, docs)], names=[*packed.schema.names, "docs"])
