"""Token ids as wavelet matrices: one succinct file per shard.

A file holds the token ids of consecutive documents as ``bits`` bit-planes of a wavelet matrix, each cut
into blocks of ``BLOCK`` bits that are zstd-compressed where that is smaller, with the rank before every
block; and the documents' token counts.  ``Shard`` answers from the file's bytes:

* ``access(i)``: the id at a position, ``rank(c, i)``: how often ``c`` occurs before a position,
  ``select(c, k)``: where ``c`` occurs for the k-th time - each reads one block a plane;
* ``decode()``: all ids.

Layout, little-endian: magic ``FFWM``, u32 version, u32 bits, u64 tokens, u32 documents, u32 blocks a
plane, ``bits`` u64 counts of zeros, then for each plane and block u64 rank-before and u32 length, then
u64 token counts of the documents, then the blocks.  A block of full raw length is stored as it is.  A file
that is cut short or too long is refused.

``write`` encodes every document, deals the ids to shards by ranges of doc_id, and stores a row per shard
(range, part, file, doc ids) as Parquet through Spark's commit protocol: a lost task leaves nothing behind, and
any storage Spark reaches will do.  The files stay when the session ends; ``files`` opens them in another.
Documents of one shard are in ascending doc_id order (null first), and shards follow each other.

Null text is empty: only the end id.  Long texts are encoded whole, each in one piece of a task's memory.  Rows of
equal doc_id stay next to each other, ordered by a hash of the text; where one doc_id fills more than a range it is
split by that hash, and repeated rows each have their entry.  Special-token strings in a text are encoded as the
tokenizer does by default.  An empty table writes no shard and reads back as no document.  doc_id must be of an
integer type; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm import bytescan
from folioforge.llm.shared import integral, modest_batches
from folioforge.operators.tables import output_path

MAGIC = b"FFWM"
BLOCK = 1 << 16
END_ID = 1
#: Documents that one range of doc_ids is meant to hold, and the most ranges there are.
RANGE_DOCS = 5_000
MAX_RANGES = 20_000
#: A shard is closed after so many tokens.
SHARD_TOKENS = 8_000_000
#: Words kept encoded in a worker; beyond, all are forgotten and met again.
MEMO_WORDS = 1_400_000


# ---------------------------------------------------------------- the format
def encode_shard(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The file of ``ids`` (unsigned), whose documents have ``counts`` tokens."""
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32, copy=False)
    blocks = -(-n // BLOCK)
    zeros, table, data = [], [], []
    pack = zstandard.ZstdCompressor(level=1)
    for level in range(bits):
        bit = (seq & seq.dtype.type(1 << (bits - 1 - level))) != 0
        packed = np.packbits(bit, bitorder="little")
        raw = packed.tobytes()
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        before = np.cumsum(ones) - ones
        for b in range(blocks):
            part = raw[b * BLOCK // 8 : (b + 1) * BLOCK // 8]
            small = pack.compress(part)
            part = small if len(small) < len(part) else part
            table.append(struct.pack("<QI", before[b], len(part)))
            data.append(part)
        zeros.append(n - int(ones.sum()))
        seq = np.concatenate([np.compress(~bit, seq), np.compress(bit, seq)])
    head = MAGIC + struct.pack("<IIQII", 1, bits, n, len(counts), blocks) + struct.pack(f"<{bits}Q", *zeros)
    return b"".join([head, *table, np.asarray(counts, "<u8").tobytes(), *data])


class Shard:
    """Queries over one file."""

    def __init__(self, file: bytes):
        if file[:4] != MAGIC or len(file) < 28:
            raise ValueError("not a wavelet-matrix shard")
        _, self.bits, self.n, docs, self.blocks = struct.unpack_from("<IIQII", file, 4)
        at = 28
        if len(file) < at + 8 * self.bits + 12 * self.bits * self.blocks + 8 * docs:
            raise ValueError("the shard is cut short")
        self.zeros = struct.unpack_from(f"<{self.bits}Q", file, at)
        at += 8 * self.bits
        entry = np.dtype([("rank", "<u8"), ("size", "<u4")])
        self.table = np.frombuffer(file, entry, self.bits * self.blocks, at).reshape(self.bits, self.blocks)
        at += self.table.nbytes
        self.counts = np.frombuffer(file, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        sizes = self.table["size"].ravel().astype(np.int64)
        if len(file) != at + int(sizes.sum()):
            raise ValueError("the shard is cut short or too long")
        self.at = (at + np.cumsum(sizes) - sizes).reshape(self.bits, self.blocks) if self.blocks else np.zeros((self.bits, 0), np.int64)
        self.file = file
        self.unpack = zstandard.ZstdDecompressor()
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def _bytes(self, level: int, block: int) -> bytes:
        full = (min(BLOCK, self.n - block * BLOCK) + 7) // 8
        a, size = int(self.at[level, block]), int(self.table["size"][level, block])
        part = self.file[a : a + size]
        return part if size == full else self.unpack.decompress(part, max_output_size=full)

    def _block(self, level: int, block: int) -> np.ndarray:
        got = self.held.get((level, block))
        if got is None:
            if len(self.held) > 64:
                self.held.clear()
            got = np.unpackbits(np.frombuffer(self._bytes(level, block), np.uint8), bitorder="little")
            self.held[level, block] = got
        return got

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        b, r = divmod(i, BLOCK)
        return int(self.table["rank"][level, b]) + int(self._block(level, b)[:r].sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane."""
        rank = self.table["rank"][level].astype(np.int64)
        if not bit:
            rank = np.arange(self.blocks) * BLOCK - rank
        b = int(np.searchsorted(rank, k, "right")) - 1
        plane = self._block(level, b)[: self.n - b * BLOCK]
        return b * BLOCK + int(np.flatnonzero(plane == bit)[k - int(rank[b])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            b, r = divmod(i, BLOCK)
            bit = int(self._block(level, b)[r])
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def rank(self, c: int, i: int) -> int:
        """Occurrences of ``c`` before position ``i``."""
        if c >> self.bits or c < 0:
            return 0
        lo, hi = 0, min(i, self.n)
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if c >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def count(self, c: int) -> int:
        return self.rank(c, self.n)

    def select(self, c: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``c``."""
        if not 0 <= k < self.count(c):
            raise IndexError(k)
        lo = 0
        for level in range(self.bits):
            ones = self._rank1(level, lo)
            lo = self.zeros[level] + ones if c >> (self.bits - 1 - level) & 1 else lo - ones
        i = lo + k
        for level in reversed(range(self.bits)):
            bit = c >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the last: each plane's stable partition is undone."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level in reversed(range(self.bits)):
            raw = b"".join(self._bytes(level, b) for b in range(self.blocks))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[np.flatnonzero(bit)] = seq[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            back[np.flatnonzero(~bit)] = seq[: self.zeros[level]]
            seq = back
        return seq


# ---------------------------------------------------------------- encoding
#: Punctuation that ends a word after an ASCII letter or digit; a tokenizer's unit ends between them.
_TAIL = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Words of a-z, and of these and the small letters U+00DF-U+00FF (but the division sign), as UTF-8.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Byte-level tokenizers show a byte as a character: printable Latin-1 as itself, the others from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_STAND_INS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
# The normaliser and the splitter that words may be encoded one by one under.
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
_loaded: dict[str, WordEncoder] = {}


def by_words(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) gives a text the ids of its words, one after the other.

    So it is for byte-level pair encoding of units that never contain white space, after NFC and lower-casing:
    NFC joins nothing across ASCII white space, and added tokens have none in them.
    """
    split = {"type": "Split", "pattern": _SPLIT, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    pre = spec.get("pre_tokenizer") or {}
    steps = [{k: v for k, v in x.items() if k != "trim_offsets"} for x in pre.get("pretokenizers", ())]
    added = spec.get("added_tokens") or []
    return (
        spec.get("normalizer") == {"type": "Sequence", "normalizers": _NORMALISER}
        and steps == [split, level]
        and spec["model"].get("type") == "BPE"
        and not spec["model"].get("dropout")
        and spec.get("truncation") is None
        and spec.get("padding") is None
        and all(t["content"].startswith("<|") and t["content"].isascii() and not re.search(r"\s", t["content"]) for t in added)
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    )


class WordEncoder(dict):
    """Ids of words by word; each word is encoded by the library once.

    Only for tokenizers that ``by_words`` knows; for any other the library encodes whole texts.  Texts are cut at
    ASCII white space.  A-Z is lower-cased before a word is looked up, as the tokenizer does itself, but for words in
    which that could change what NFC makes of them (every mark that NFC joins to an ASCII letter is one of U+0300 to
    U+036F) or that may hold an added token.  A new word is cut before ASCII punctuation that ends it, where the
    tokenizer splits itself.  A word of small Latin letters is one unit that NFC and lower-casing leave alone, so it
    goes to the library's model without them; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        #: Ids are little-endian unsigned integers of this type.
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code, self.pack = {"<u2": "H", "<u4": "I"}[self.kind], struct.pack
        self.model = self.tokenizer.model
        self.known = by_words(json.loads(self.tokenizer.to_str()))

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:  # keep the words met first: the frequent ones
            first = list(islice(self.items(), MEMO_WORDS // 2))
            self.clear()
            self.update(first)
        core = word.rstrip(_TAIL)
        if core != word and core[-1:].isalnum() and b"<|" not in word:  # bytes: ASCII only
            ids = self[core] + self[word[len(core) :]]
            self[word] = ids
            return ids
        if _LETTERS.fullmatch(word):
            # The model sees bytes as their stand-ins.
            found = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_STAND_INS))]
        else:
            found = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        ids = self.pack(f"<{len(found)}{self.code}", *found)
        self[word] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the texts, where each text's ids begin and the last one's end); null is empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        if not self.known:
            return self._joined([np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.kind).tobytes() for x in texts.to_pylist()])
        parts, odd = [], _as_is(texts)
        for a, b in pairwise([0, *(i for k in odd for i in (k, k + 1)), len(texts)]):
            if a == b:
                continue
            if b == a + 1 and a in odd:
                words = texts[a].as_py().encode().split()
                parts.append(self._joined([b"".join(self[w if _ODD.search(w) else w.lower()] for w in words)]))
            else:
                parts.append(self._plain(texts.slice(a, b - a)))
        ends = np.cumsum([0, *(len(x) for x, _ in parts)])
        return np.concatenate([np.zeros(0, self.kind), *(x for x, _ in parts)]), np.concatenate([[0], *(o[1:] + e for (_, o), e in zip(parts, ends, strict=False))])

    def _joined(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(ids), self.kind)
        return flat, np.cumsum([0, *map(len, ids)]) // flat.itemsize

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts all of whose words may be lower-cased first: each distinct word is looked up once."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = words.values.dictionary_encode()
        # One string of all distinct words, cut again: no word has a space, and this is the fastest way out of Arrow.
        known = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py().encode().split(b" ")
        get = self.__getitem__
        flat, begin = self._joined([get(w) if w else b"" for w in known])
        at = coded.indices.to_numpy()
        size = np.diff(begin)[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(begin[at] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[words.offsets.to_numpy()]


#: What words hold that may not be lower-cased before NFC or may be an added token: U+0300 to U+037F and no others begin with these bytes.
_ODD = re.compile(rb"<\||[\xcc\xcd]")


def _as_is(texts: pa.Array) -> set[int]:
    """The texts that have such words."""
    for _, _, buf, _ in bytescan.chunks(texts):
        if ((buf & 0xFE) == 0xCC).any() or b"<|" in buf.tobytes():
            return {i for i, x in enumerate(texts.cast(pa.binary()).to_pylist()) if _ODD.search(x)}
    return set()


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; loaded once, without threads of its own."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


# ---------------------------------------------------------------- write and read
def _ranges(docs: DataFrame, rows: int) -> list[int]:
    """Inner bounds of doc_id ranges of about ``rows`` documents each."""
    n = min(MAX_RANGES, -(-docs.count() // rows))
    if n <= 1:
        return []
    bounds = docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], min(0.001, 0.1 / n))
    return [int(x) for x in bounds]


def write(
    docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, range_docs: int = RANGE_DOCS, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the shard files to ``path``; returns the table of files.

    ``path`` must not exist yet; without one, a new folder below the warehouse is taken.  The result has it as its
    attribute ``path``.  Columns: range and part (a shard's place in the order), file (the bytes), doc_ids, n_tokens.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    docs = docs.select(integral(docs, "doc_id"), "text")
    path = path or output_path(spark, "token_files")
    bounds = _ranges(docs, range_docs)

    def encode(batches):
        enc, edges = encoder(tokenizer), np.array(bounds, np.int64)
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            key = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(edges, key, "left"), np.searchsorted(edges, key, "right")
            # An id that is several bounds at once fills several ranges: its rows go by ranges of their hash.
            place = lo + ((hashes * (hi - lo + 1)) >> 40)
            found, begin = enc.encode(batch.column(1))
            closed = np.insert(found, begin[1:], found.dtype.type(end_id))  # the end id after each document
            begin = (begin + np.arange(len(begin))) * found.itemsize
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(closed)])
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), ids, batch.column(2), out.cast(pa.binary())], ["range", "doc_id", "h", "ids"])

    keyed = docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("h"))
    rows = keyed.mapInArrow(encode, "range int, doc_id long, h long, ids binary")
    rows = rows.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "doc_id", "h")

    def build(batches):
        kind = encoder(tokenizer).kind
        place, part, held, ids, docs_, counts = None, 0, 0, [], [], []

        def done():
            joined = np.concatenate(ids)
            cols = [[place], [part], [encode_shard(joined, np.array(counts))], [docs_], [len(joined)]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["range", "part", "file", "doc_ids", "n_tokens"])

        for batch in batches:
            for r, d, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if ids and (r != place or held >= shard_tokens):
                    yield done()
                    part, held, ids, docs_, counts = (part + 1 if r == place else 0), 0, [], [], []
                place = r
                ids.append(np.frombuffer(x, kind))
                docs_.append(d)
                counts.append(len(ids[-1]))
                held += counts[-1]
        if ids:
            yield done()

    rows.select("range", "doc_id", "ids").mapInArrow(build, FILES).write.option("compression", "none").parquet(path)  # files are compressed inside
    return files(spark, path)


#: The table of files.
FILES = "range int, part int, file binary, doc_ids array<long>, n_tokens long"


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files that ``write`` left at ``path``, in this session or an earlier one."""
    out = spark.read.schema(FILES).parquet(path)
    out.path = path
    return out


def read(files: DataFrame, per_doc: Callable[[np.ndarray], int], name: str, kind: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ``name``) of every document, from the shard files.

    ``per_doc`` is applied to each document's ids.  ``start`` counts the ids of all documents before it.
    """
    shards = files.select("range", "part", "n_tokens")  # a row per shard
    ranges = shards.groupBy("range").agg(F.sum("n_tokens").alias("t"))  # at most MAX_RANGES rows
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    above = ranges.select("range", F.coalesce(F.sum("t").over(before(Window.orderBy("range"))), F.lit(0)).alias("above"))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("range").orderBy("part"))), F.lit(0))
    starts = shards.withColumn("inside", inside).join(above, "range").select("range", "part", (F.col("above") + F.col("inside")).alias("base"))

    def run(batches):
        for batch in batches:
            for r, p, file, docs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                shard = Shard(file)
                ids, n = shard.decode(), len(docs)
                ends = np.cumsum(shard.counts)
                first = ends - shard.counts
                value = [per_doc(ids[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                cols = [np.full(n, r, np.int32), np.full(n, p, np.int32), pa.array(docs, pa.int64()), first, shard.counts, value]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["range", "part", "doc_id", "at", "n_tokens", name])

    out = files.select("range", "part", "file", "doc_ids").mapInArrow(run, f"range int, part int, doc_id long, at long, n_tokens long, {name} {kind}")
    return out.join(starts, ["range", "part"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", name)


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
