"""Vectorised scanning of UTF-8 text: words, word hashes, shingle hashes and rolling hashes in numpy.

All hashes are 64 bits and depend on nothing but the bytes, so every executor and every rerun
agrees.  Texts are handled in chunks of about ``CHUNK`` bytes (a longer text is a chunk of its
own), whole texts always.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base (or of its inverse) modulo 2**64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(n, CHUNK) + CHUNK // 4
        have = np.full(size, _P_INV if inverse else _P, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def _table(words: np.ndarray, lower: bool) -> np.ndarray:
    codes = np.arange(256)
    if lower:
        codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    lut = mix((codes.astype(np.uint64) + np.uint64(1)) * _P)
    lut[~words[codes]] = 0
    return lut


_all = np.ones(256, bool)
_space = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_c = np.arange(256)
#: Words of anything but white space, A-Z lower-cased.
SPACED = _table(~_space, True)
#: Words of digits, letters a-z and all code points from U+0080, A-Z lower-cased.
ALNUM = _table(((_c >= 0x30) & (_c <= 0x39)) | ((_c >= 0x61) & (_c <= 0x7A)) | (_c >= 0x80), True)
#: Every byte counts.
RAW = _table(_all, False)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of consecutive rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    bufs = texts.buffers()
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + CHUNK, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Words:
    """The words of a chunk: ``start``/``end`` byte positions, 64-bit ``hash``, and ``of``: word offsets per row."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lut: np.ndarray):
        v = lut[buf]
        w = v != 0
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1] | edge[1:-1]
        last[:-1] &= ~w[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        v *= powers(len(v))
        total = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v, out=total[1:])
        h = total[self.end] - total[self.start]
        h *= powers(len(buf) + 1, True)[self.start]
        self.hash = mix(h)
        self.of = np.searchsorted(self.start, offs)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; entries that would cross the end are meaningless."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return combine([self.hash[i : n + i] for i in range(k)])


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of word hashes; differs by the number of words."""
    acc = np.full(len(parts[0]), np.uint64(len(parts)), np.uint64)
    for p in parts:
        acc = acc * _P + p
    return mix(acc)


def rolling(buf: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, mixed hash of the ``width`` bytes from each position on)."""
    v = RAW[buf]
    v *= powers(len(v))
    total = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    n = len(buf) - width + 1
    if n <= 0:
        return total, np.zeros(0, np.uint64)
    return total, mix((total[width:] - total[:n]) * powers(n, True))


def piece(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of bytes [start, end) from the prefix sums of ``rolling``."""
    return mix((total[end] - total[start]) * powers(len(total) + 1, True)[start])


#: Bits of a position in a suffix array that is sorted as packed integers: two ranks and a position fit into 64 bits.
_PLACE = 21


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order of their ``bits``-bit keys, dense rank of each in that order); equal keys by position."""
    n = len(key)
    if n <= 1 << _PLACE and bits + _PLACE <= 64:  # plain integers sort several times faster than an argsort
        both = np.sort(key << np.uint64(_PLACE) | np.arange(n, dtype=np.uint64))
        order, sorted_ = (both & np.uint64((1 << _PLACE) - 1)).astype(np.int64), both >> np.uint64(_PLACE)
    else:
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
    new = np.zeros(n, np.uint64)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return order, np.cumsum(new)


def suffix_array(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the suffixes at ``starts``, compared by their first ``depth`` bytes.

    Returns (indexes into ``starts`` in suffix order, dense rank of each in that order): neighbours of one rank have a
    common prefix of ``depth`` bytes.  By prefix doubling: ranks by the first h bytes, taken at a place and h bytes on,
    give the ranks by 2h bytes.  Every start must have ``depth`` bytes of ``data``.
    """
    n = len(data)
    h = min(5, depth)
    padded = np.concatenate([data, np.zeros(h, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key = key << np.uint64(8) | padded[j : n + j]
    # Ranks of up to n positions take as many bits as n does.
    width = max(1, int(n).bit_length())
    bits = 8 * h
    while True:
        last = h == depth
        if last:
            key = key[starts]
        order, rank = _ranked(key, bits)
        if last:
            return order, rank
        by_place = np.empty(n, np.uint64)
        by_place[order] = rank
        step = min(h, depth - h)
        on = np.zeros(n, np.uint64)
        on[: n - step] = by_place[step:]
        key, bits, h = by_place << np.uint64(width) | on, 2 * width, h + step
