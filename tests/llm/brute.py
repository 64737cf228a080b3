"""Plain-Python versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def decontaminate(docs, benchmark):
    """{doc_id: (n_words, n_hit, items)}"""
    windows = defaultdict(set)
    for item, text in benchmark:
        w = alnum(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for key, text in docs:
        w, hit, items = alnum(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        out[key] = (len(w), len(hit), sorted(items))
    return out


def shingles(text, k=4):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(docs):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {k: shingles(t) for k, t in docs}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for k in sorted(sets):
        shared = Counter(j for s in sets[k] for j in seen[s])
        for j, o in shared.items():
            if 100 * o >= 85 * (len(sets[k]) + len(sets[j]) - o):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[k]:
            seen[s].append(k)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def measures(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit)


def cut(docs, length=200):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}"""
    data = [(k, (t or "").encode()) for k, t in docs]
    count = Counter(d[i : i + length] for _, d in data for i in range(len(d) - length + 1))
    out = {}
    for k, d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[k] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def targets(sizes):
    """{source: target} of {source: size}; sources by code point, None last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            out |= {s: weight[s] * level for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return out


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
