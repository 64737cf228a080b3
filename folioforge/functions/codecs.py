"""Byte-level decoding and file names as Arrow functions.

Spark's own ``decode`` has no GB18030 or Big5, so these run in Python, a batch at a time.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words of legal and administrative texts; garbled, they are what their UTF-8 reads as in GBK.
LEGAL_TERMS = "人民 政府 法院 条例 规定 办法 决定 法律 法规 管理 实施 委员会 代表大会 公司章程 股东出资".split()
GARBLED_TERMS = list(dict.fromkeys(t.encode().decode("gbk", "replace") for t in LEGAL_TERMS))
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿]")
_WRONG = re.compile("[Â-ÖØ-Ýâ€]")


def score_text(value: str) -> float:
    """How much a decoded text looks like language."""
    good = 4 * len(_HAN.findall(value)) + 0.2 * len(re.findall("[A-Za-z0-9]", value)) + 12 * sum(value.count(t) for t in LEGAL_TERMS)
    bad = 30 * value.count("�") + 4 * sum(map(len, re.findall(r"\?{3,}", value))) + 20 * len(re.findall("[-]", value))
    return good - bad - 8 * len(_WRONG.findall(value)) - 30 * sum(value.count(t) for t in GARBLED_TERMS)


def _repairs(value: str):
    """Readings of ``value`` as UTF-8 that was decoded with another codec."""
    yield value
    for codec in ("gbk", "gb18030", "big5", "latin-1"):
        got = value.encode(codec, "replace").decode("utf-8", "replace")
        yield re.sub("�+", "", got.replace("�?", "。"))


def decode_bytes(data: bytes) -> str:
    """UTF-16 by its mark, UTF-8 if valid, else the best-scoring of the legacy codecs and repairs; first on ties."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    options = []
    try:
        options.append(data.decode("utf-8"))
    except UnicodeDecodeError:
        options += [data.decode(codec, "replace") for codec in ("gb18030", "big5", "utf-8")]
    best = max((r for o in options for r in _repairs(o) if r or not o), key=score_text)
    return best.removeprefix("﻿")


@F.pandas_udf(StringType())
def decode_text(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else decode_bytes(bytes(d)))


def unescape_name(name: str) -> str:
    """``#Uxxxx`` escapes of archive tools."""
    return re.sub("#U([0-9a-fA-F]{4,6})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else m[0], name)


def repair_name(name: str) -> str:
    """An entry name, re-read from the codec it was mangled through if that scores better."""
    name = unescape_name(name)
    options = [name]
    for codec in ("cp437", "latin-1"):
        try:
            raw = name.encode(codec)
        except UnicodeEncodeError:
            continue
        for to in ("utf-8", "gb18030"):
            try:
                options.append(raw.decode(to))
            except UnicodeDecodeError:
                continue
    return max(options, key=score_text) if any(ord(c) > 127 for c in name) else name


def shorten_utf8(text: str, limit: int) -> str:
    """at most ``limit`` bytes of UTF-8, no character cut."""
    return text.encode()[:limit].decode("utf-8", "ignore")


def safe_name(name: str, limit: int = 180) -> str:
    """A path segment without reserved characters, at most ``limit`` bytes, told apart by a hash if cut."""
    import hashlib

    name = re.sub(r'[\x00-\x1f<>:"|?*]', "_", name).strip(" .") or "file"
    if len(name.encode()) <= limit:
        return name
    stem, dot, ext = name.rpartition(".")
    ext = dot + ext if dot and len(ext) <= 10 else ""
    mark = "-" + hashlib.sha256(name.encode()).hexdigest()[:8] + ext
    return shorten_utf8(stem if ext else name, limit - len(mark.encode())) + mark


@F.pandas_udf(StringType())
def entry_name(names: pd.Series) -> pd.Series:
    """A repaired, safe relative path."""
    return names.map(lambda n: None if n is None else "/".join(safe_name(p) for p in repair_name(n).replace("\\", "/").split("/") if p not in ("", ".")))
