"""Paths, kinds, page types and url predicates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by kind, and where pages of a type live.
KINDS = {
    "markdown": ".md .markdown",
    "text": ".txt .log",
    "html": ".html .htm",
    "pdf": ".pdf",
    "word": ".doc .docx",
    "presentation": ".ppt .pptx",
    "table": ".xls .xlsx .csv .tsv",
    "image": ".png .jpg .jpeg .webp .gif .bmp .tif .tiff",
}
SUPPORTED = [e for v in KINDS.values() for e in v.split()] + ".json .jsonl .yaml .yml .xml".split()
RAW_TEXT = ".md .markdown .txt .csv .tsv .json .jsonl .yaml .yml .xml .html .htm .log".split()
PAGE_TYPES = {
    "sources/converted/": "source_extract",
    "sources/": "source",
    "concepts/": "concept",
    "entities/": "entity",
    "queries/": "query",
    "research/": "research",
}
NO_EVIDENCE_PREFIXES = ("wiki/queries/", "wiki/research/")
NO_EVIDENCE_FILES = ("wiki/index.md", "wiki/log.md", "wiki/overview.md")
MAX_RAW_BYTES = 4 << 20


def is_small(size: Column) -> Column:
    """P3."""
    return size <= MAX_RAW_BYTES


def extension(path: Column) -> Column:
    """the ending, lower-cased, with its dot."""
    return F.lower(F.regexp_extract(path, "(\\.[^./\\\\]+)$", 1))


def base_name(path: Column) -> Column:
    """F27."""
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), "\\.[^.]*$", "")


def posix(path: Column) -> Column:
    """forward slashes, none in front."""
    return F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), "^/+", "")


def kind(path: Column) -> Column:
    """A name for the extension; an extension without one names itself."""
    own = F.regexp_replace(extension(path), "^\\.", "")
    out = F.when(own == "", F.lit("file")).otherwise(own)
    for name, extensions in KINDS.items():
        out = F.when(extension(path).isin(extensions.split()), F.lit(name)).otherwise(out)
    return out


def page_type(relative: Column) -> Column:
    """The type of a page by where it lives below ``wiki/``; the longest prefix wins."""
    out = F.lit("note")
    for prefix, name in sorted(PAGE_TYPES.items(), key=lambda x: len(x[0])):
        out = F.when(relative.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def is_evidence(path: Column) -> Column:
    """P1."""
    out = ~path.isin(*NO_EVIDENCE_FILES)
    for prefix in NO_EVIDENCE_PREFIXES:
        out = out & ~path.startswith(prefix)
    return out


def is_searchable(path: Column, root: str) -> Column:
    """P2."""
    return extension(path).isin(*([".md"] if root == "wiki" else RAW_TEXT))


def is_supported(path: Column, archives: bool = False) -> Column:
    """P14."""
    return extension(path).isin(*SUPPORTED, *([".zip"] if archives else []))


def is_unsafe_entry(path: Column) -> Column:
    """Absolute, with a drive letter, or leading out."""
    p = F.regexp_replace(path, "\\\\", "/")
    return p.startswith("/") | p.rlike("^[A-Za-z]:") | p.rlike("(^|/)\\.\\.(/|$)")


def is_external(reference: Column) -> Column:
    """P16."""
    return reference.rlike("(?i)^(?:https?:|mailto:|file:|data:)")


def is_web_url(url: Column) -> Column:
    """Http or https, a host (any characters but separators; or an address in brackets), no credentials, no control characters."""
    host = "(?:[^/?#@:\\\\\\[\\]%^|<>]+|\\[[0-9A-Fa-f:.]+\\])"
    shape = f"(?is)^https?://{host}(?::[0-9]*)?(?:[/?#].*)?$"
    return F.coalesce(url.rlike(shape) & ~url.rlike("[\\x00-\\x20\\x7f\\ufffd]"), F.lit(False))
