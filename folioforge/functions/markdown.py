"""Markdown, HTML and structured-text functions as Columns; YAML and XML parsing as Arrow functions."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.functions.text import SPACES, clean_unknown, is_unknown, let, normalize, readable_or, trim

_FRONT = "^\\ufeff?---[ \\t]*\\r?\\n([\\s\\S]*?)\\r?\\n---[ \\t]*(?:\\r?\\n|$)"


# ---------------------------------------------------------------- front matter
@F.pandas_udf(StringType())
def front_matter_json(text: pd.Series) -> pd.Series:
    """M1: the front matter as a JSON object; null where there is none or it is no mapping."""
    import yaml

    # The C loader is several times faster; it lets tabs pass that the other refuses, so texts with any go to that one.
    fast = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(t):
        m = re.match(r"﻿?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", t or "", re.S)
        if not m:
            return None
        try:
            value = yaml.load(m[1], yaml.SafeLoader if "\t" in m[1] else fast)
        except yaml.YAMLError:
            return None
        value = {} if value is None else value
        return json.dumps(value, default=str, ensure_ascii=False) if isinstance(value, dict) else None

    return text.map(one)


def body(text: Column, front: Column) -> Column:
    """The text after its front matter, or all of it where ``front`` (M1) is null."""
    return F.when(front.isNull(), text).otherwise(F.regexp_replace(text, _FRONT, ""))


def front_string(front: Column, key: str) -> Column:
    """A string value of the front matter, null if it is missing or of another type."""
    value = F.get_json_object(front, f"$.{key}")
    return F.when(F.schema_of_variant(F.variant_get(F.parse_json(front), f"$.{key}", "variant")) == "STRING", value)


def front_list(front: Column, key: str) -> Column:
    """A list of strings, from a list or a single string."""
    many = F.from_json(F.get_json_object(front, f"$.{key}"), "array<string>")
    one = trim(F.coalesce(F.get_json_object(front, f"$.{key}"), F.lit("")))
    single = F.when(one == "", F.array().cast("array<string>")).otherwise(F.array(one))
    return F.filter(F.when(one.startswith("["), F.coalesce(many, F.array().cast("array<string>"))).otherwise(single), lambda x: x.isNotNull() & (x != ""))


def serialize(front_yaml: Column, text: Column) -> Column:
    """M2: a page from the lines of its front matter and its body."""
    return F.concat(F.lit("---\n"), front_yaml, F.lit("---\n"), trim(text), F.lit("\n"))


# ---------------------------------------------------------------- Markdown
def title(front: Column, text: Column, fallback: Column) -> Column:
    """M3: front-matter title, else the first H1, else ``fallback``."""
    safe = readable_or(fallback, F.lit("未命名页面"))
    own = trim(F.coalesce(front_string(front, "title"), F.lit("")))
    h1 = trim(F.regexp_extract(text, "(?m)^#\\s+(.+)$", 1))
    return F.when(own != "", readable_or(own, safe)).when((h1 != "") & ~is_unknown(h1), readable_or(h1, safe)).otherwise(safe)


def linkable(text: Column) -> Column:
    """M6: the text without fenced blocks and inline code.

    A fold over the lines: an opening fence is closed by one of its own character, at least as long, with
    nothing behind it.
    """
    lines = F.split(text, "\\r?\\n")
    zero = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, "^ {0,3}(`{3,}|~{3,})(.*)$", 1)
        rest = trim(F.regexp_extract(line, "^ {0,3}(`{3,}|~{3,})(.*)$", 2))
        fence = acc["fence"]
        closes = (mark != "") & (F.substring(mark, 1, 1) == F.substring(fence, 1, 1)) & (F.length(mark) >= F.length(fence)) & (rest == "")
        now = F.when(fence != "", F.when(closes, F.lit("")).otherwise(fence)).otherwise(mark)
        kept = F.when((fence != "") | (mark != ""), F.lit("")).otherwise(F.regexp_replace(line, "(`+)[\\s\\S]*?\\1", ""))
        return F.struct(now.alias("fence"), F.concat(acc["out"], F.array(kept)).alias("out"))

    return F.aggregate(lines, zero, step, lambda acc: F.array_join(acc["out"], "\n"))


def wiki_links(text: Column) -> Column:
    """M4: distinct targets of wiki links outside code, in order."""
    found = F.regexp_extract_all(linkable(text), F.lit("\\[\\[([^\\]|#]+)(?:#[^\\]|]+)?(?:\\|[^\\]]+)?\\]\\]"), 1)
    return F.filter(F.array_distinct(F.transform(found, trim)), lambda x: x != "")


def markdown_links(text: Column) -> Column:
    """M5: distinct local targets of Markdown links outside code."""
    found = F.regexp_extract_all(linkable(text), F.lit("\\[[^\\]]+\\]\\(([^)]+)\\)"), 1)
    return F.filter(F.array_distinct(F.transform(found, trim)), lambda x: (x != "") & ~x.startswith("http"))


# The marks that plain text is without, and how a note block of a topic page is written.
PLAIN_TEXT_STEPS = (
    ("!\\[[^\\]]*\\]\\([^)]*\\)", ""),
    ("\\[\\[(?:[^\\]|]+\\|)?([^\\]|]+)\\]\\]", "$1"),
    ("\\[([^\\]]+)\\]\\([^)]*\\)", "$1"),
    ("(?m)^ {0,3}(?:`{3,}|~{3,})[^\\n]*$", ""),
    ("(?m)^ {0,3}(?:#{1,6}\\s+|>\\s*|[-*+]\\s+|\\d+[.)]\\s+)", ""),
    ("(`+)([^`]+)\\1", "$2"),
    ("\\*\\*([^*]+)\\*\\*", "$1"),
    ("__([^_]+)__", "$1"),
)
NOTE_BLOCK = "(?m)^###\\s+([^\\n]+)\\n(?:\\s*\\n)?来源：[^\\n]*\\n来源路径：`([^`]+)`[^\\n]*\\n([\\s\\S]*?)(?=^#{1,3}\\s|(?![\\s\\S]))"


def plain_text(text: Column) -> Column:
    """M7: Markdown without its marks."""
    for pattern, to in PLAIN_TEXT_STEPS:
        text = F.regexp_replace(text, pattern, to)
    return text


def inline_source_paths(text: Column) -> Column:
    """F32: source paths that notes name."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("来源路径：`([^`]+)`"), 1), trim), lambda x: x != "")


def source_notes(text: Column) -> Column:
    """The note blocks of a topic page as (heading, path, text)."""
    part = lambda i: F.regexp_extract_all(text, F.lit(NOTE_BLOCK), i)
    return F.arrays_zip(part(1).alias("heading"), part(2).alias("path"), part(3).alias("text"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "([\\\\`*_\\[\\]<>])", "\\\\$1")


def blockquote(text: Column, most: int = 24) -> Column:
    lines = F.slice(F.filter(F.split(text, "\\n"), lambda x: x != ""), 1, most)
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("> "), x)), "\n")


def bullet_list(items: Column) -> Column:
    some = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) > 0, some).otherwise(F.lit("_暂无_"))


def wiki_link(path: Column, label: Column) -> Column:
    return F.concat(F.lit("[["), path, F.lit("|"), trim(F.regexp_replace(label, "[\\[\\]|]", " ")), F.lit("]]"))


def table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table, rows padded to the widest."""
    width = F.greatest(F.lit(1), F.array_max(F.transform(rows, lambda r: F.size(r))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    out = F.transform(rows, lambda r: line(pad(r)))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(out, 1, 1), F.array(rule), F.slice(out, 2, F.greatest(F.size(out), F.lit(1)))), "\n")).otherwise("")


# What an extracted document's plain text is without.
EXTRACTED_MARKS = (("!\\[[^\\]]*\\]\\([^)]+\\)", " "), ("\\[([^\\]]+)\\]\\([^)]+\\)", "$1"), ("(?m)^#{1,6}\\s+", ""), ("[`*_>|-]", " "))


def extracted_plain_text(text: Column) -> Column:
    """M8: the plain text of an extracted document: pictures, link targets, heading marks and emphasis go."""
    for pattern, to in EXTRACTED_MARKS:
        text = F.regexp_replace(text, pattern, to)
    return normalize(text)


def normalize_markdown(text: Column) -> Column:
    """M9: line feeds only, at most one empty line in a row, no space around."""
    return trim(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n"))


def replace_top_heading(text: Column, heading: Column) -> Column:
    """The text under another first H1; without one, the heading goes on top."""
    old = F.regexp_extract(text, "(?m)^# +[^\\n]*$", 0)
    at = F.position(old, text)
    swapped = F.concat(F.left(text, at - 1), F.lit("# "), heading, F.right(text, F.length(text) - at - F.length(old) + 1))
    return F.when(old == "", F.concat(F.lit("# "), heading, F.lit("\n\n"), text)).otherwise(swapped)


# ---------------------------------------------------------------- HTML
def html_to_text(page: Column) -> Column:
    """An HTML or XML page as text, without scripts, styles and tags."""
    page = F.regexp_replace(page, "(?i)<script[\\s\\S]*?</script>", " ")
    page = F.regexp_replace(page, "(?i)<style[\\s\\S]*?</style>", " ")
    return normalize(F.regexp_replace(page, "<[^>]+>", " "))


def html_title(page: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_extract(page, "(?is)<title[^>]*>(.*?)</title>", 1), SPACES, " "))


def html_links(page: Column) -> Column:
    """Distinct href targets in order."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit("(?i)href=\"([^\"]*)\""), 1))


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """M16."""
    return text.map(lambda t: None if t is None else html.unescape(t))


# ---------------------------------------------------------------- text to Markdown, titles of plain text
def text_to_markdown(text: Column, heading: Column) -> Column:
    """M11."""
    return F.concat(F.lit("# "), readable_or(heading, F.lit("未命名来源")), F.lit("\n\n"), normalize(text))


def _clean_title_line(line: Column) -> Column:
    t = F.regexp_replace(readable_or(line, F.lit("")), "^[\"'“”‘’《》]+|[\"'“”‘’《》]+$", "")
    return F.when(is_unknown(line), F.lit("")).otherwise(F.substring(trim(t), 1, 120))


def title_from_text(text: Column, fallback: Column) -> Column:
    """A heading, else the first line that reads like a title."""
    safe = readable_or(fallback, F.lit("未命名来源"))
    heading = _clean_title_line(trim(F.regexp_extract(text, "(?m)^#\\s+(.+)$", 1)))
    lines = F.transform(
        F.split(text, "\\r?\\n"), lambda x: trim(F.regexp_replace(F.regexp_replace(x, "^>\\s*", ""), "^[#*\\-`_>\\s]+|[#*\\-`_>\\s]+$", ""))
    )
    likely = F.filter(
        lines,
        lambda x: F.length(x).between(4, 120)
        & ~is_unknown(x)
        & ~x.rlike("(?i)^(目录|目\\s*录|table of contents)$")
        & ~x.rlike("^(第[一二三四五六七八九十百千万0-9]+[章节条]|[一二三四五六七八九十0-9]+[、.．])")
        & ~x.rlike("(?i)^(url|source|来源文件|文件|大小)\\s*[:：]")
        & x.rlike("[\\p{IsHan}A-Za-z]"),
    )
    line = F.coalesce(_clean_title_line(F.coalesce(F.get(likely, F.lit(0)), F.lit(""))), F.lit(""))
    return F.when((heading != "") & (heading != safe), heading).when(line != "", line).otherwise(safe)


def column_index(reference: Column) -> Column:
    """Zero-based column of a cell reference such as ``AB12``."""
    letters = F.split(F.upper(F.regexp_extract(reference, "^([A-Za-z]+)", 1)), "")
    letters = F.filter(letters, lambda x: x != "")
    return F.aggregate(letters, F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1


def same_json(a: Column, b: Column) -> Column:
    """Whether two values are equal as JSON."""
    return F.to_json(a) == F.to_json(b)


def nested_field(payload: Column, path: str) -> Column:
    """A value of a JSON document by dotted path."""
    return F.get_json_object(payload, f"$.{path}")


def first_json_object(text: Column, schema: str) -> Column:
    """The JSON object in a reply, fenced or bare."""
    fenced = F.regexp_extract(text, "```(?:json)?\\s*([\\s\\S]*?)```", 1)
    bare = F.regexp_extract(text, "(\\{[\\s\\S]*\\})", 1)
    return F.from_json(F.when(fenced != "", trim(fenced)).otherwise(bare), schema)


def display_title(raw: Column, kind: Column, content: Column, derived: Column) -> Column:
    """a readable title for a page whose own says nothing."""
    from folioforge.functions.text import is_low_information

    own = readable_or(raw, F.lit(""))
    notes = F.concat(
        F.regexp_extract_all(content, F.lit("(?m)^###\\s+(.+)$"), 1), F.regexp_extract_all(content, F.lit("来源：\\[\\[([^\\]|#]+)(?:#[^\\]|]+)?(?:\\|[^\\]]+)?\\]\\]"), 1)
    )
    notes = F.slice(F.array_distinct(F.filter(F.transform(notes, lambda x: readable_or(trim(F.regexp_replace(x, "`", "")), F.lit(""))), lambda x: x != "")), 1, 8)
    notes = F.filter(notes, lambda x: ~is_low_information(x))
    tail = F.concat(F.lit("（"), raw, F.lit("）"))
    first = F.get(notes, F.lit(0))
    topic = (
        F.when(F.size(notes) == 1, F.concat(first, tail))
        .when(F.size(notes) > 1, F.concat(first, F.lit("等 "), F.size(notes).cast("string"), F.lit(" 个来源"), tail))
        .when(derived != "", F.concat(derived, tail))
        .otherwise(F.concat(F.when(kind == "concept", F.lit("未命名概念")).otherwise(F.lit("未命名实体")), tail))
    )
    section = F.when(kind == "query", F.lit("查询")).when(kind == "research", F.lit("研究")).when(kind == "source", F.lit("来源")).otherwise(F.lit("页面"))
    other = F.when(derived != "", derived).otherwise(F.concat(section, tail))
    return F.when((own != "") & ~is_low_information(own), own).otherwise(F.when(kind.isin("concept", "entity"), topic).otherwise(other))


def index_document(text: Column, front: Column) -> Column:
    """Content of an external index: readable plain text."""
    return let(body(text, front), lambda b: clean_unknown(plain_text(b)))
