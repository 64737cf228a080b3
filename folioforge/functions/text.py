"""Text quality, titles, tokens, sentences and excerpts as native Column expressions.

Everything here stays inside the JVM.  Lengths are code points.  White space follows ECMAScript: Java's
``\\s`` plus the no-break, ideographic and other Unicode spaces and the byte-order mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as tokens, the placeholder for unreadable runs, and cue words.
STOP_WORDS = (
    "the and for with that this from are was were have has into about their your you they "
    "它 和 与 或 的 了 在 是 为 对 中 及 一个 我们 可以 通过 字符无法识别 无法识别 未识别"
).split()
PLACEHOLDER = "（字符无法识别）"
GARBLED = "锟斤拷"
UNREADABLE = "原文包含无法识别字符|问题内容包含无法识别字符|字符无法识别|无法识别的问题"
#: What the placeholder and all messages about unreadable text have in common.
UNREADABLE_CORE = "无法识别"
HIDDEN = "[已隐藏]"
LEADING_FUNCTION_WORDS = "的 了 而 把 不是 可以 通过".split()
FILE_WORDS = "url uri http https html markdown md txt pdf doc docx".split()
UNITS = "mm cm m km kg g mg in px pt kb mb gb 年 月 日".split()
UNNAMED = "untitled unnamed unknown page source file document".split()
UNNAMED_HAN = "未命名 无法识别 未知".split()
UNNAMED_HAN_KINDS = "页面 来源 概念 实体 问题".split()
CUES = "是指 指的是 应当 不得 必须 规定 负责".split()
QUERY_STOP_WORDS = (
    "什么 哪些 如何 怎么 怎样 为何 为什么 是否 需要 应该 可以 有关 关于 注意事项 事项 注意 要求 规定 办法 条例 问题 内容 知识库"
).split()
QUERY_SPLIT_WORDS = "什么 哪些 如何 怎么 怎样 为何 为什么 是否 需要 应该 可以 有关 关于 事项 问题 内容 知识库".split()
QUERY_SPLIT_CHARS = "的吗呢吧了和与或及在是有要"
#: Words that make a piece of a question useless as a token.
QUESTION_WORDS = "什么 哪些 如何 怎么 怎样 为何 为什么 是否 有关 关于 事项 问题 内容 知识库".split()

_WS = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
SPACES = f"[{_WS}]+"
#: The same as characters.
_BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What compatibility composition may change: anything but ASCII and most of Latin-1, which stand as they are.  Characters one
#: by one, since a class of many ranges is slow.
_COMPOSED = "[^\\x00-\\x7f" + "".join(f"\\x{c:02x}" for c in range(0x80, 0x100) if chr(c) not in "\u00a0¨ª¯²³´µ¸¹º¼½¾") + "]"
HAN = "\\p{IsHan}"
#: Looking a character's script up is slow, so Latin tokens come first and nothing below the first Han character is looked up.
TOKEN = f"([a-z0-9][a-z0-9-]{{2,}}|(?=[\\u2e80-\\x{{3ffff}}]){HAN}{{2,}})"
#: A capitalised phrase; look-arounds instead of \b, whose notion of a letter differs between engines.
PHRASE = "((?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]*(?:\\s+[A-Z][A-Za-z0-9]*){0,4}(?![A-Za-z0-9_]))"
QUOTED = ("《([^》]{2,40})》", "“([^”]{2,40})”", "「([^」]{2,40})」")
# Patterns that decide what counts as unreadable, as a label, as a title and as prose.
QUESTION_RUN = "\\?{3,}"
REPLACEMENT_RUN = f"(?:\\ufffd+|{GARBLED})+"
PLACEHOLDER_RUN = f"(?:{PLACEHOLDER}[ \\t\\u00a0，,。；;、]*){{2,}}"
MARKS_AND_SIGNS = f"[?\\ufffd{_WS}\"'`~!！.,，。:：;；、\\-_\\[\\]()（）{{}}<>《》|/\\\\]+"
LABEL_SIGNS = f"[{_WS}._\\-:：/\\\\()\\[\\]{{}}<>《》「」,，。;；、]+"
LABEL_UNNAMED = f"(?i)^(?:{'|'.join(UNNAMED)})(?:[-_\\s]?[a-z0-9]{{3,}})?$"
LABEL_UNNAMED_HAN = f"^(?:{'|'.join(UNNAMED_HAN)})(?:{'|'.join(UNNAMED_HAN_KINDS)})?$"
LABEL_HEX = "^[a-f0-9]{6,}$"
LABEL_QUANTITY = f"(?i)^[0-9]+(?:{'|'.join(UNITS)})?$"
LABEL_DATE = "^[0-9]{4}[-/]?[0-9]{1,2}[-/]?[0-9]{0,2}$"
LABEL_CODES = (("(?i)^[0-9]+[a-z]{1,4}[0-9]*$", 10), ("(?i)^[0-9]+[a-z]+[0-9]+[a-z]*$", 12))
TITLE_LABELS = ("^#+\\s*", "^[*-]\\s*", "^来源(?:文件|路径)?[:：]\\s*", "^标题[:：]\\s*", "[`*_<>]")
TITLE_URL = "(?i)^https?://|^url\\s*:"
NO_PROSE = (
    "^(?:#{1,6}\\s|\\[\\[|_.*_$)",  # one anchor for all: with one each, every place of a line is tried
    "(?i)^(?:url|https?://|来源(?:文件|路径)?\\s*[:：]|标题\\s*[:：])",
    "^(?:来源 .+ 已加入知识库。$|原文包含无法识别字符)",
    "^第[一二三四五六七八九十百零〇0-9]+[章节编]\\s*[^。！？]*$",
)
PROSE = ("[。！？；.!?;]", f"(?i)(?:{'|'.join(CUES)}|means(?![A-Za-z0-9_])|refers to(?![A-Za-z0-9_]))")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return trim(F.regexp_replace(c, SPACES, " "))


# ---------------------------------------------------------------- readability
def clean_unknown(c: Column) -> Column:
    """runs of unreadable marks become one placeholder.  Text without any is passed on after one look."""
    out = F.regexp_replace(c, QUESTION_RUN, PLACEHOLDER)
    out = F.regexp_replace(out, REPLACEMENT_RUN, PLACEHOLDER)
    out = F.regexp_replace(out, PLACEHOLDER_RUN, PLACEHOLDER)
    return F.when(has_marks(c), out).otherwise(c)


def has_marks(c: Column) -> Column:
    """Whether anything unreadable is in the text: plain searches, since most text has nothing of the kind."""
    return c.contains("???") | c.contains("\ufffd") | c.contains(GARBLED) | c.contains(UNREADABLE_CORE)


def normalize(c: Column) -> Column:
    """F1.  Plain searches say first whether there is anything to replace."""
    c = F.replace(F.replace(clean_unknown(c), F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit(" "))
    c = let(c, lambda t: F.when(t.contains("  ") | t.contains("\u00a0"), F.regexp_replace(t, "[ \\u00a0]{2,}", " ")).otherwise(t))
    return trim(let(c, lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, "\\n{3,}", "\n\n")).otherwise(t)))


def is_unknown(c: Column) -> Column:
    """at least two unreadable marks, and nothing or hardly anything else."""

    def judge(v: Column) -> Column:
        marks = F.regexp_count(v, F.lit("\\?")) + F.regexp_count(v, F.lit("\\ufffd")) + 3 * F.regexp_count(v, F.lit(GARBLED))
        rest = F.regexp_replace(v, MARKS_AND_SIGNS, "")
        rest = trim(F.regexp_replace(rest, GARBLED, ""))
        thin = (marks / F.greatest(F.length(v), F.lit(1)) >= 0.45) & ~rest.rlike(f"[{HAN}A-Za-z0-9]")
        return (v != "") & (marks >= 2) & ((rest == "") | thin)

    # Two marks at least: most text has none, and that is seen first.
    return (c.contains("?") | c.contains("\ufffd") | c.contains(GARBLED)) & let(trim(c), judge)


def readable_or(c: Column, fallback: Column) -> Column:
    """F4.  What is judged is named first: inside a lambda Spark evaluates every mention of an expression anew."""

    def judge(v: Column, cleaned: Column) -> Column:
        return F.when((cleaned == "") | (cleaned == PLACEHOLDER) | is_unknown(v), fallback).otherwise(cleaned)

    return let(c, lambda v: let(squeeze(clean_unknown(v)), lambda cleaned: judge(v, cleaned)))


def _icu(c: Column, method: str, touched: str = "[^\\x00-\\x7F]") -> Column:
    """A static method of ICU's normaliser (compatibility forms) where the text has any of ``touched``."""
    out = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), c, F.lit(True))
    return F.when(c.rlike(touched), out).otherwise(c)


def nfkc(c: Column) -> Column:
    """Compatibility composition: widths, ligatures, circled digits, units and half-width kana become plain characters."""
    return _icu(c, "compose", _COMPOSED)


def nfkd(c: Column) -> Column:
    return _icu(c, "decompose")


def is_low_information(c: Column) -> Column:
    """a label that names nothing - unnamed, hexadecimal, a format, a number, a date or a code."""

    def judge(v: Column) -> Column:
        raw = trim(F.regexp_replace(F.lower(v), "\\s+markdown$", ""))
        compact = F.regexp_replace(v, LABEL_SIGNS, "")
        full = let(F.struct(raw.alias("raw"), compact.alias("c"), F.length(compact).alias("n")), lambda x: rules(v, x))
        return F.when(v.rlike("^[A-Za-z]+$"), plain(v)).otherwise(full)

    def plain(v: Column) -> Column:
        """The rules that can hold for a word of ASCII letters."""
        low = F.lower(v)
        return low.rlike(LABEL_UNNAMED) | low.rlike(LABEL_HEX) | low.isin(FILE_WORDS)

    def rules(v: Column, x: Column) -> Column:
        c, n, raw = x["c"], x["n"], x["raw"]
        digits = F.regexp_count(c, F.lit("[0-9]"))
        no_han = ~c.rlike(HAN)
        han_name = trim(F.regexp_replace(v, "(?i)\\s+Markdown$", ""))
        return (
            (v == "")
            | (v == PLACEHOLDER)
            | is_unknown(v)
            | raw.rlike(LABEL_UNNAMED)
            | han_name.rlike(LABEL_UNNAMED_HAN)
            | raw.rlike(LABEL_HEX)
            | (c == "")
            | F.lower(c).isin(FILE_WORDS)
            | c.rlike(LABEL_QUANTITY)
            | c.rlike(LABEL_DATE)
            | (c.rlike(LABEL_CODES[0][0]) & (n <= LABEL_CODES[0][1]))
            | (c.rlike(LABEL_CODES[1][0]) & (n <= LABEL_CODES[1][1]))
            | (no_han & (n <= 8) & (digits > 0) & (digits / n >= 0.45))
            | (no_han & ~c.rlike("[A-Za-z]"))
        )

    return let(trim(nfkc(clean_unknown(c))), judge)


# ---------------------------------------------------------------- titles
def clean_title(c: Column, most: int = 64) -> Column:
    """a title candidate without markup and labels; empty for urls."""
    t = readable_or(c, F.lit(""))
    for pattern in TITLE_LABELS:
        t = F.regexp_replace(t, pattern, "")
    return let(
        squeeze(t),
        lambda x: F.when(x.rlike(TITLE_URL), F.lit(""))
        .when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…")))
        .otherwise(x),
    )


def url_title(url: Column) -> Column:
    """F8: host and decoded path; for what is no url, the text without scheme and last slash."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.coalesce(F.try_url_decode(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "\\+", "%2B")), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")
    plain = F.regexp_replace(F.regexp_replace(url, "(?i)^https?://", ""), "/$", "")
    return F.when(host.isNull(), plain).otherwise(F.when(path == "", host).otherwise(F.concat(host, F.lit("/"), path)))


def headings(c: Column, most: int = 20) -> Column:
    """Markdown headings of levels 1 to 4."""
    found = F.regexp_extract_all(c, F.lit("(?m)^#{1,4}\\s+(.+)$"), 1)
    return F.slice(F.filter(F.transform(found, lambda x: trim(F.regexp_replace(x, "[#`*_]", ""))), lambda x: x != ""), 1, most)


def compact_repeat(c: Column) -> Column:
    """a phrase said twice is said once."""

    def halve(p: Column) -> Column:
        half = (F.size(p) / 2).cast("int")
        left, right = F.array_join(F.slice(p, 1, half), " "), F.array_join(F.slice(p, half + 1, half), " ")
        return F.when((F.size(p) >= 4) & (F.size(p) % 2 == 0) & (F.lower(left) == F.lower(right)), left).otherwise(c)

    # The guarded half is at least 1 wherever it is used; slice needs that everywhere.
    return F.when(F.size(F.split(c, SPACES)) >= 4, let(F.filter(F.split(c, SPACES), lambda x: x != ""), halve)).otherwise(c)


def named_phrases(c: Column) -> Column:
    """F13 without the count: capitalised phrases and quoted names, with repetitions, in order of pattern."""
    found = F.concat(F.regexp_extract_all(c, F.lit(PHRASE), 1), *[F.regexp_extract_all(c, F.lit(q), 1) for q in QUOTED])
    found = F.transform(found, lambda x: compact_repeat(trim(x)))
    return F.filter(found, lambda x: (F.length(x) >= 2) & ~F.lower(x).isin(STOP_WORDS))


def derive_title(c: Column, fallback: Column) -> Column:
    """url label, else heading, else named phrase, else first sentence, else ``fallback``."""
    good = lambda x: (x != "") & ~is_low_information(x)

    def first(options: Column) -> Column:
        return F.get(F.filter(options, good), F.lit(0))

    def derive(text: Column) -> Column:
        url = F.regexp_extract(text, "(?i)(?<![A-Za-z0-9_])(https?://[^\\s)>\\]]+)", 1)
        named = F.transform(F.slice(by_count(named_phrases(text)), 1, 8), lambda x: clean_title(x))
        from_heading = F.transform(headings(text), lambda x: clean_title(x))
        sentence = F.get(F.filter(F.split(first_paragraph(text, 120), "[。！？.!?]\\s*"), lambda x: x != ""), F.lit(0))
        # Each kind is looked for only where those before it have nothing.
        label = F.when(url != "", url_title(url)).otherwise(F.lit(""))
        return F.coalesce(first(F.array(label)), first(from_heading), first(named), first(F.array(clean_title(F.coalesce(sentence, F.lit(""))))))

    return F.coalesce(let(clean_unknown(c), derive), fallback)


# ---------------------------------------------------------------- sentences and tokens
#: Between sentences while a text is cut; a text that has it is cut piece by piece.
_MARK = "\ue0ff"
_SENTENCE_END = "(?<=[。！？])\\s*|(?<=[.!?])\\s+|\\n{2,}"


def _cut(t: Column) -> Column:
    """All pieces of a normalised text.  Ends are marked and white space is squeezed in the whole text, so pieces only lose the spaces around them."""
    whole = F.split(F.regexp_replace(F.regexp_replace(t, _SENTENCE_END, _MARK), SPACES, " "), _MARK)
    each = F.transform(F.split(t, _SENTENCE_END), squeeze)
    # A lambda: F.trim itself would be handed the place as the characters to trim.
    return F.when(t.contains(_MARK), each).otherwise(F.transform(whole, lambda x: F.trim(x)))


def _long_enough(pieces: Column) -> Column:
    return F.filter(pieces, lambda x: F.length(x) > 18)


def sentences(c: Column) -> Column:
    """F9."""
    return _long_enough(let(normalize(c), _cut))


def first_sentences(c: Column, most: int) -> Column:
    """the first ``most`` sentences.  A text is cut as far as they mostly reach, and to its end only where that has too few."""
    far = 4 * most

    def some(t: Column, pieces: Column) -> Column:
        found = _long_enough(F.transform(F.slice(pieces, 1, far), squeeze))
        return let(found, lambda f: F.when((F.size(f) >= most) | (F.size(pieces) <= far), f).otherwise(_long_enough(_cut(t))))

    return F.slice(let(normalize(c), lambda t: let(F.split(t, _SENTENCE_END, far + 1), lambda pieces: some(t, pieces))), 1, most)


def tokens(c: Column) -> Column:
    """lower-case tokens in order, with repetitions."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 1)
    lead = f"^(?:{'|'.join(LEADING_FUNCTION_WORDS)})"
    # A token that does not begin in ASCII is Han as a whole.
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS) & ((w < F.lit("{")) | ((F.length(w) <= 8) & ~w.rlike(lead))))


def _run_starts(s: Column, same: Callable[[Column, Column], Column]) -> Column:
    """0-based places in the sorted array ``s`` at which a run of equal values begins."""
    return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~same(F.get(s, i), F.get(s, i - 1)))


def word_counts(c: Column) -> Column:
    """Each token of a text once, as (n, v) with ``n`` the negative count; none for null.

    One sort of plain strings and a look at run borders, not at pairs.
    """

    def runs(s: Column) -> Column:
        start = _run_starts(s, lambda a, b: a == b)
        return let(start, lambda f: F.transform(f, lambda p, k: F.struct((p - F.coalesce(F.get(f, k + 1), F.size(s))).alias("n"), F.get(s, p).alias("v"))))

    none = F.array().cast("array<struct<n:int,v:string>>")
    return let(F.sort_array(tokens(F.coalesce(c, F.lit("")))), lambda s: F.when(F.size(s) == 0, none).otherwise(runs(s)))


def by_count(values: Column) -> Column:
    """Distinct values, the most frequent first, ties in order of first appearance."""

    def runs(s: Column) -> Column:
        start = _run_starts(s, lambda a, b: a["v"] == b["v"])
        return let(start, lambda f: F.transform(f, lambda p, k: F.struct((p - F.coalesce(F.get(f, k + 1), F.size(s))).alias("n"), F.get(s, p)["at"].alias("at"), F.get(s, p)["v"].alias("v"))))

    keyed = F.sort_array(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("at"))))
    none = F.array().cast("array<struct<n:int,at:int,v:string>>")
    counted = F.when(F.size(values) == 0, none).otherwise(let(keyed, runs))
    return F.transform(F.sort_array(counted), lambda s: s["v"])


def top_counts(c: Column, limit: int = 12) -> Column:
    """F11 with counts inside a row: the ``limit`` most frequent tokens as (n, v), ``n`` negative, ties in code-point order."""
    return F.slice(F.sort_array(word_counts(c)), 1, limit)


def top_keywords(c: Column, limit: int = 12) -> Column:
    """F11 inside a row, ties in code-point order."""
    return F.transform(top_counts(c, limit), lambda s: s["v"])


def occurrences(text: Column, token: str | Column) -> Column:
    """non-overlapping occurrences, by the bytes that go with them."""
    token = F.lit(token) if isinstance(token, str) else token
    return ((F.octet_length(text) - F.octet_length(F.replace(text, token, F.lit("")))) / F.octet_length(token)).cast("long")


def count_terms(text: Column, terms: list[str]) -> Column:
    """Occurrences of any of the terms."""
    out = F.lit(0).cast("long")
    for term in terms:
        out = out + occurrences(text, term)
    return out


def strip_bom(text: Column) -> Column:
    """Z2."""
    return F.regexp_replace(text, "^\\ufeff", "")


def excerpt_around(text: Column, query_tokens: list[str], most: int = 260) -> Column:
    """a window of ``most`` characters around the latest of the tokens' first occurrences."""
    flat = F.regexp_replace(normalize(text), "\\n", " ")

    def cut(t: Column) -> Column:
        at = F.greatest(F.lit(0), F.lit(0), *[F.locate(q, F.lower(t)) - 1 for q in query_tokens])
        return trim(F.substring(t, F.greatest(F.lit(0), at - most // 2) + 1, F.lit(most)))

    return let(flat, cut)


def _lines(normal: Column) -> Column:
    """Lines of a normalised text, without front matter and fences."""
    text = F.when(normal.startswith("---\n"), F.regexp_replace(normal, "^---\\n[\\s\\S]*?\\n---(?:\\n|$)", "")).otherwise(normal)
    fenced = lambda t: F.regexp_replace(t, "(?m)^\\s*(`{3,}|~{3,})[^\\n]*\\n[\\s\\S]*?^\\s*\\1\\s*$", "")
    text = let(text, lambda t: F.when(t.contains("```") | t.contains("~~~"), fenced(t)).otherwise(t))
    return F.split(text, "\\n+")


def _bare_line(x: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(x, "^\\s*(?:>\\s*)+", ""), "^\\s*[-*+]\\s+", ""))


def _is_prose(x: Column) -> Column:
    return (
        (F.length(x) >= 6)
        & ~x.rlike(NO_PROSE[0])
        & ~x.rlike(NO_PROSE[1])
        & ~x.rlike(NO_PROSE[2])
        & (x != PLACEHOLDER)
        & ~is_unknown(x)
        & ~x.rlike(NO_PROSE[3])
        & (x.rlike(PROSE[0]) | x.rlike(PROSE[1]))
    )


def content_paragraphs(c: Column) -> Column:
    """lines of prose, without front matter, fences, headings, labels and bare names."""
    return F.filter(F.transform(let(normalize(c), _lines), _bare_line), _is_prose)


def first_paragraph(c: Column, most: int = 520) -> Column:
    """F16.  Lines are judged up to the first of prose, blocks only where there is none."""

    def plain(n: Column) -> Column:
        blocks = F.filter(
            F.split(n, "\\n{2,}"),
            lambda x: let(
                trim(F.regexp_replace(x, "[#*>`-]", "")),
                lambda y: (F.length(y) > 12) & ~y.rlike("(?i)^url\\s*:|^https?://"),
            )
            & ~x.rlike("^\\s*(?:#{1,6}\\s|`{3,}|~{3,})"),
        )
        return F.regexp_replace(F.coalesce(F.get(blocks, F.lit(0)), n), SPACES, " ")

    def prose(n: Column) -> Column:
        judged = lambda x: let(_bare_line(x), lambda y: F.when(_is_prose(y), y))
        return F.aggregate(_lines(n), F.lit(None).cast("string"), lambda found, x: F.when(found.isNotNull(), found).otherwise(judged(x)))

    return trim(F.substring(let(normalize(c), lambda n: F.coalesce(prose(n), plain(n))), 1, most))


def strip_low_signal(c: Column) -> Column:
    """without urls, long hexadecimal runs and web words.  Simpler searches say first whether there may be any."""
    hexadecimal, words = "(?i)(?<![A-Za-z0-9_])[a-f0-9]{16,}(?![A-Za-z0-9_])", "(?i)(?<![A-Za-z0-9_])(?:www|http|https|com|github|gist)(?![A-Za-z0-9_])"
    c = F.when(c.contains("http"), F.regexp_replace(c, f"https?://[^{_WS}]+", " ")).otherwise(c)
    c = let(c, lambda t: F.when(t.rlike("[A-Fa-f0-9]{16}"), F.regexp_replace(t, hexadecimal, " ")).otherwise(t))
    may = lambda low: low.contains("www") | low.contains("http") | low.contains("com") | low.contains("github") | low.contains("gist")
    return let(c, lambda t: F.when(let(F.lower(t), may), F.regexp_replace(t, words, " ")).otherwise(t))


def clean_list(items: Column, limit: int) -> Column:
    """readable distinct items of at least two characters."""
    cleaned = F.transform(items, lambda x: readable_or(squeeze(x), F.lit("")))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda x: (F.length(x) > 1) & ~is_unknown(x))), 1, limit)


def clean_topics(items: Column, limit: int) -> Column:
    return F.slice(F.filter(clean_list(items, limit * 2), lambda x: ~is_low_information(x)), 1, limit)


def is_unreadable(c: Column) -> Column:
    """A message that says, or shows, that a text could not be read."""
    return clean_unknown(c).rlike(UNREADABLE)


def is_low_quality(title: Column, body: Column) -> Column:
    """Nothing readable, or any unreadable run at all.

    A body with a letter or digit and no mark of unreadable text cannot be: it is passed after one look, and only
    the title, which is short, is judged in full.
    """
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    both = trim(clean_unknown(F.concat_ws("\n", title, body)))
    full = let(both, lambda b: (b == "") | is_unknown(title) | is_unknown(body) | b.rlike(UNREADABLE) | (readable_or(b, F.lit("")) == ""))
    sound = body.rlike(f"[{HAN}A-Za-z0-9]") & ~has_marks(body)
    return F.when(sound, is_unknown(title) | has_marks(title)).otherwise(full)


def source_text(c: Column, most: int) -> Column:
    """text of a snippet of html; empty if it has control characters."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for name, value in (("amp", "&"), ("quot", '"'), ("#39", "'"), ("lt", "<"), ("gt", ">")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return F.when(c.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\ufffd]"), F.lit("")).otherwise(F.substring(squeeze(out), 1, most))


def diagnostic(message: Column, secrets: list[str]) -> Column:
    """an error for people - plain words for what usually fails, secrets and tokens hidden, at most 1200 characters."""
    out = message
    for secret in filter(None, secrets):
        out = F.replace(out, F.lit(secret), F.lit(HIDDEN))
    out = F.regexp_replace(F.regexp_replace(out, "(?i)Bearer\\s+[^\\s\"']+", f"Bearer {HIDDEN}"), "\\ufffd+", "[无法识别字符]")
    out = (
        F.when(message.rlike("(?i)timeout|timed out|aborted"), F.lit("请求超时，请检查服务是否运行及网络是否可达。"))
        .when(message.rlike("(?i)fetch failed|ECONNREFUSED|ENOTFOUND"), F.lit("无法连接服务，请检查地址、端口及服务是否运行。"))
        .otherwise(out)
    )
    return F.substring(out, 1, 1200)


def slug(c: Column, most: int = 80, fallback: str = "") -> Column:
    """compatibility forms without accents, lower case, anything but letters and digits a hyphen; a hash where nothing is left."""
    s = F.regexp_replace(F.lower(F.regexp_replace(nfkd(c), "[\\u0300-\\u036f]", "")), "[^\\p{L}\\p{N}]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most)
    return F.when(s == "", F.concat(F.lit(f"{fallback}-" if fallback else ""), F.substring(F.sha2(c, 256), 1, 8))).otherwise(s)
