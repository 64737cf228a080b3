"""Columns for people and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.paths import RAW_TEXT, base_name, extension
from folioforge.functions.text import clean_unknown, is_unknown, readable_or

MAX_ATTACHMENTS = 6
MAX_ATTACHMENT_CHARS = 24_000


def format_bytes(size: Column) -> Column:
    """1536 as ``1.5 KB``."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(size >= 1024**power, F.concat(F.format_number(size / 1024**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_time(ts: Column) -> Column:
    """F36."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def needs_review(title: Column, summary: Column, error: Column) -> Column:
    """P20: something in a record cannot be read or failed."""
    odd = lambda c: F.coalesce(is_unknown(c) | c.rlike("字符无法识别|无法识别|\\ufffd|\\?{3,}"), F.lit(False))
    return odd(title) | odd(summary) | (F.coalesce(error, F.lit("")) != "")


def rewrite_media(markdown: Column, folder: Column) -> Column:
    """Relative media links of an extracted document, below ``folder``."""
    return F.regexp_replace(markdown, F.lit("(!\\[[^\\]]*\\]\\()(?:\\./)?(media/[^)\\s]+)\\)"), F.concat(F.lit("$1"), folder, F.lit("/$2)")))


# What an evidence prompt says, by the evidence that there is.
SCOPES = {"both": "当前知识库和联网搜索结果", "local": "当前知识库", "web": "联网搜索结果", "none": "普通回答上下文"}
ANSWER_MODES = {
    "both": "请结合当前知识库和联网搜索结果回答问题；知识库是主要依据，联网搜索用于补充、核对或说明最新信息。",
    "local": "请基于当前知识库和用户附件回答问题；如果材料不足，请明确说明当前知识库证据不足。",
    "web": "当前知识库没有相关内容；请基于联网搜索结果和用户附件回答问题，并明确说明外部来源。",
    "given": "当前知识库没有相关内容；请基于用户附件回答问题，附件以外无法确认的内容要说明不确定。",
    "searched": "当前知识库没有相关内容，也没有获取到可用联网搜索结果；请在明确说明这一点后，基于模型通用知识正常回答。",
    "none": "当前知识库没有相关内容；请在明确说明这一点后，基于模型通用知识正常回答。",
}
SYSTEM_MODES = {
    "both": "优先使用当前知识库；联网搜索只能作为补充和交叉验证。回答中需要区分知识库依据和联网补充。",
    "local": "你必须严格基于当前知识库和用户附件回答。材料没有说到的内容，要说明当前知识库证据不足，不要编造。",
    "web": "当前知识库没有相关内容。可以基于联网搜索结果回答，但必须说明这些结论来自联网搜索，不是知识库依据。",
    "given": "当前知识库没有相关内容。可以基于用户附件回答；附件没有提供的内容要说明不确定。",
    "none": "当前知识库没有相关内容，也没有可用联网搜索结果。你可以基于通用知识正常回答，但必须明确说明该部分不是知识库依据；不确定的信息要标注不确定。",
}


def numbered_hits(hits: Column, before: Column | int = 0) -> Column:
    """array<struct<title, path, excerpt>> as evidence, numbered on from ``before``."""
    first = F.lit(before) if isinstance(before, int) else before
    line = lambda h, i: F.concat(F.lit("["), (first + i + 1).cast("string"), F.lit("] "), h["title"], F.lit(" ("), h["path"], F.lit(")\n"), h["excerpt"])
    return F.array_join(F.transform(hits, line), "\n\n")


def evidence_context(local: Column, web: Column) -> Column:
    """Local evidence, then that of the web, in one numbering."""
    here = F.when(F.size(local) > 0, F.concat(F.lit("当前知识库：\n"), numbered_hits(local))).otherwise(F.lit("当前知识库：没有检索到相关内容。"))
    beyond = F.concat(F.lit("联网搜索结果：\n"), numbered_hits(web, F.size(local)))
    there = F.when(F.size(web) > 0, beyond).otherwise(F.lit("联网搜索结果：没有获取到可用结果，可能未联网或未配置外部搜索服务。"))
    return F.concat(here, F.lit("\n\n"), there)


def evidence_case(local: Column, web: Column, given: Column | None = None, searched: Column | None = None) -> Column:
    """Which evidence there is: both, local, web, else given by the user, else searched for in vain, else none."""
    here, there = F.size(local) > 0, F.size(web) > 0
    out = F.when(here & there, "both").when(here, "local").when(there, "web")
    for name, also in (("given", given), ("searched", searched)):
        out = out if also is None else out.when(also, name)
    return out.otherwise("none")


def by_case(case: Column, texts: dict[str, str]) -> Column:
    """The text for a case of ``evidence_case``; a case that has none of its own is ``none``."""
    table = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return F.coalesce(F.try_element_at(table, case), F.lit(texts["none"]))


def attachments(items: Column) -> Column:
    """The first usable attachments (name, kind, text) of a message, their texts shortened."""
    good = F.filter(items, lambda a: F.coalesce(a["name"], F.lit("")) != "")
    return F.transform(F.slice(good, 1, MAX_ATTACHMENTS), lambda a: F.struct(a["name"].alias("name"), a["kind"].alias("kind"), F.substring(a["text"], 1, MAX_ATTACHMENT_CHARS).alias("text")))


# What is shown of a source that is no text.
NO_NAME = "非文本文件"
NOT_TEXT = ("这个原文是 ", " 文件，不能按纯文本直接打开。为了避免页面显示乱码，系统已隐藏二进制内容。")
SEE_PAGES = "请回到文件管理页打开“全文”或“来源页”查看抽取后的可读内容。"
CONVERTED, PAGE = "- 已抽取全文：", "- 来源页："


def raw_preview(path: Column, text: Column, name: Column | None = None, kind: Column | None = None, converted: Column | None = None, page: Column | None = None) -> Column:
    """The text of a raw source, runs of unknown characters marked; for a type that is no text a notice that names what was made of it."""
    name = base_name(path) if name is None else F.coalesce(F.nullif(name, F.lit("")), base_name(path))
    kind = F.lit("binary") if kind is None else F.coalesce(F.nullif(kind, F.lit("")), F.lit("binary"))
    line = lambda label, c: [] if c is None else [F.concat(F.lit(label), F.nullif(c, F.lit("")))]
    head = [F.concat(F.lit("# "), readable_or(name, F.lit(NO_NAME))), F.concat(F.lit(NOT_TEXT[0]), kind, F.lit(NOT_TEXT[1])), F.lit(SEE_PAGES)]
    notice = F.concat_ws("\n", *head, *line(CONVERTED, converted), *line(PAGE, page))  # a line without a value is left out
    return F.when(extension(path).isin(*RAW_TEXT), clean_unknown(text)).otherwise(notice)
