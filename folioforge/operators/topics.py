"""Topic pages: notes aggregated by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.markdown import bullet_list, wiki_link
from folioforge.functions.text import content_paragraphs, is_low_information, let, nfkc, readable_or, trim

MAX_NOTES = 3000
#: Parts that a topic's notes are ranked in before they meet.
PARTS = 16
EVIDENCE, EVIDENCE_CHARS = 3, 700
DEFINES = "(?i)(?:是指|指的是|means(?![A-Za-z0-9_])|refers to(?![A-Za-z0-9_]))"
NO_NOTE = "_当前来源没有提供可用的正文说明，请查看原始文件或转换全文。_"
WAITING = "_等待更多来源沉淀。_"
RECENT, LISTED = 20, 25
SUMMARIES, SUMMARY_CHARS = 12, 180


def topic_key(title: Column) -> Column:
    """titles that differ in compatibility form or case only are one topic."""
    return F.lower(trim(nfkc(title)))


def folded(lines: Column) -> Column:
    """The lines with their place, whether they define nothing, and as topics are looked for in them.  Computed once a document, whatever its number of topics."""
    # Names are given outright: those of aliases are lost where a lambda is a column of its own.
    named = lambda **fields: F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    return F.transform(lines, lambda x, i: named(r=~x.rlike(DEFINES), i=i, x=x, fold=F.lower(nfkc(x))))


def evidence(key: Column, folds: Column) -> Column:
    """The lines about a topic - else all - definitions first, three at most, shortened."""
    about = F.filter(folds, lambda s: F.contains(s["fold"], key))
    ranked = F.sort_array(let(about, lambda a: F.when(F.size(a) > 0, a).otherwise(folds)))
    few = F.transform(F.slice(ranked, 1, EVIDENCE), lambda s: s["x"])
    return F.transform(few, lambda x: F.when(F.length(x) > EVIDENCE_CHARS, F.concat(F.substring(x, 1, EVIDENCE_CHARS), F.lit("…"))).otherwise(x))


def notes(sources: DataFrame, topics: str, kind: str) -> DataFrame:
    """One row per (topic, source): ``sources`` has path, title, text, ord and the array ``topics``.

    Evidence is cut where the text is, so what is shuffled is three short paragraphs a topic at most; a plan that
    does not ask for them does not look at the text.
    """
    each = sources.select("path", "title", "ord", content_paragraphs(F.col("text")).alias("lines"), topics)
    # Folded below the explosion, which is an outer one: Spark would ask an inner one's array for its size, and so make it twice.
    each = each.withColumn("folds", folded(F.col("lines"))).select("path", "title", "ord", "folds", F.explode_outer(topics).alias("topic"))
    each = each.withColumn("topic", readable_or(F.col("topic"), F.lit("")))
    each = each.withColumn("key", topic_key(F.col("topic"))).filter((F.col("topic") != "") & ~is_low_information(F.col("topic")))
    each = each.withColumn("kind", F.lit(kind)).withColumn("evidence", evidence(F.col("key"), F.col("folds")))
    first = lambda c: F.min_by(c, "ord").alias(c)
    one = each.groupBy("kind", "key", "path").agg(first("topic"), first("title"), F.min("ord").alias("ord"), first("evidence"))
    return one.select("kind", "key", "path", "topic", "title", "ord", "evidence")


def find_or_create(noted: DataFrame, existing: DataFrame, slug_of) -> DataFrame:
    """Each topic with the page it has - ``existing`` (kind, key, page) - or a new one."""
    topics = noted.groupBy("kind", "key").agg(F.min_by("topic", F.struct("ord", "topic")).alias("topic"))
    folder = F.when(F.col("kind") == "concept", "concepts").otherwise("entities")
    page = F.concat(F.lit("wiki/"), folder, F.lit("/"), slug_of(F.col("topic")), F.lit("-"), F.substring(F.sha2("key", 256), 1, 6), F.lit(".md"))
    return topics.join(existing, ["kind", "key"], "left").withColumn("created", F.col("page").isNull()).withColumn("page", F.coalesce("page", page))


def merge(noted: DataFrame, before: DataFrame | None = None, most: int = MAX_NOTES) -> DataFrame:
    """(kind, key, topic, sources, notes) - one note per source in order, at most ``most`` a topic.

    ``before`` holds the notes of earlier runs; a source noted before keeps its place, and gets its
    evidence now if it had none.  Notes that carry the ``run`` they came in stand in the order of runs.
    """
    now = noted.withColumn("_new", F.col("run").cast("int") if "run" in noted.columns else F.lit(1)).drop("run")
    every = now if before is None else before.withColumn("_new", F.lit(0)).unionByName(now)
    held = F.struct((F.size("evidence") == 0).cast("int").alias("empty"), "_new")
    one = every.groupBy("kind", "key", "path").agg(F.min_by(F.struct("topic", "title", "evidence"), held).alias("n"), F.min(F.struct("_new", "ord")).alias("at"))
    # Ranked and cut before they are collected, first in parts: a topic that most sources have is never in one task whole.
    one = one.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(PARTS)))
    for by in (["kind", "key", "part"], ["kind", "key"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("at", "path"))
        one = one.withColumn("place", place).filter(F.col("place") <= most)
    listed = F.sort_array(F.collect_list(F.struct("place", "path", F.col("n.title").alias("title"), F.col("n.evidence").alias("evidence"))))
    out = one.groupBy("kind", "key").agg(F.min_by("n.topic", "place").alias("topic"), listed.alias("l"))
    return out.select(
        "kind", "key", "topic", F.transform("l", lambda x: x["path"]).alias("sources"), F.transform("l", lambda x: F.struct(x["path"], x["title"], x["evidence"])).alias("notes")
    )


def render(merged: DataFrame) -> DataFrame:
    """K7: the Markdown of each topic page."""
    first = F.get(F.filter("notes", lambda n: F.size(n["evidence"]) > 0), F.lit(0))
    definition = F.when(first.isNull(), F.lit(WAITING)).otherwise(F.array_join(F.transform(first["evidence"], lambda x: F.concat(F.lit("> "), x)), "\n\n"))
    block = lambda n: F.concat(
        F.lit("### "), n["title"], F.lit("\n\n来源："), wiki_link(n["path"], n["title"]), F.lit("\n来源路径：`"), n["path"], F.lit("`\n\n"),
        F.when(F.size(n["evidence"]) > 0, F.array_join(n["evidence"], "\n\n")).otherwise(F.lit(NO_NOTE)),
    )
    body = F.concat(F.lit("# "), F.col("topic"), F.lit("\n\n## 定义\n\n"), definition, F.lit("\n\n## 来源笔记\n\n"), F.array_join(F.transform("notes", block), "\n\n"))
    return merged.withColumn("body", body)


def index_page(pages: DataFrame) -> DataFrame:
    """The index as one row of Markdown; each list is cut before it is collected."""
    listed = lambda rows, order, n: rows.orderBy(*order).limit(n)
    recent = listed(pages.filter("type <> 'index' AND path <> 'wiki/log.md'"), [F.desc("mtime"), F.asc("ord")], RECENT).withColumn("part", F.lit(0))
    concepts = listed(pages.filter("type = 'concept'"), [F.asc("ord")], LISTED).withColumn("part", F.lit(1))
    sources = listed(pages.filter("type = 'source'"), [F.asc("ord")], LISTED).withColumn("part", F.lit(2))
    link = wiki_link(F.col("path"), F.col("title"))
    line = F.when(F.col("part") == 0, F.concat(link, F.lit(" - "), F.col("type"))).otherwise(link)
    order = F.struct("part", F.when(F.col("part") == 0, -F.unix_micros("mtime")).otherwise(F.lit(0)).alias("t"), "ord", line.alias("line"))
    all_ = recent.unionByName(concepts).unionByName(sources).agg(F.sort_array(F.collect_list(order)).alias("l"))
    part = lambda i: bullet_list(F.transform(F.filter("l", lambda x: x["part"] == i), lambda x: x["line"]))
    return all_.select(F.concat(F.lit("# 知识库索引\n\n## 最近更新\n\n"), part(0), F.lit("\n\n## 概念\n\n"), part(1), F.lit("\n\n## 来源\n\n"), part(2)).alias("body"))


def overview(pages: DataFrame) -> DataFrame:
    """Counts and the newest sources' summaries (pages has path, title, type, mtime, summary, ord)."""
    counts = pages.agg(F.count_if(F.col("type") == "source").alias("s"), F.count_if(F.col("type") == "concept").alias("c"))
    short = F.substring(F.regexp_replace(F.coalesce("summary", F.lit("")), "\\s+", " "), 1, SUMMARY_CHARS)
    line = F.concat(F.lit("- "), wiki_link(F.col("path"), F.col("title")), F.lit(": "), short)
    newest = pages.filter("type = 'source'").orderBy(F.desc("mtime"), "ord").limit(SUMMARIES)
    lines = newest.agg(F.sort_array(F.collect_list(F.struct((-F.unix_micros("mtime")).alias("t"), "ord", line.alias("line")))).alias("l"))
    both = counts.crossJoin(lines)  # one row each
    shown = F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).otherwise(F.lit("_还没有来源。_"))
    body = F.concat(F.lit("# 知识库总览\n\n## 当前结构\n\n- 来源页："), F.col("s").cast("string"), F.lit("\n- 概念页："), F.col("c").cast("string"), F.lit("\n\n## 最近来源摘要\n\n"), shown)
    return both.select(body.alias("body"))
