"""Ranked lexical search, question answering and research.

A query is a literal: its tokens are found on the driver and become Column expressions, so scoring is one
pass inside whole-stage code generation and top-k is a bounded per-task heap (T1).  A row is first asked whether any
token occurs in it, then whether it is readable, and only then scored.  Windows run only after the cut to the few best
rows.

Pages: (path, title, type, body[, file_title]); hits: (path, title, type, score, excerpt, citations).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions import paths
from folioforge.functions.query import anchors, search_tokens, tokenize
from folioforge.functions.text import excerpt_around, is_low_information, is_low_quality, is_unknown, is_unreadable, occurrences, readable_or

SEARCH_LIMIT = 12
RESEARCH_LIMIT = 8
#: Most local hits in an answer, and most hits in all.
LOCAL_CAP = 8
MERGED_CAP = 12
WEAK_SCORE = 18
SHARE_OF_TOP = 0.3
EXCERPT = 260
#: No page with this many hits or fewer is dropped by a window over one query's cut result.
HIT_COLUMNS = ("path", "title", "type", "score", "excerpt", "citations")


def score(searchable: Column, title: Column, query: str, tokens: list[str] | None = None) -> Column:
    """bonus for the whole query, plus occurrences of each token weighted by length, fourfold if in the title."""
    q = query.strip().lower()
    tokens = search_tokens(query) if tokens is None else tokens
    if not tokens:
        return F.when(searchable.contains(q), F.lit(1)).otherwise(F.lit(0)).cast("long") if q else F.lit(0).cast("long")
    parts = [F.when(searchable.contains(q), F.lit(max(12, 2 * len(q)))).otherwise(F.lit(0)).cast("long")] if q else []
    for t in tokens:
        weight = F.lit(min(6, max(2, len(t)))) * F.when(F.lower(title).contains(t), F.lit(4)).otherwise(F.lit(1))
        parts.append(occurrences(searchable, t) * weight)
    return reduce(lambda a, b: a + b, parts)


def found(searchable: Column, query: str, tokens: list[str]) -> Column:
    """Whether the query or a token occurs: true exactly where the score is above zero (P7), without counting.

    One pattern for all, so that the text is lower-cased once; what contains another needle need not be looked for.
    """
    needles = [t for t in dict.fromkeys([*tokens, query.strip().lower()]) if t]
    needles = [n for n in needles if not any(m != n and m in n for m in needles)]
    return searchable.rlike("|".join(re.escape(n) for n in needles)) if needles else F.lit(False)


def _needle(text: Column, query: str, tokens: list[str]) -> Column:
    """the excerpt around the query if the text has it, else around its first token found."""
    exact = query.strip()
    low = F.lower(text)
    out = excerpt_around(text, tokenize(exact), EXCERPT)
    for t in reversed(tokens):
        out = F.when(low.contains(t), excerpt_around(text, tokenize(t), EXCERPT)).otherwise(out)
    return F.when(low.contains(exact.lower()), excerpt_around(text, tokenize(exact), EXCERPT)).otherwise(out) if exact else out


def _page_text(pages: DataFrame) -> Column:
    shown = F.col("file_title") if "file_title" in pages.columns else F.col("title")
    return F.lower(F.concat(shown, F.lit(" "), F.col("body")))


def page_hits(pages: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """C1 over pages, T1: the best ``limit`` by score, then path.  The excerpt is cut only for those."""
    tokens = search_tokens(query)
    text = _page_text(pages)
    rows = pages.filter(paths.is_evidence(F.col("path")) & found(text, query, tokens)).filter(~is_low_quality(F.col("title"), F.col("body")))
    best = rows.withColumn("score", score(text, F.col("title"), query, tokens)).orderBy(F.desc("score"), F.asc("path")).limit(limit)
    return best.select("path", "title", "type", "score", _needle(F.col("body"), query, tokens).alias("excerpt"), F.array("path").alias("citations"))


def source_rows(sources: DataFrame, query: str) -> DataFrame:
    """C1 over the registry, before any cut: ready sources of quality (P5, P6), two points more if a page exists.

    ``text`` is what the excerpt is to be cut from.
    """
    tokens = search_tokens(query)
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("fileName"))
    summary = F.coalesce("summary", F.lit(""))
    searchable = F.lower(F.concat_ws(" ", title, "fileName", "relativePath", summary))
    bad = (
        F.coalesce(is_unreadable(F.col("error")), F.lit(False))
        | is_low_quality(title, summary)
        | (is_low_information(title) & (readable_or(summary, F.lit("")) == ""))
    )
    rows = sources.filter((F.col("status") == "ready") & found(searchable, query, tokens)).filter(~bad)
    page = F.coalesce("wikiPath", "convertedPath")
    text = F.when(summary != "", summary).otherwise(F.concat_ws("\n", "fileName", "relativePath"))
    points = score(searchable, title, query, tokens) + F.when(page.isNotNull(), 2).otherwise(0)
    return rows.select(F.coalesce(page, "relativePath").alias("path"), title.alias("title"), F.col("kind").alias("type"), points.alias("score"), text.alias("text"))


def source_hits(sources: DataFrame, query: str) -> DataFrame:
    """C1 over the registry: all hits, each with its excerpt."""
    rows = source_rows(sources, query)
    return rows.select("path", "title", "type", "score", _needle(F.col("text"), query, search_tokens(query)).alias("excerpt"), F.array("path").alias("citations"))


def union_hits(*parts: DataFrame) -> DataFrame:
    """Hits of several origins, each cut before, with ``origin`` (0, 1, ...) and ``ord``, which carry first-seen order."""
    out = []
    for i, hits in enumerate(parts):
        ordered = Window.partitionBy("origin").orderBy(F.desc("score"), "path")
        out.append(hits.select(*HIT_COLUMNS).withColumn("origin", F.lit(i)).withColumn("ord", F.row_number().over(ordered)))
    return reduce(DataFrame.unionByName, out)


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """One row per path - the best-scoring, first of equals - with all citations in first-seen order."""
    seen = F.struct("origin", "ord")
    row = F.struct("title", "type", "score", "excerpt")
    best = F.struct(F.col("score").alias("s"), (-F.col("origin")).alias("o"), (-F.col("ord")).alias("r"))
    merged = hits.groupBy("path").agg(
        F.max_by(row, best).alias("hit"),
        F.min(seen).alias("first"),
        F.sort_array(F.collect_list(F.struct("origin", "ord", F.when(F.size("citations") > 0, F.col("citations")).otherwise(F.array("path")).alias("c")))).alias("all"),
    )
    cited = F.array_distinct(F.flatten(F.transform("all", lambda x: x["c"])))
    return merged.select("path", "hit.*", F.filter(cited, lambda x: x != "").alias("citations"), F.col("first.origin").alias("origin"), F.col("first.ord").alias("ord"))


def search(pages: DataFrame, query: str, sources: DataFrame | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Pages are cut to the best ``limit`` before registry hits join them; ties keep first-seen order.

    Rows of an origin are seen by score, then path, so that order is a value and no window ranks the registry's hits.
    A path's citations are the path itself in either origin.
    """
    some = page_hits(pages, query, limit).drop("citations").withColumn("origin", F.lit(0)).withColumn("text", F.lit(None).cast("string"))
    if sources is not None:
        some = some.unionByName(source_rows(sources, query).withColumn("origin", F.lit(1)).withColumn("excerpt", F.lit(None).cast("string")))
    row = F.struct("title", "type", "score", "excerpt", "text")
    merged = some.groupBy("path").agg(
        F.max_by(row, F.struct(F.col("score").alias("s"), (-F.col("origin")).alias("o"), F.col("title").alias("t"))).alias("hit"),
        F.min(F.struct("origin", (-F.col("score")).alias("behind"))).alias("first"),
    )
    best = merged.select("path", "hit.*", "first").orderBy(F.desc("score"), "first", "path").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "first", "path"))  # at most ``limit`` rows
    excerpt = F.coalesce("excerpt", _needle(F.col("text"), query, search_tokens(query)))
    best = best.withColumn("ord", place).select("path", "title", "type", "score", excerpt.alias("excerpt"), F.array("path").alias("citations"), F.col("first.origin").alias("origin"), "ord")
    return best.orderBy("ord")


def strong(hits: DataFrame, query: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits with one of the query's anchors (T16), of at least 18 points and 0.3 of the best one's.

    ``by``: columns that tell several queries' hits apart.
    """
    needed = anchors(query) if query else []
    if needed:
        text = F.lower(F.concat_ws("\n", "title", "excerpt", "path"))
        hits = hits.filter(reduce(lambda a, b: a | b, [text.contains(a) for a in needed]))
    top = F.max("score").over(Window.partitionBy(*by))
    floor = F.greatest(F.lit(WEAK_SCORE), F.floor(F.col("_top") * F.lit(SHARE_OF_TOP)))
    return hits.withColumn("_top", top).filter((F.col("_top") >= WEAK_SCORE) & (F.col("score") >= floor)).drop("_top")


def external_hits(results: DataFrame, per_query: int = 3, total: int = 12) -> DataFrame:
    """Valid results of a table (query, rank, url, title, snippet) as hits.

    At most ``per_query`` of a query and ``total`` in all; of one url the one with a snippet, first of equals.
    """
    ok = results.filter(paths.is_web_url(F.col("url")) & (F.coalesce("title", F.lit("")) != "") & F.col("snippet").isNotNull())
    first = Window.partitionBy("query").orderBy("rank")
    ok = ok.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= per_query)
    one = Window.partitionBy("url").orderBy(F.desc(F.col("snippet") != ""), "query", "rank")
    ok = ok.withColumn("_u", F.row_number().over(one)).filter("_u = 1").orderBy("query", "rank").limit(total)
    place = F.row_number().over(Window.orderBy("query", "rank"))  # at most ``total`` rows
    excerpt = F.when(F.col("snippet") != "", F.col("snippet")).otherwise(F.col("url"))
    return ok.select(
        F.col("url").alias("path"), "title", F.lit("web").alias("type"), (101 - place).cast("long").alias("score"), excerpt.alias("excerpt"), F.array("url").alias("citations")
    )


def answer(pages: DataFrame, query: str, sources: DataFrame | None = None, web: DataFrame | None = None, previous: str | None = None) -> DataFrame:
    """The evidence of an answer, at most ``LOCAL_CAP`` local hits, then external ones, at most ``MERGED_CAP``.

    A query that only points back takes ``previous``, the user's last question, as its evidence query.
    """
    from folioforge.functions.query import is_follow_up

    asked = previous if previous and is_follow_up(query.strip()) else query
    local = strong(search(pages, asked, sources), asked).orderBy(F.desc("score"), "origin", "ord").limit(LOCAL_CAP).select(*HIT_COLUMNS)
    parts = [local] + ([external_hits(web, 5)] if web is not None else [])
    return dedupe_hits(union_hits(*parts)).orderBy("origin", "ord").limit(MERGED_CAP)


def answer_text(evidence: DataFrame, local: int = 5) -> DataFrame:
    """The extractive answer - up to ``local`` excerpts of each origin - with all citations."""
    line = F.concat(F.lit("- "), F.col("title"), F.lit("："), F.col("excerpt"))
    per = Window.partitionBy("origin").orderBy("ord")
    rows = evidence.withColumn("_r", F.row_number().over(per))
    ordered = F.sort_array(F.collect_list(F.when(F.col("_r") <= local, F.struct("origin", "ord", line.alias("line")))))
    cites = F.sort_array(F.collect_list(F.struct("origin", "ord", "citations")))
    out = rows.agg(ordered.alias("l"), cites.alias("c"), F.max(F.col("origin") == 0).alias("here"), F.max(F.col("origin") > 0).alias("there"))
    scope = (
        F.when(F.col("here") & F.col("there"), F.lit("当前知识库和联网搜索结果"))
        .when(F.col("here"), F.lit("当前知识库"))
        .when(F.col("there"), F.lit("联网搜索结果"))
        .otherwise(F.lit("普通回答上下文"))
    )
    return out.select(
        scope.alias("scope"),
        F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("answer"),
        F.array_distinct(F.flatten(F.transform("c", lambda x: x["citations"]))).alias("citations"),
    )


def many_hits(pages: DataFrame, queries: list[str], limit: int = RESEARCH_LIMIT) -> DataFrame:
    """The best ``limit`` pages of each of a few queries from one scan: (query, path, title, type, score, body).

    Every page that has a token of any is scored for all queries at once; bodies are fetched for the few best only.
    """
    shown = F.lower(F.concat(F.col("title"), F.lit(" "), F.col("body")))
    asked = [(q, search_tokens(q)) for q in queries]
    any_ = found(shown, "", [x for q, t in asked for x in [*t, q.strip().lower()]])
    rows = pages.filter(paths.is_evidence(F.col("path")) & any_).filter(~is_low_quality(F.col("title"), F.col("body")))
    # The lower-cased text is a column of its own: a generator evaluates what it is given once for every use.
    low = rows.select("path", "title", shown.alias("low"))
    each = [F.struct(F.lit(i).alias("query"), score(F.col("low"), F.col("title"), q, t).alias("score")) for i, (q, t) in enumerate(asked)]
    scored = low.select("path", F.explode(F.array(*each)).alias("s")).select("path", "s.query", "s.score").filter("score > 0")
    # A limit on the rank lets each task pass on no more than that many rows of a query.
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "path"))
    best = scored.withColumn("place", rank).filter(F.col("place") <= limit)  # W7, so limit rows a query
    return pages.select("path", "title", "type", "body").join(F.broadcast(best), "path").select("path", "query", "score", "place", "title", "type", "body")


def merge_research(hits: DataFrame) -> DataFrame:
    """One row per path over several queries' hits (query, place, ...).

    Best score, longest excerpt (the earlier of equals), citations united; other columns of the first.
    """
    seen = F.struct("query", "place")
    earlier = F.struct(F.length("excerpt").alias("n"), (-F.col("query")).alias("q"), (-F.col("place")).alias("p"))
    merged = hits.groupBy("path").agg(
        F.min_by("title", seen).alias("title"),
        F.min_by("type", seen).alias("type"),
        F.max("score").alias("score"),
        F.max_by("excerpt", earlier).alias("excerpt"),
        F.sort_array(F.collect_list(F.struct("query", "place", "citations"))).alias("c"),
        F.min(seen).alias("first"),
    )
    cited = F.array_distinct(F.flatten(F.transform("c", lambda x: x["citations"])))
    return merged.withColumn("citations", cited).drop("c")


def default_queries(topic: str) -> list[str]:
    return [f"{topic} {what}" for what in ("核心概念", "最新实践", "争议 风险", "案例")]


def research(pages: DataFrame, topic: str, queries: list[str] | None = None) -> DataFrame:
    """Hits of up to eight queries, merged, strong, at most ``MERGED_CAP``."""
    asked = [q.strip() for q in (queries or []) if q.strip()][:8] or default_queries(topic)
    hits = many_hits(pages, asked)
    excerpt = F.lit("")
    for i, q in enumerate(asked):
        excerpt = F.when(F.col("query") == i, _needle(F.col("body"), q, search_tokens(q))).otherwise(excerpt)
    hits = hits.select("query", "place", "path", "title", "type", "score", excerpt.alias("excerpt"), F.array("path").alias("citations"))
    return strong(merge_research(hits)).orderBy(F.desc("score"), "first").limit(MERGED_CAP)


def readable_query(query: Column) -> Column:
    """A query that is unreadable retrieves nothing."""
    return ~is_unknown(query)


def index_search(index: DataFrame, query: str, limit: int = SEARCH_LIMIT, excerpt: int = 500) -> DataFrame:
    """C11: hits of a materialised index (path, kind, title, content, citations), titles weighing three to one.

    Scores count down from 100 by rank, 1 at least.
    """
    words = search_tokens(query) or [query.strip().lower()]
    low_title, low_text = F.lower("title"), F.lower("content")
    points = reduce(lambda a, b: a + b, [3 * occurrences(low_title, w) + occurrences(low_text, w) for w in words])
    best = index.withColumn("_p", points).filter("_p > 0").orderBy(F.desc("_p"), "path").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("_p"), "path"))  # at most ``limit`` rows
    return best.select("path", "title", F.col("kind").alias("type"), F.greatest(F.lit(1), 101 - place).cast("long").alias("score"), F.substring("content", 1, excerpt).alias("excerpt"), "citations")
