"""Queries over what is served to people and models: prompts, previews, index hits, fallbacks - with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import display, paths, text
from folioforge.functions.query import search_tokens
from folioforge.operators import search
from folioforge.plans.catalogue import QUERY, _quote, query
from folioforge.plans.shapes import table
from folioforge.streaming import ingest

EXCERPT = 200


def _sql_case(case: str, texts: dict[str, str]) -> str:
    return f"CASE {case} " + " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in texts.items()) + f" ELSE {_quote(texts['none'])} END"


@query(
    f"""WITH e AS (SELECT u.conv_id, u.turn, p.text AS said, p.turn AS before, g.url, g.page_id, substr(p.text, 1, {EXCERPT}) AS x
    FROM conversations u LEFT JOIN conversations p ON p.conv_id = u.conv_id AND p.turn = u.turn - 1 AND p.role = 'assistant' AND p.text IS NOT NULL
    LEFT JOIN pages g ON g.page_id = u.conv_id AND g.url IS NOT NULL WHERE u.role = 'user'),
c AS (SELECT *, CASE WHEN said IS NOT NULL AND url IS NOT NULL THEN 'both' WHEN said IS NOT NULL THEN 'local' WHEN url IS NOT NULL THEN 'web' WHEN turn > 0 THEN 'searched' ELSE 'none' END AS c FROM e)
SELECT conv_id, turn, {_sql_case('c', display.SCOPES)} AS scope, {_sql_case('c', display.ANSWER_MODES)} AS mode, {_sql_case('c', display.SYSTEM_MODES)} AS system_mode,
    CASE WHEN said IS NOT NULL THEN '当前知识库：' || chr(10) || '[1] turn ' || before || ' (conversations/' || conv_id || ')' || chr(10) || x ELSE '当前知识库：没有检索到相关内容。' END || chr(10) || chr(10)
    || CASE WHEN url IS NOT NULL THEN '联网搜索结果：' || chr(10) || '[' || CASE WHEN said IS NOT NULL THEN 2 ELSE 1 END || '] page ' || page_id || ' (' || url || ')' || chr(10) || url
       ELSE '联网搜索结果：没有获取到可用结果，可能未联网或未配置外部搜索服务。' END AS context FROM c"""
)
def evidence_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the answer before it as local evidence, and the page of its conversation's number as the web's."""
    turns, pages = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "pages")
    hit = lambda title, path, excerpt: F.struct(title.alias("title"), path.alias("path"), excerpt.alias("excerpt"))
    said = turns.filter("role = 'assistant' AND text IS NOT NULL").select("conv_id", (F.col("turn") + 1).alias("turn"), F.substring("text", 1, EXCERPT).alias("x"))
    found = pages.filter("url IS NOT NULL").select(F.col("page_id").alias("conv_id"), "url")
    rows = turns.filter("role = 'user'").select("conv_id", "turn").join(said, ["conv_id", "turn"], "left").join(found, "conv_id", "left")
    none = F.array().cast("array<struct<title:string,path:string,excerpt:string>>")
    where = F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"))
    local = F.when(F.col("x").isNotNull(), F.array(hit(F.concat(F.lit("turn "), (F.col("turn") - 1).cast("string")), where, F.col("x")))).otherwise(none)
    web = F.when(F.col("url").isNotNull(), F.array(hit(F.concat(F.lit("page "), F.col("conv_id").cast("string")), F.col("url"), F.col("url")))).otherwise(none)
    rows = rows.select("conv_id", "turn", local.alias("local"), web.alias("web"))
    rows = rows.withColumn("c", display.evidence_case(F.col("local"), F.col("web"), searched=F.col("turn") > 0))
    texts = {"scope": display.SCOPES, "mode": display.ANSWER_MODES, "system_mode": display.SYSTEM_MODES}
    said_by = [display.by_case(F.col("c"), t).alias(name) for name, t in texts.items()]
    return rows.select("conv_id", "turn", *said_by, display.evidence_context(F.col("local"), F.col("web")).alias("context"))


#: As ``clean_unknown``: runs of signs that stand for what could not be decoded.
SQL_CLEAN = "text"
for _run in (text.QUESTION_RUN, text.REPLACEMENT_RUN, text.PLACEHOLDER_RUN):
    SQL_CLEAN = f"regexp_replace({SQL_CLEAN}, {_quote(_run.replace('\\ufffd', '\ufffd').replace('\\u00a0', '\u00a0'))}, {_quote(text.PLACEHOLDER)}, 'g')"
_ENDINGS = {"en": ".md", "de": ".TXT", "fr": ".html"}


@query(
    f"""SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'fr') THEN {SQL_CLEAN}
    ELSE '# ' || doc_id || '.pdf' || chr(10) || '{display.NOT_TEXT[0]}' || coalesce(lang, 'binary') || '{display.NOT_TEXT[1]}' || chr(10) || '{display.SEE_PAGES}'
         || CASE WHEN n_chars > 1000 THEN chr(10) || '{display.CONVERTED}wiki/' || doc_id || '.md' ELSE '' END || coalesce(chr(10) || '{display.PAGE}' || source, '') END AS preview,
    octet_length(encode(coalesce(text, ''))) <= {paths.MAX_RAW_BYTES} AS small FROM documents"""
)
def raw_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each raw source - its text, or a notice for a type that is no text - and whether it is small enough to search.

    Languages stand for types, sources for pages; long documents have an extract.
    """
    ending = F.lit(".pdf")
    for lang, end in _ENDINGS.items():
        ending = F.when(F.col("lang") == lang, end).otherwise(ending)
    number = F.col("doc_id").cast("string")
    extract = F.when(F.col("n_chars") > 1000, F.concat(F.lit("wiki/"), number, F.lit(".md")))
    preview = display.raw_preview(F.concat(F.lit("raw/"), number, ending), F.col("text"), kind=F.col("lang"), converted=extract, page=F.col("source"))
    small = paths.is_small(F.octet_length(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", preview.alias("preview"), small.alias("small"))


def _points(column: str) -> str:
    return " + ".join(f"(length({column}) - length(replace({column}, {_quote(t)}, ''))) // {len(t)}" for t in search_tokens(QUERY))


@query(
    f"""WITH i AS (SELECT 'wiki/' || doc_id || '.md' AS path, coalesce(source, '') AS title, lang AS kind, coalesce(text, '') AS content FROM documents),
p AS (SELECT *, 3 * ({_points('lower(title)')}) + {_points('lower(content)')} AS p FROM i),
r AS (SELECT *, row_number() OVER (ORDER BY p DESC, path) AS place FROM p WHERE p > 0)
SELECT path, title, kind AS type, greatest(1, 101 - place)::BIGINT AS score, substr(content, 1, 500) AS excerpt FROM r WHERE place <= {search.SEARCH_LIMIT}"""
)
def index_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: the best hits (a top-k report) of a materialised index of all documents, titles weighing three to one."""
    path = F.concat(F.lit("wiki/"), F.col("doc_id").cast("string"), F.lit(".md"))
    title, content = F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))
    index = table(spark, sf_dir, "documents").select(path.alias("path"), F.col("lang").alias("kind"), title.alias("title"), content.alias("content"), F.array(path).alias("citations"))
    return search.index_search(index, QUERY).drop("citations")


def _no_model(title: str, text: str) -> dict:
    raise ConnectionError("no model answers")


def _by_size(title: str, text: str) -> dict:
    return {"title": title, "n_chars": len(text)}


@query("SELECT doc_id::VARCHAR AS title, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents")
def model_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose model does not answer goes on with the offline analyser, for every document."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return ingest.circuit_broken(_no_model, _by_size, "title string, n_chars long")(rows)
