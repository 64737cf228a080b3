"""Queries over what is kept between runs - search index, topic ledger - and over tools as table functions, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text, tools
from folioforge.operators import fulltext, ledger, topics
from folioforge.operators.tables import materialise
from folioforge.plans import shapes
from folioforge.plans.catalogue import PG, QUERY, _quote, query, sql_hits
from folioforge.plans.inline import _folder
from folioforge.plans.shapes import table
from folioforge.sources import zipped


def _one(spark: SparkSession, q: str) -> DataFrame:
    return spark.sql("SELECT 0L AS query, :q AS text", {"q": q})


@query(f"WITH {PG}, {sql_hits(QUERY, 'h', 12)} SELECT path, title, score FROM h")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_topk`` answered from the index."""
    root = _folder(spark, "index")
    fulltext.refresh(shapes.doc_pages(spark, sf_dir), root)
    return fulltext.search_all(root, _one(spark, QUERY)).select("path", "title", "score")


@query(f"WITH {PG}, {sql_hits(QUERY, 'h', 12)} SELECT path, title, score, (SELECT count(*) FROM pg) AS n_live FROM h")
def indexed_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of former versions - every other word's case and all bodies doubled - brought up to date, then searched."""
    root, pages = _folder(spark, "index"), shapes.doc_pages(spark, sf_dir)
    fulltext.refresh(pages.withColumn("body", F.concat("body", F.lit("\n"), F.upper("body"))), root)
    counts = fulltext.refresh(pages, root)
    again = fulltext.refresh(pages, root)
    live = F.lit(counts["changed"] + counts["kept"] + again["added"] + again["changed"]).cast("long")
    return fulltext.search_all(root, _one(spark, QUERY)).select("path", "title", "score", live.alias("n_live"))


_NOT = "(" + ", ".join(_quote(w) for w in dict.fromkeys([*text.STOP_WORDS, *text.QUERY_STOP_WORDS])) + ")"
QUESTIONS = f"""{PG},
tk AS (SELECT item_id, lower(trim(text)) AS whole, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]{{2,}}') AS ts FROM benchmark),
t1 AS (SELECT item_id, t, min(i) AS i FROM (SELECT item_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM tk) WHERE t NOT IN {_NOT} GROUP BY ALL),
t2 AS (SELECT item_id, t FROM t1 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i) <= 40),
low AS (SELECT path, lower(title) AS lt, lower(title || ' ' || body) AS low FROM pg),
occ AS (SELECT t, path, (length(low) - length(replace(low, t, ''))) // length(t) * least(6, greatest(2, length(t))) * CASE WHEN contains(lt, t) THEN 4 ELSE 1 END AS s
        FROM (SELECT DISTINCT t FROM t2), low WHERE contains(low, t)),
pt AS (SELECT item_id, path, s FROM t2 JOIN occ USING (t)
       UNION ALL SELECT item_id, path, greatest(12, 2 * length(whole)) FROM tk JOIN low ON contains(low, whole)),
sc AS (SELECT item_id AS query, path, sum(s)::BIGINT AS score FROM pt GROUP BY ALL)
SELECT query, place, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS place FROM sc) WHERE place <= 12"""


@query(f"WITH {QUESTIONS}")
def indexed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, C3, F20-F22 for a table of queries: every benchmark item's best pages, all from the index at once."""
    root = _folder(spark, "index")
    fulltext.refresh(shapes.doc_pages(spark, sf_dir), root)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return materialise(fulltext.search_all(root, asked).select("query", "place", "path", "score"), "answers")


# ---------------------------------------------------------------- topic pages that follow their sources
@query(
    f"""WITH d AS (SELECT d.doc_id, lang, source, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT doc_id, 'lang ' || lang AS key FROM d WHERE quality IS DISTINCT FROM 0
      UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN 'chosen ' ELSE 'origin ' END || source FROM d WHERE quality IS DISTINCT FROM 0),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS place FROM t)
SELECT 'concept' AS kind, key, count(*)::BIGINT AS n_sources, string_agg(doc_id::VARCHAR, ',' ORDER BY place) AS sources FROM r WHERE place <= {topics.MAX_NOTES} GROUP BY key"""
)
def topic_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of all documents; then bad ones are removed and good ones noted again under another topic."""
    root = _folder(spark, "topics")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")

    def noted(rows: DataFrame, origin: str) -> DataFrame:
        named = F.array(F.concat(F.lit("Lang "), "lang"), F.concat(F.lit(f"{origin} "), "source"))
        return topics.notes(rows.select(F.col("doc_id").cast("string").alias("path"), F.lit("t").alias("title"), F.col("doc_id").alias("ord"), "text", named.alias("topics")), "topics", "concept")

    ledger.change(root, noted(docs, "Origin"))
    bad = docs.filter("quality = 0").select(F.col("doc_id").cast("string").alias("path"))
    ledger.change(root, noted(docs.filter("quality = 1"), "Chosen"), bad)
    return ledger.pages(spark, root).select("kind", "key", F.size("sources").cast("long").alias("n_sources"), F.array_join("sources", ",").alias("sources"))


# ---------------------------------------------------------------- tools as table functions
def _refuse(_: str) -> str:
    raise RuntimeError("refused")


@query(
    f"""SELECT item_id, tool, tool IN ('words', 'long') AS ok,
CASE tool WHEN 'words' THEN len(regexp_extract_all(text, '[a-z]+'))::VARCHAR WHEN 'long' THEN repeat('ab', {tools.MAX_BYTES // 2}) WHEN 'silent' THEN '' ELSE '{tools.FAILED}refused' END AS answer
FROM benchmark, (SELECT unnest(['words', 'long', 'silent', 'gone']) AS tool)"""
)
def tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.13: tools asked about every benchmark item, as a table function in SQL; of five the first four."""
    import re

    table(spark, sf_dir, "benchmark").createOrReplaceTempView("asked_items")
    asked = {
        "words": lambda q: str(len(re.findall("[a-z]+", q))),
        "long": lambda q: "ab" * 10_000,
        "silent": lambda q: None,
        "gone": _refuse,
        "fifth": lambda q: "not asked",
    }
    tools.register(spark, "ask_tools", asked)
    return spark.sql("SELECT item_id, tool, ok, answer FROM ask_tools(TABLE(SELECT item_id, text FROM asked_items), 'text', 9)")


# ---------------------------------------------------------------- archives by range
@query(
    """SELECT source || '-' || (doc_id // 500) || '.zip' AS archive, 'docs/' || doc_id || '.md' AS entry, octet_length(encode(text))::BIGINT AS size,
sha256(text) AS sha, sha256(encode(text)[:32]) AS head, NULL::VARCHAR AS skipped FROM documents"""
)
def archives_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into archives, which are read by runs of entries: whole, and their first 32 bytes."""
    root = _folder(spark, "archives")
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 500).cast("string")).alias("key"), "doc_id", "text")

    def pack(pdf):
        import io
        import zipfile

        import pandas as pd

        from folioforge.sources.zipped import _opened

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for key, text_ in sorted(zip(pdf["doc_id"], pdf["text"], strict=True)):
                z.writestr(f"docs/{key}.md", text_)
        fs, folder = _opened(root)
        fs.create_dir(folder, recursive=True)
        name = pdf["key"].iloc[0]
        with fs.open_output_stream(f"{folder}/{name}.zip") as f:
            f.write(out.getvalue())
        return pd.DataFrame({"key": [name]})

    materialise(docs.groupBy("key").applyInPandas(pack, "key string"), "packed")  # at most 500 documents an archive
    spark.dataSource.register(zipped.ZippedSource)
    read = spark.read.format("zipped").option("bytesPerPartition", 16 << 10)
    whole = read.load(root).select("archive", "entry", "size", F.sha2("content", 256).alias("sha"), "skipped")
    heads = read.option("head", 32).load(root).select("archive", "entry", F.sha2("content", 256).alias("head"))
    return whole.join(heads, ["archive", "entry"])
