"""The persistent index against the search that reads every page."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import fulltext, search
from folioforge.operators.tables import modest_batches
from folioforge.plans import indexed
from folioforge.plans.catalogue import QUERY
from folioforge.plans.shapes import doc_pages
from tests.oracle import SF

QUESTIONS = [
    "alpha gamma", "知识图谱 怎么构建", "图谱", "ab", "x", "The ALPHA", "aaaa", "no-such-word", "beta-12 gamma", "   ", "知识", "naïve café", "?",
]


def made_pages(spark, n=120):
    rnd = random.Random(11)
    words = "alpha beta gamma beta-12 知识图谱 知识 图谱构建 naïve café aaaa aaa ab x 😀 The end.".split()
    rows = [(f"wiki/notes/{i:04}.md", " ".join(rnd.choices(words, k=2)), "note", " ".join(rnd.choices(words, k=rnd.randrange(1, 40)))) for i in range(n)]
    rows += [("wiki/notes/9999.md", "alpha", "note", "gamma " * 500), ("wiki/index.md", "alpha", "index", "alpha gamma"), ("wiki/notes/bad.md", "alpha", "note", "??? alpha ????")]
    return spark.createDataFrame(rows, "path string, title string, type string, body string")


def answers(root, spark, questions, limit):
    asked = spark.createDataFrame(list(enumerate(questions)), "query long, text string")
    out = {}
    for r in fulltext.search_all(root, asked, limit).orderBy("query", "place").collect():
        out.setdefault(r.query, []).append((r.path, r.score))
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(fulltext, "CHUNK", 8)


def test_index_answers_what_a_scan_answers(spark, tmp_path, small):
    pages, root = made_pages(spark), str(tmp_path / "index")
    fulltext.refresh(pages, root)
    got = answers(root, spark, QUESTIONS, 5)
    for i, q in enumerate(QUESTIONS):
        want = [(r.path, r.score) for r in search.page_hits(pages, q, 5).select("path", "score").collect()] if q.strip() else []
        assert got.get(i, []) == want, q
    assert got[0][0][0] == "wiki/notes/9999.md"  # the best page is the last one


def test_index_follows_its_pages(spark, tmp_path, small):
    pages, root = made_pages(spark), str(tmp_path / "index")
    assert fulltext.refresh(pages, root)["added"] == 121
    new = pages.filter("path <> 'wiki/notes/9999.md'").withColumn("body", F.when(F.col("path") == "wiki/notes/0007.md", F.lit("alpha gamma " * 900)).otherwise(F.col("body")))
    new = new.unionByName(spark.createDataFrame([("wiki/notes/new.md", "beta", "note", "alpha")], pages.schema))
    assert fulltext.refresh(new, root) == {"added": 1, "changed": 1, "removed": 1, "kept": 119}
    assert fulltext.refresh(new, root) == {"added": 0, "changed": 0, "removed": 0, "kept": 121}
    got = answers(root, spark, ["alpha gamma"], 7)[0]
    assert got == [(r.path, r.score) for r in search.page_hits(new, "alpha gamma", 7).select("path", "score").collect()]
    assert got[0][0] == "wiki/notes/0007.md" and "wiki/notes/9999.md" not in dict(got)


def test_failed_refresh_keeps_the_index(spark, tmp_path, small, monkeypatch):
    pages, root = made_pages(spark, 30), str(tmp_path / "index")
    fulltext.refresh(pages, root)
    before = answers(root, spark, ["alpha gamma"], 5)
    monkeypatch.setattr(fulltext, "_posted", lambda store: store.select(F.raise_error(F.lit("lost")).cast("long").alias("gram")))
    with pytest.raises(Exception, match="lost"):
        fulltext.refresh(pages.withColumn("body", F.lit("alpha")), root)
    assert answers(root, spark, ["alpha gamma"], 5) == before


def test_searching_reads_the_index_only(spark, tmp_path):
    root = str(tmp_path / "index")
    fulltext.refresh(doc_pages(spark, SF), root)
    asked = spark.createDataFrame([(0, "the thin tion reed")], "query long, text string")
    plan = fulltext.search_all(root, asked)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    grams = fulltext.needle_grams("thin")
    assert len(grams) == 2 and fulltext.needle_grams("ab") is None and len(fulltext.needle_grams("知识")) == 1


def test_empty_index_and_empty_table(spark, tmp_path):
    root = str(tmp_path / "index")
    fulltext.refresh(made_pages(spark).limit(0), root)
    assert answers(root, spark, ["alpha"], 3) == {}


def test_scratch_tables_hold_neither_texts_nor_lists_of_needles(spark, tmp_path, small, monkeypatch):
    root, kept, true = str(tmp_path / "index"), {}, fulltext.materialise
    fulltext.refresh(made_pages(spark), root)

    def seen(df, name):
        kept[name] = set(df.columns)
        return true(df, name)

    monkeypatch.setattr(fulltext, "materialise", seen)
    answers(root, spark, QUESTIONS, 5)
    assert "rest" in kept and not [n for n, c in kept.items() if c & {"body", "pages"}]


def test_lists_in_parts_and_blocks_of_queries_change_no_answer(spark, tmp_path, small, monkeypatch):
    monkeypatch.setattr(fulltext, "HELD", 50)
    monkeypatch.setattr(fulltext, "BLOCK", 3)
    pages, root = made_pages(spark), str(tmp_path / "index")
    fulltext.refresh(pages, root)
    parts = fulltext._parts(spark, root, "postings", fulltext._POSTED)
    assert parts.groupBy("gram", "chunk").count().filter("count > 1").count() > 0
    got = answers(root, spark, QUESTIONS[:7], 5)
    for i, q in enumerate(QUESTIONS[:7]):
        assert got.get(i, []) == [(r.path, r.score) for r in search.page_hits(pages, q, 5).select("path", "score").collect()], q


def test_refresh_copies_no_texts_to_compare_them(spark, tmp_path, small, monkeypatch):
    kept, true = {}, fulltext.materialise
    monkeypatch.setattr(fulltext, "materialise", lambda df, name: kept.update({name: set(df.columns)}) or true(df, name))
    pages, root = made_pages(spark, 30), str(tmp_path / "index")
    fulltext.refresh(pages, root)
    assert fulltext.refresh(pages, root) == {"added": 0, "changed": 0, "removed": 0, "kept": 31}
    assert kept and not [n for n, c in kept.items() if "body" in c]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_only_one_kind_of_python_worker_serves_the_index(spark, monkeypatch):
    want = {(r.path, r.score) for r in search.page_hits(doc_pages(spark, SF), QUERY, 12).select("path", "score").collect()}

    def refused(*_, **__):
        raise AssertionError("rows of the driver's Python start workers that stay")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert {(r.path, r.score) for r in indexed.indexed_search(spark, SF).collect()} == want


def test_a_session_without_a_limit_of_rows_gets_one(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("0", "1000"), ("-1", "1000"), ("20000", "1000"), ("300", "300")):
            spark.conf.set(key, given)
            modest_batches(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
