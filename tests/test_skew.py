"""Hot keys: hubs and giant components, names that most rows have, rows that share a key."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioforge.functions import query
from folioforge.functions import text as t
from folioforge.operators import analyze, graph, registry, tables


def test_star_of_a_million_leaves(spark):
    n = 1_000_000
    nodes = spark.range(n + 10).select(F.col("id").alias("path"), F.col("id").alias("ord"))
    star = spark.range(1, n).select(F.col("id").alias("source"), F.lit(0).cast("long").alias("target"))
    edges = star.unionByName(spark.range(n, n + 4).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")))
    got = {r.community: (r.n, r.a) for r in graph.components(nodes, edges).groupBy("community").agg(F.count("*").alias("n"), F.min("path").alias("a")).collect()}
    assert got == {0: (n, 0), 1: (5, n), **{i: (1, n + 3 + i) for i in range(2, 7)}}


@pytest.mark.parametrize("least", [0, 10**9])
def test_look_up_is_a_left_join(spark, monkeypatch, least):
    monkeypatch.setattr(tables, "HOT_LEAST", least)
    monkeypatch.setattr(tables, "HOT_SHARE", 0.2)
    keys = [1] * 40 + [2] * 40 + [None] * 40 + [3, 4, 5] * 2
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k int")
    values = spark.createDataFrame([(1, "a"), (3, "c"), (5, None), (9, "z")], "k int, v string")
    want = {1: "a", 3: "c"}
    got = tables.look_up(rows, "k", values, "v")
    assert got.columns == ["k", "i", "v"] and sorted((r.i, r.k or 0, r.v) for r in got.collect()) == sorted((i, k or 0, want.get(k)) for i, k in enumerate(keys))
    assert tables.look_up(rows.filter("false"), "k", values, "v").count() == 0


def test_one_name_is_numbered_in_several_tasks(spark):
    n = 30_000
    rows = spark.range(n).select(F.col("id"), F.when(F.col("id") % 10 == 3, F.concat(F.lit("other"), F.col("id"), F.lit(".md"))).when(F.col("id") % 2 == 0, "README.md").otherwise("readme.md").alias("name"))
    got = registry.unique_names(rows, "name", "id")
    assert got.columns == ["id", "name"]
    found = [(r.id, r.name) for r in got.orderBy("id").collect()]
    assert len({name.lower() for _, name in found}) == n
    nth, want = 0, []
    for i in range(n):
        if i % 10 == 3:
            want.append((i, f"other{i}.md"))
        else:
            nth += 1
            stem = "README" if i % 2 == 0 else "readme"
            want.append((i, f"{stem}.md" if nth == 1 else f"{stem}-{nth}.md"))
    assert found == want
    empty = registry.unique_names(rows.filter("false"), "name", "id")
    assert empty.count() == 0


def test_keywords_of_rows_that_share_a_key(spark):
    texts = [(1, "solar wind solar"), (2, "river bank"), (1, "wind turbine wind"), (None, "first null"), (None, "second null"), (3, None), (4, ""), (5, "zeta alpha zeta alpha beta")]
    docs = spark.createDataFrame(texts, "k int, t string")
    split = {r.t: r.w for r in docs.select("t", t.tokens(F.coalesce("t", F.lit(""))).alias("w")).collect()}
    counts = {}
    for k, text in texts:
        counts.setdefault(k, Counter()).update(split[text])
    want = {(k, w, n, place) for k, c in counts.items() for place, (w, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:2], 1)}
    got = analyze.keyword_counts(docs, "k", "t", 2)
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["k", "word", "n", "place"]
    single = analyze.keyword_counts(docs.filter("k > 1"), "k", "t", 2)
    assert {tuple(r) for r in single.collect()} == {x for x in want if (x[0] or 0) > 1}
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    assert analyze.keyword_counts(docs.filter("false"), "k", "t", 2).count() == 0


@pytest.mark.parametrize(
    "asked, want",
    [
        ("", []),
        ("The quick brown fox", ["quick", "brown", "fox"]),
        ("API-first DESIGN api-first", ["api-first", "design"]),
        ("合同", ["合同"]),
        ("合同法律", ["合同法律", "合同法", "同法律", "合同", "同法", "法律"]),
    ],
)
def test_search_tokens_by_table(asked, want):
    assert query.search_tokens(asked) == want


def test_search_tokens_are_cut():
    got = query.search_tokens("".join(chr(0x4E00 + 37 * i) for i in range(90)))
    assert len(got) == len(set(got)) == query.MAX_TOKENS
