"""Topic ledger and tools as table functions."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import tools
from folioforge.operators import ledger, topics

NOTE = "kind string, key string, path string, topic string, title string, ord long, evidence array<string>"


def notes(spark, rows):
    return spark.createDataFrame([("concept", k.lower(), p, k, f"t{p}", o, [e] if e else []) for k, p, o, e in rows], NOTE)


def listed(spark, root):
    return {r.key: (r.topic, list(zip(r.sources, [x.evidence for x in r.notes], strict=True))) for r in ledger.pages(spark, root).collect()}


def test_pages_follow_added_changed_and_removed_sources(spark, tmp_path):
    root = str(tmp_path / "topics")
    assert ledger.change(root, notes(spark, [("Alpha", "a", 1, "one"), ("Alpha", "b", 2, "two"), ("Beta", "b", 2, "two"), ("Gamma", "c", 0, "")])) == {"added": 4, "taken": 0, "topics": 3}
    gone = spark.createDataFrame([("c",), ("nobody",)], "path string")
    more = notes(spark, [("Alpha", "b", 2, "new"), ("Alpha", "z", 0, "late"), ("Beta", "b", 2, "two")])
    assert ledger.change(root, more, gone) == {"added": 2, "taken": 2, "topics": 2}  # Beta said the same again: no change
    got = listed(spark, root)
    assert got == {"alpha": ("Alpha", [("a", ["one"]), ("b", ["new"]), ("z", ["late"])]), "beta": ("Beta", [("b", ["two"])])}
    full = topics.merge(spark.read.parquet(f"{root}/notes/{ledger_version(spark, root)}"))
    assert {(r.key, tuple(r.sources)) for r in full.collect()} == {(k, tuple(p for p, _ in v[1])) for k, v in got.items()}
    assert ledger.change(root, notes(spark, []), spark.createDataFrame([("a",), ("b",), ("z",)], "path string"))["topics"] == 2
    assert listed(spark, root) == {}


def ledger_version(spark, root):
    from folioforge.sources.sinks import current_version

    return current_version(spark, f"{root}/notes")


def test_pages_that_are_behind_are_repaired(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "topics")
    ledger.change(root, notes(spark, [("Alpha", "a", 1, "one"), ("Beta", "a", 1, "one")]))
    true = ledger.replace_table

    def fails(df, path, *more):
        if path.endswith("pages"):
            raise RuntimeError("lost")
        true(df, path, *more)

    monkeypatch.setattr(ledger, "replace_table", fails)
    with pytest.raises(RuntimeError, match="lost"):
        ledger.change(root, notes(spark, [("Alpha", "b", 2, "two")]))
    monkeypatch.setattr(ledger, "replace_table", true)
    assert [p for p, _ in listed(spark, root)["alpha"][1]] == ["a"]
    assert ledger.repair(spark, root) == 1 and ledger.repair(spark, root) == 0
    assert [p for p, _ in listed(spark, root)["alpha"][1]] == ["a", "b"]


def test_tools_are_table_functions(spark):
    calls = {"say": lambda q: f"<{q}>", "wide": lambda q: "é" * 5000, "none": lambda q: ""}
    tools.register(spark, "ask_test", calls)
    spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id int, q string").createOrReplaceTempView("asked_test")
    got = spark.sql("SELECT * FROM ask_test(TABLE(SELECT * FROM asked_test), 'q', 3)")
    assert got.columns == ["id", "q", "tool", "ok", "answer"]
    rows = {(r.id, r.tool): (r.ok, r.answer) for r in got.collect()}
    assert rows[1, "say"] == rows[2, "say"] == (True, "<x>") and rows[1, "none"] == (False, "") and len(rows) == 6
    assert len(rows[1, "wide"][1].encode()) == 5000 and len(tools.cut_utf8("a" + "é" * 5000).encode()) == 4999
    assert spark.sql("SELECT * FROM ask_test(TABLE(SELECT * FROM asked_test), 'q', 1)").count() == 2
    with pytest.raises(Exception, match="names a column"):
        spark.sql("SELECT * FROM ask_test(TABLE(SELECT * FROM asked_test), 'nope', 1)").collect()


def test_touched_topics_only_are_made_again(spark, tmp_path):
    left = notes(spark, [("Alpha", "a", 1, "one"), ("Beta", "b", 1, "x")]).withColumn("run", F.lit(1).cast("long"))
    same = notes(spark, [("Alpha", "a", 1, "one")])
    assert ledger.differences(left, same.select("path").limit(0), same).count() == 0
    assert ledger.differences(left, left.select("path").filter("path = 'b'"), same).select("key", "sign").collect() == [("beta", -1)]
