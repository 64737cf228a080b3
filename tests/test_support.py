import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from folioforge.config import Settings
from folioforge.functions import display, validate
from folioforge.operators import activity, search, tasks
from folioforge.sources import external


def test_settings(monkeypatch):
    monkeypatch.setenv("FOLIOFORGE_GRAPH_NODES", "1500")
    monkeypatch.setenv("FOLIOFORGE_LINT_PAGES", "x")
    got = Settings.from_environment()
    assert got.graph_nodes == 1500 and got.lint_pages == 2500 and Settings().override(weak_score=-1, nope=3).weak_score == 18


@pytest.mark.parametrize("limit,offset,ok", [(10, 0, True), ("10", "5", True), (0, 0, False), (10, -1, False), ("1e3", 0, False), (True, 0, False), (10**6, 0, False), (None, 0, False)])
def test_pages(limit, offset, ok):
    if ok:
        assert validate.page(limit, offset) == (int(limit), int(offset))
    else:
        with pytest.raises(validate.InvalidInput):
            validate.page(limit, offset)


@pytest.mark.parametrize("call", [lambda: validate.text(3, "t"), lambda: validate.text(" ", "t", True), lambda: validate.text("xx", "t", most=1), lambda: validate.text("\ud800", "t"), lambda: validate.items("x", "l", 3), lambda: validate.items([1] * 4, "l", 3), lambda: validate.identifier("../x", "i"), lambda: validate.flag("yes", "f")])
def test_refusals(call):
    with pytest.raises(validate.InvalidInput):
        call()


def test_display(spark, col):
    assert col(display.format_bytes, [5, 1536, 3 << 20, 5 << 30], "long") == ["5 B", "1.5 KB", "3.0 MB", "5.0 GB"]
    assert col(lambda c: display.needs_review(c, F.lit("ok"), F.lit(None)), ["fine", "??? x", "？？"]) == [False, True, False]
    assert col(lambda c: display.rewrite_media(c, F.lit("assets/a")), ["![i](media/x.png) [l](media/y)"]) == ["![i](assets/a/media/x.png) [l](media/y)"]
    hit = F.array(F.struct(F.lit("T").alias("title"), F.lit("p").alias("path"), F.lit("e").alias("excerpt")))
    text = spark.range(1).select(display.evidence_context(hit, F.filter(hit, lambda h: F.lit(False)))).first()[0]
    assert text.startswith("当前知识库：\n[1] T (p)\ne\n\n联网") and "没有获取到可用结果" in text
    two = F.concat(hit, hit)
    text = spark.range(1).select(display.evidence_context(two, two)).first()[0]
    assert text == "当前知识库：\n[1] T (p)\ne\n\n[2] T (p)\ne\n\n联网搜索结果：\n[3] T (p)\ne\n\n[4] T (p)\ne"
    shown = col(lambda c: display.raw_preview(c, F.lit("x\ufffd\ufffdy")), ["a.txt", "d/a.pdf"])
    notice = "# {}\n" + display.NOT_TEXT[0] + "{}" + display.NOT_TEXT[1] + "\n" + display.SEE_PAGES
    assert shown == ["x（字符无法识别）y", notice.format("a.pdf", "binary")]
    full = col(lambda c: display.raw_preview(F.lit("a.docx"), F.lit("x"), c, F.lit("docx"), c, F.lit("p.md")), ["n.docx", "", None, "\ufffd\ufffd\ufffd"])
    assert full[0] == notice.format("n.docx", "docx") + "\n- 已抽取全文：n.docx\n- 来源页：p.md" and full[1] == full[2] == notice.format("a.docx", "docx") + "\n- 来源页：p.md"
    assert full[3].startswith("# " + display.NO_NAME)


def test_what_a_prompt_says_by_the_evidence(spark):
    rows = spark.createDataFrame([(h, w, g, s) for h in (0, 1) for w in (0, 1) for g in (False, True) for s in (False, True)], "h int, w int, g boolean, s boolean")
    hits = lambda n: F.array_repeat(F.struct(F.lit("T").alias("title"), F.lit("p").alias("path"), F.lit("e").alias("excerpt")), F.col(n))
    case = display.evidence_case(hits("h"), hits("w"), F.col("g"), F.col("s"))
    named = {name: display.by_case(case, texts).alias(name) for name, texts in (("scope", display.SCOPES), ("mode", display.ANSWER_MODES), ("system", display.SYSTEM_MODES))}
    for r in rows.select("*", case.alias("c"), *named.values()).collect():
        want = {(1, 1): "both", (1, 0): "local", (0, 1): "web"}.get((r.h, r.w)) or ("given" if r.g else "searched" if r.s else "none")
        assert r.c == want and r.mode == display.ANSWER_MODES[want]
        assert r.scope == display.SCOPES.get(want, display.SCOPES["none"]) and r.system == display.SYSTEM_MODES.get(want, display.SYSTEM_MODES["none"])


def test_external_payloads(spark):
    rows = [
        ("q", "searxng", json.dumps({"results": [{"url": "https://a.b/1", "title": "<b>T</b> &amp; U", "content": "c"}, {"url": "https://a.b/2", "title": "V"}]})),
        ("q", "serpapi", json.dumps({"organic_results": [{"link": "https://a.b/1", "title": "T", "snippet": "s"}]})),
        ("q", "typesense", json.dumps({"hits": [{"document": {"url": "https://t.s/1", "title": "D", "content": "x"}}]})),
        ("q", "tavily", "not json"),
    ]
    got = external.results(spark.createDataFrame(rows, "query string, provider string, payload string"))
    assert sorted((r.url, r.title) for r in got.collect()) == [("https://a.b/1", "T"), ("https://a.b/1", "T & U"), ("https://a.b/2", "V"), ("https://t.s/1", "D")]
    assert search.external_hits(got).count() == 2  # three a query, two of them one url
    hits = search.external_hits(got, 5).collect()
    assert len(hits) == 3 and hits[0].score == 100 and {h.path for h in hits} == {"https://a.b/1", "https://a.b/2", "https://t.s/1"}
    assert external.pick_fields(["id", "body", "content"]) == ["content", "body", "id"]


def test_index_search(spark):
    rows = [("a", "wiki", "solar", "x", ["a"]), ("b", "wiki", "x", "solar solar", ["b"]), ("c", "raw", "x", "y", [])]
    got = search.index_search(spark.createDataFrame(rows, "path string, kind string, title string, content string, citations array<string>"), "solar").collect()
    assert [(r.path, r.score) for r in got] == [("a", 100), ("b", 99)]


def test_tasks(spark):
    t0 = dt.datetime(2024, 1, 1)
    schema = "id string, topic string, queries array<string>, modelId string, status string, createdAt timestamp"
    have = spark.createDataFrame([("1", "A", None, None, "running", t0), ("2", "B", None, None, "done", t0), ("3", "C", None, None, "queued", t0), ("4", "D", None, None, "queued", t0 + dt.timedelta(1))], schema)
    asked = spark.createDataFrame([("5", " a ", None, None, None, t0), ("6", "B", None, None, None, t0), ("7", "b", None, None, None, t0 + dt.timedelta(1))], schema)
    assert [r.id for r in tasks.submit(have, asked).collect()] == ["6"]
    assert sorted(r.id for r in tasks.admit(have).collect()) == ["1", "3"] and [r.id for r in tasks.deletable(have).collect()] == ["2"]


def test_activity_view(spark):
    t0 = dt.datetime(2024, 1, 1)
    queue = spark.createDataFrame([("a", "s", "raw/x.md", "queued", t0, t0, 0)], "id string, sourceId string, relativePath string, status string, createdAt timestamp, updatedAt timestamp, ord int")
    sources = spark.createDataFrame([("s", "x.md", None, "markdown", 7, "ready", "sum", "e" * 600, 0)], "id string, fileName string, title string, kind string, size long, status string, summary string, error string, ord int")
    v = activity.view(queue, sources)
    assert v["queue"].first().fileName == "x.md" and len(v["sources"].first().error) == 500 and "summary" not in v["sources"].columns
    assert v["bytes"].first().bytes == 7 and v["progress"].first().next == "a" and v["source_stats"].first().ready == 1


def test_usable_profiles():
    from folioforge.functions.validate import usable_profile

    full = {"enabled": True, "provider": "openai", "baseUrl": "u", "model": "m", "apiKey": "k"}
    assert usable_profile(full) and not usable_profile(full | {"enabled": False}) and not usable_profile(full | {"provider": "offline"})
    assert not usable_profile(full | {"apiKey": ""}) and usable_profile(full | {"apiKey": "", "provider": "ollama"}) and not usable_profile({})
