import datetime as dt

from pyspark.sql import functions as F

from folioforge.operators import activity, analyze, graph, lint, listing, projects, registry, search, topics

T0 = dt.datetime(2024, 1, 1)
PAGE = "path string, title string, type string, body string"
HIT = "path string, title string, type string, score long, excerpt string, citations array<string>"


def test_search_scores_title_fourfold_and_breaks_ties_by_path(spark):
    pages = spark.createDataFrame(
        [("wiki/b.md", "x", "note", "solar panel"), ("wiki/a.md", "x", "note", "solar panel"), ("wiki/c.md", "solar", "note", "panel"), ("wiki/index.md", "solar panel", "index", "solar panel"), ("wiki/d.md", "x", "note", "solar panel ???")], PAGE
    )
    got = [(r.path, r.score) for r in search.page_hits(pages, "solar panel").collect()]
    # whole query 22 + 5 + 5; "solar" in the title: 22 for the query in "solar panel", 4 x 5 + 5
    assert got == [("wiki/c.md", 47), ("wiki/a.md", 32), ("wiki/b.md", 32)]


def test_late_page_is_found_among_thousands(spark):
    pages = spark.range(4101).select(F.concat(F.lit("wiki/p"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit("t").alias("title"), F.lit("note").alias("type"), F.when(F.col("id") == 4100, "needle needle needle").otherwise("needle").alias("body"))
    assert search.search(pages, "needle").first().path == "wiki/p4100.md"


def test_dedupe_keeps_the_best_and_unites_citations(spark):
    a = spark.createDataFrame([("p", "A", "n", 5, "e", ["x"]), ("q", "Q", "n", 9, "e", [])], HIT)
    b = spark.createDataFrame([("p", "B", "n", 7, "f", ["y", "x"])], HIT)
    got = {r.path: r for r in search.dedupe_hits(search.union_hits(a, b)).collect()}
    assert got["p"].title == "B" and got["p"].score == 7 and got["p"].citations == ["x", "y"] and got["q"].citations == ["q"]


def test_strong_needs_anchor_and_share(spark):
    hits = spark.createDataFrame([("a", "solar", "n", 100, "", []), ("b", "solar", "n", 29, "", []), ("c", "solar", "n", 30, "", []), ("d", "wind", "n", 90, "", [])], HIT)
    assert sorted(r.path for r in search.strong(hits, "solar").collect()) == ["a", "c"]
    weak = spark.createDataFrame([("a", "solar", "n", 17, "", [])], HIT)
    assert search.strong(weak, "solar").count() == 0


def test_research_merge_prefers_longer_then_earlier_excerpts(spark):
    rows = [(0, 1, "p", "A", "n", 5, "long one", ["p"]), (1, 1, "p", "B", "n", 9, "long two", ["q"]), (1, 2, "r", "R", "n", 3, "", ["r"])]
    hits = spark.createDataFrame(rows, "query int, place int, " + HIT)
    got = {r.path: r for r in search.merge_research(hits).collect()}
    assert (got["p"].title, got["p"].score, got["p"].excerpt, got["p"].citations) == ("A", 9, "long one", ["p", "q"])


def test_answer_and_external(spark):
    pages = spark.createDataFrame([("wiki/a.md", "solar panel guide", "note", "solar panel guide text")], PAGE)
    web = spark.createDataFrame([("q", 1, "https://x.y/a", "T", "s"), ("q", 2, "https://x.y/a", "T", ""), ("q", 3, "bad", "T", "s"), ("q", 4, "https://x.y/b", "", "s")], "query string, rank int, url string, title string, snippet string")
    ev = search.answer(pages, "solar panel", web=web)
    assert [r.path for r in ev.orderBy("origin", "ord").collect()] == ["wiki/a.md", "https://x.y/a"]
    text = search.answer_text(ev).first()
    assert text.scope == "当前知识库和联网搜索结果" and text.citations == ["wiki/a.md", "https://x.y/a"]
    assert search.answer(pages, "继续", previous="solar panel").count() == 1


def test_analysis(spark):
    body = "# Solar Power\n\nSolar Power is described in this long sentence here. Acme Corp builds panels and panels and panels."
    row = spark.createDataFrame([("untitled", body), ("Good Name", ""), ("x", "????")], "t string, b string")
    got = [r.analysis for r in analyze.analyze(row, "t", "b").collect()]
    assert got[0].title == "Solar Power" and "panels" in got[0].concepts and got[0].key_points[0] == "Solar Power" and got[0].confidence == 0.62
    assert got[1].title == "Good Name" and got[1].summary == "来源 Good Name 已加入知识库。" and len(got[0].questions) >= 1
    assert got[2].summary.startswith("原文包含无法识别字符")


def _pages(spark, rows):
    return spark.createDataFrame(rows, "path string, title string, type string, sources array<string>, links array<string>, mtime timestamp, ord int")


def test_links_last_writer_wins_and_self_links_drop(spark):
    pages = _pages(spark, [("wiki/a.md", "Same", "note", [], ["same", "A", "b", "gone"], T0, 0), ("wiki/b.md", "Same", "note", [], [], T0, 1)])
    got = {r.link: r.target for r in graph.resolve_links(pages).collect()}
    assert got == {"same": "wiki/b.md", "A": "wiki/a.md", "b": "wiki/b.md", "gone": None}
    assert [(r.source, r.target) for r in graph.link_edges(pages).select("source", "target").distinct().collect()] == [("wiki/a.md", "wiki/b.md")]
    assert {r.path: r.incoming for r in lint.incoming(graph.resolve_links(pages)).collect()} == {"wiki/a.md": 1, "wiki/b.md": 2}


def test_shared_sources_take_four_pages(spark):
    pages = _pages(spark, [(f"wiki/{i}.md", f"T{i}", "note", ["s"], [], T0 + dt.timedelta(days=i), i) for i in range(6)])
    got = {(r.source, r.target) for r in graph.source_edges(pages).collect()}
    assert len(got) == 6 and all(p >= "wiki/2" for e in got for p in e)


def test_long_chain_is_one_component(spark):
    nodes = spark.range(70).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("path"), F.col("id").alias("ord"))
    edges = spark.range(60).select(F.concat(F.lit("n"), (F.col("id") + 1).cast("string")).alias("source"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("target"))
    got = {r.path: r.community for r in graph.components(nodes, edges).collect()}
    assert got["n0"] == got["n60"] == 0 and got["n61"] == 1 and got["n69"] == 9


def test_graph(spark):
    pages = _pages(
        spark,
        [
            ("wiki/sources/a.md", "Alpha", "source", ["raw/a"], ["Beta"], T0, 0),
            ("wiki/sources/converted/a.md", "Alpha full", "source_extract", ["raw/a"], [], T0, 1),
            ("wiki/concepts/beta.md", "Beta", "concept", [], [], T0, 2),
            ("wiki/notes/x.md", "[span]", "note", ["raw/a"], ["Beta"], T0, 3),
            ("wiki/notes/lone.md", "Lonely page", "note", [], [], T0, 4),
        ],
    )
    nodes, edges, insights = graph.build(pages)
    n = {r.path: r for r in nodes.collect()}
    assert "wiki/notes/x.md" not in n and len(n) == 4
    e = {frozenset((r.source, r.target)): r for r in edges.collect()}
    both = e[frozenset(("wiki/sources/a.md", "wiki/sources/converted/a.md"))]
    assert both.weight == 7 and both.reasons == ["shared source: raw/a", "converted markdown"]
    assert n["wiki/sources/a.md"].community == n["wiki/concepts/beta.md"].community != n["wiki/notes/lone.md"].community
    kinds = {r.kind: r for r in insights.collect()}
    assert kinds["gap"].n == 1 and kinds["gap"].paths == ["wiki/notes/lone.md"] and kinds["cluster"].n == 3
    assert (n["wiki/sources/a.md"].x, n["wiki/sources/a.md"].y) == (340, 260)


def test_lint_finds_each_kind(spark):
    P = "path string, title string, type string, content string, body string, sources array<string>, links array<string>, source_path string, ord int"
    pages = spark.createDataFrame(
        [
            ("wiki/a.md", "Dup", "note", "no front", "no front", [], ["Nowhere"], None, 0),
            ("wiki/b.md", "dup", "note", "---\nx", "# H", ["raw/sources/gone.txt", "wiki/gone.md", "https://ok"], [], None, 1),
            ("wiki/sources/s.md", "S", "source", "---\nx", "# H", ["raw/sources/s.txt"], [], "raw/sources/other.txt", 2),
        ],
        P,
    )
    reg = spark.createDataFrame(
        [("raw/sources/s.txt", "ready", None, "wiki/none.md", "wiki/conv.md", 0), ("raw/sources/f.txt", "failed", "boom", None, None, 1)],
        "relativePath string, status string, error string, wikiPath string, convertedPath string, ord int",
    )
    files = spark.createDataFrame([("wiki/conv.md",)], "path string")
    got = lint.lint(pages, reg, files).collect()
    checks = [(r.check, r.path) for r in got]
    assert set(checks) == {
        ("no_front_matter", "wiki/a.md"), ("no_h1", "wiki/a.md"), ("no_sources", "wiki/a.md"), ("broken_link", "wiki/a.md"), ("orphan_page", "wiki/a.md"),
        ("orphan_page", "wiki/b.md"), ("duplicate_title", "wiki/a.md"), ("duplicate_title", "wiki/b.md"), ("source_file_missing", "wiki/b.md"),
        ("source_page_missing", "wiki/b.md"), ("registry_record_missing", "wiki/sources/s.md"), ("source_failed", "raw/sources/f.txt"),
        ("raw_file_missing", "raw/sources/s.txt"), ("source_page_gone", "raw/sources/s.txt"),
    }
    rank = {"error": 0, "warning": 1, "info": 2}
    assert [rank[r.severity] for r in got] == sorted(rank[r.severity] for r in got) and len({r.id for r in got}) == len(got)
    few = [r.check for r in lint.lint(pages, reg, files, max_pages=2).collect()]
    assert "scan_limited" in few and "broken_link" not in few


QUEUE = "id string, sourceId string, relativePath string, status string, createdAt timestamp, updatedAt timestamp, ord int"


def test_quota_sample(spark):
    rows = [(f"{s}{i}", "s", "p", s, T0, T0 + dt.timedelta(minutes=i), k * 100 + i) for k, s in enumerate(["running", "failed", "done", "queued"]) for i in range(10)]
    got = [r.id for r in activity.quota_sample(spark.createDataFrame(rows, QUEUE), 20).collect()]
    assert got[:10] == [f"running{i}" for i in range(9, -1, -1)] and got[10:14] == [f"failed{i}" for i in range(9, 5, -1)]
    assert got[14:19] == [f"done{i}" for i in range(9, 4, -1)] and got[19:] == ["queued0"]
    assert activity.quota_sample(spark.createDataFrame(rows, QUEUE), 100).count() == 40


def test_progress_and_limits(spark):
    rows = [("a", "s", "p", "done", T0, T0, 0), ("b", "s", "p", "queued", T0, T0 + dt.timedelta(1), 1), ("c", "s", "p", "running", T0, T0, 2)]
    r = activity.progress(spark.createDataFrame(rows, QUEUE)).first()
    assert (r.total, r.processed, r.percent, r.currentIndex, r.active, r.next) == (3, 1, 33, 2, "c", "b")
    empty = activity.progress(spark.createDataFrame([], QUEUE)).first()
    assert empty.total == 0 and empty.percent == 0 and empty.active is None
    assert activity.limit_of(None, 5) == 5 and activity.limit_of(10**9, 5) == 5000


def _registry(spark, rows):
    from folioforge.sources.files import REGISTRY

    names = [f.split()[0] for f in REGISTRY.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], REGISTRY)


def test_register_is_idempotent(spark):
    now = F.lit("2024-05-01").cast("timestamp")
    reg = _registry(spark, [dict(id="1", relativePath="raw/sources/a.md", fileName="a.md", sha256="h1", status="ready", convertedPath="wiki/c", kind="markdown"), dict(id="2", relativePath="raw/sources/b.md", fileName="b.md", sha256="h2", status="failed", error="x", kind="markdown")])
    queue = spark.createDataFrame([], QUEUE)
    files = spark.createDataFrame([("a.md", 1, "h1"), ("b.md", 2, "h2"), ("c.txt", 3, "h3"), ("c.txt", 3, "h3"), ("d.exe", 4, "h4")], "relativePath string, size long, sha256 string")
    merged, items, actions = registry.register(files, reg, queue, now)
    assert {(r.relativePath[-5:].strip("/"), r.action) for r in actions.collect()} == {("a.md", "skipped"), ("b.md", "updated"), ("c.txt", "inserted")}
    rows = {r.fileName: r for r in merged.collect()}
    assert rows["b.md"].status == "queued" and rows["b.md"].error is None and rows["b.md"].id == "2" and rows["c.txt"].kind == "text"
    again, more, second = registry.register(files, merged, items.select("id", "sourceId", "relativePath", "status", "createdAt", "updatedAt").withColumn("ord", F.lit(0)), now)
    assert more.count() == 0 and {tuple(r) for r in again.select("id", "sha256").collect()} == {tuple(r) for r in merged.select("id", "sha256").collect()}


def test_registry_repairs(spark):
    reg = _registry(spark, [dict(id="1", relativePath="raw/sources/a.md", sha256="h", status="failed")])
    pages = spark.createDataFrame([("1", "raw/sources/a.md", "h", "wiki/a.md")], "source_id string, source_path string, source_sha string, path string")
    row = registry.ready_by_pages(reg, pages).first()
    assert row.status == "ready" and row.wikiPath == "wiki/a.md"
    failures = spark.createDataFrame([("raw/sources/a.md", "e", 1), ("raw/sources/z.md", "e", 1)], "relativePath string, error string, size long")
    assert registry.record_failures(reg, failures, F.lit("2024-05-01").cast("timestamp")).count() == 2


def test_topics_are_idempotent(spark):
    rows = [("wiki/s1", "S1", "Solar means light from the sun. Other line, here.", 0, ["Solar", "solar", "12"]), ("wiki/s2", "S2", "Nothing of note", 1, ["SOLAR"])]
    src = spark.createDataFrame(rows, "path string, title string, text string, ord int, topics array<string>")
    notes = topics.notes(src, "topics", "concept")
    merged = topics.merge(notes)
    r = merged.first()
    assert merged.count() == 1 and r.key == "solar" and r.sources == ["wiki/s1", "wiki/s2"] and r.notes[0].evidence[0].startswith("Solar means")
    assert topics.merge(notes, notes).first().sources == r.sources
    body = topics.render(merged).first().body
    assert "> Solar means light" in body and body.count("### ") == 2
    found = topics.find_or_create(notes, spark.createDataFrame([("concept", "solar", "wiki/concepts/solar.md")], "kind string, key string, page string"), lambda c: c).first()
    assert found.page == "wiki/concepts/solar.md" and not found.created


def test_index_and_overview(spark):
    pages = spark.createDataFrame([("wiki/a.md", "A", "concept", T0, None, 0), ("wiki/b.md", "B", "source", T0 + dt.timedelta(1), "sum  mary", 1)], "path string, title string, type string, mtime timestamp, summary string, ord int")
    body = topics.index_page(pages).first().body
    assert body.index("[[wiki/b.md|B]] - source") < body.index("[[wiki/a.md|A]] - concept")
    assert "来源页：1" in topics.overview(pages).first().body and "sum mary" in topics.overview(pages).first().body


def test_listing(spark):
    reg = _registry(spark, [dict(id=str(i), fileName=f"f{i}", relativePath=f"raw/{i}", status=s, updatedAt=T0) for i, s in enumerate(["failed", "ready", "queued", "ready"])])
    assert [r.fileName for r in listing.sources_page(reg, "", 3).collect()] == ["f1", "f3", "f2"]
    assert [r.status for r in listing.sources_page(reg, "待处理").collect()] == ["queued"]
    assert listing.sources_page(reg, "F", 1, 1, True).first().total == 4
    rows, flag = listing.limited(reg, 2, "id")
    assert [r[0] for r in rows.select(flag).collect()] == [True, True]


def test_chats(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (2, 0, "user", "only")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.answer, r.question) for r in listing.last_answers(m).collect()} == {(1, "a2", "q2")}
    after = listing.append_turn(m, 1, "q3", "a3").filter("conv_id = 1").orderBy("turn").collect()
    assert [(r.turn, r.text) for r in after[-2:]] == [(4, "q3"), (5, "a3")]


def test_titles_in_letters_of_any_script(spark):
    rows = [("Ö Ö Ö", "Ö Ö Ö\nÖ"), ("Привет мир", "A text of its own."), ("ｐｄｆ", "A text of its own."), ("2024", "A text of its own.")]
    got = analyze.analyze(spark.createDataFrame(rows, "t string, b string"), "t", "b").select("analysis.title").collect()
    assert [r.title for r in got] == ["Ö Ö Ö", "Привет мир", "A text of its own", "A text of its own"]


def test_hrefs_and_uploads(spark):
    pages = spark.createDataFrame([("wiki/x/a.md", "Title"), ("wiki/y/b.md", "Title")], "path string, title string")
    links = spark.createDataFrame([("wiki/y/c.md", "Title"), ("wiki/y/c.md", "x/a"), ("wiki/y/c.md", "none")], "source string, href string")
    assert {r.href: r.path for r in listing.resolve_hrefs(links, pages).collect()} == {"Title": "wiki/y/b.md", "x/a": "wiki/x/a.md"}
    chunks = spark.createDataFrame([("u", 0, 0, 3), ("u", 1, 3, 2), ("v", 0, 0, 3), ("v", 1, 4, 2)], "upload_id string, idx int, offset long, size long")
    assert {r.upload_id: r.complete for r in listing.chunks_in_order(chunks).collect()} == {"u": True, "v": False}


def test_projects(spark):
    import pytest

    now = F.lit(T0)
    rows = spark.createDataFrame([], projects.PROJECT)
    for name in ("My Wiki", "My Wiki", "My Wiki!", "数据", "!!!"):
        rows = projects.create(rows, name, " d ", now)
    got = [r.id for r in rows.collect()]
    assert got[:4] == ["my-wiki", "my-wiki-2", "my-wiki-3", "数据"] and got[4].startswith("wiki-")
    assert projects.get(rows, "my-wiki-2").first().description == "d"
    assert projects.listed(rows, "/data/").first().root == "/data/projects/my-wiki"
    assert projects.touch(rows, "my-wiki", F.lit(T0 + dt.timedelta(days=1))).filter("updatedAt > createdAt").count() == 1
    with pytest.raises(KeyError):
        projects.get(rows, "none")
    for bad in ("", " ", "x" * 201):
        with pytest.raises(ValueError):
            projects.create(rows, bad, "", now)


def test_chats_and_turns(spark):
    import pytest

    chats = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    assert [r.text for r in listing.read_chat(chats, 1).collect()] == ["a", "b"]
    with pytest.raises(KeyError):
        listing.read_chat(chats, 9)
    requests = spark.createDataFrame([(1, True), (1, False), (2, True), (2, False), (3, True)], "conv_id long, uses_history boolean")
    active = spark.createDataFrame([(1, False), (2, False), (2, True)], "conv_id long, uses_history boolean")
    got = sorted((r.conv_id, r.uses_history, r.admitted) for r in listing.admit_turns(requests, active).collect())
    assert got == [(1, False, True), (1, True, False), (2, False, False), (2, True, False), (3, True, True)]


def test_a_name_that_many_pages_share_makes_no_pairs(spark):
    pages = spark.range(3000).selectExpr("concat('wiki/', id % 3, '/', lpad(id, 4, '0'), '.md') AS path", "'Title' AS title")
    links = pages.select(F.col("path").alias("source"), F.lit("title").alias("href")).unionByName(spark.createDataFrame([("wiki/x/y.md", "title")], "source string, href string"))
    # Names are grouped by folder before links meet them.
    out = listing.resolve_hrefs(links, pages)
    assert "_near" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.source.split("/")[1], r.path) for r in out.collect()}
    assert got == {("0", "wiki/0/0000.md"), ("1", "wiki/1/0001.md"), ("2", "wiki/2/0002.md"), ("x", "wiki/0/0000.md")}


def test_upload_sessions(spark):
    declared = spark.createDataFrame([("a", 10), ("b", 10), ("c", 5)], "upload_id string, total long")
    rows = [("a", 0, 0, 4), ("a", 0, 0, 4), ("a", 1, 4, 6), ("b", 0, 0, 4), ("b", 2, 8, 2)]
    got = {r.upload_id: (r.received, r.complete) for r in listing.upload_sessions(declared, spark.createDataFrame(rows, "upload_id string, idx int, offset long, size long")).collect()}
    assert got == {"a": (10, True), "b": (4, False), "c": (0, False)}


def test_index_schema():
    from folioforge.sources import external

    assert external.index_gaps(external.INDEX_FIELDS | {"more": "int32"}) == []
    assert external.index_gaps({**external.INDEX_FIELDS, "title": "int32"}) == ["title"] and len(external.index_gaps({})) == 7
    assert external.collection_name("p").startswith("wiki_") and external.collection_name("p", " own ") == "own"


def test_many_notes_of_a_topic_are_cut_before_they_are_collected(spark):
    noted = spark.range(50).select(
        F.lit("concept").alias("kind"), F.lit("k").alias("key"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit("K").alias("topic"),
        F.lit("t").alias("title"), F.col("id").alias("ord"), F.array().cast("array<string>").alias("evidence"),
    )
    out = topics.merge(noted, most=7)
    assert out.first().sources == [f"p{i}" for i in range(7)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number()") >= 2 and "part" in plan.split("collect_list")[-1]


def test_definitions_are_looked_for_once_a_document(spark):
    from folioforge.operators import topics

    docs = spark.createDataFrame([("p", "t", 1, "Alpha is here.\nBeta means alpha.\nGamma ends.", ["Alpha", "Delta"])], "path string, title string, ord long, text string, topics array<string>")
    noted = topics.notes(docs, "topics", "concept")
    plan = noted._jdf.queryExecution().optimizedPlan().toString()
    assert topics.DEFINES in plan[plan.index("Generate explode") :] and topics.DEFINES not in plan[: plan.index("Generate explode")]
    got = {r.key: r.evidence for r in noted.collect()}
    assert got == {"alpha": ["Beta means alpha.", "Alpha is here."], "delta": ["Beta means alpha.", "Alpha is here.", "Gamma ends."]}
