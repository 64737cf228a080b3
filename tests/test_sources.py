import datetime as dt
import hashlib
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.sources import files, sinks
from folioforge.streaming import ingest


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_directory_and_metadata(spark, tmp_path):
    (tmp_path / "concepts").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "concepts/a.md").write_text("---\ntitle: Alpha\ntags: [x]\n---\n# H\n来源路径：`raw/1`\n[[Beta]]")
    (tmp_path / ".git/b.md").write_text("no")
    (tmp_path / "c.txt").write_bytes("中华人民共和国规定".encode("gb18030"))
    rows = files.files(spark, str(tmp_path), (".md",))
    meta = files.page_metadata(rows).collect()
    assert [(m.path, m.title, m.type, m.tags, m.sources, m.links) for m in meta] == [("wiki/concepts/a.md", "Alpha", "concept", ["x"], ["raw/1"], ["Beta"])]
    assert files.texts(spark, str(tmp_path), ".txt").first().text == "中华人民共和国规定"


def test_json_tables(spark, tmp_path):
    p = tmp_path / "chats.json"
    p.write_text("\ufeff" + json.dumps([{"id": "c", "updatedAt": "2024-01-01T00:00:00Z", "messages": [{"role": "user", "content": "hi"}]}]))
    assert [(r.conv_id, r.turn, r.text) for r in files.messages(files.chats(spark, str(p))).collect()] == [("c", 0, "hi")]
    (tmp_path / "empty.json").write_text("")
    assert files.queue(spark, str(tmp_path / "empty.json")).count() == 0


def test_office(spark):
    docx = _zip([("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>')])
    pptx = _zip([(f"ppt/slides/slide{i}.xml", f'<p xmlns:a="a"><a:p><a:t>S{i}</a:t></a:p></p>') for i in (10, 2)])
    xlsx = _zip(
        [
            ("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>'),
            ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet9.xml"/></Relationships>'),
            ("xl/sharedStrings.xml", "<sst><si><t>multi\nline</t></si></sst>"),
            ("xl/worksheets/sheet9.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'),
        ]
    )
    assert files.xlsx_sheets(xlsx) == [("One", [["multi line", "", "3"]])]
    rows = spark.createDataFrame([("a.docx", bytearray(docx)), ("b.pptx", bytearray(pptx)), ("c.xlsx", bytearray(xlsx)), ("d.doc", bytearray(b"x")), ("e.docx", bytearray(b"bad")), ("f.html", bytearray(b"<p>hi</p>"))], "relativePath string, content binary").withColumn("size", F.length("content").cast("long"))
    got = {r.relativePath: r for r in files.extract(rows).collect()}
    assert got["a.docx"].markdown.startswith("## Head\n\nText\n\n| a | |") and got["b.pptx"].markdown.index("S2") < got["b.pptx"].markdown.index("S10")
    assert got["d.doc"].metadata_only and got["e.docx"].warning.startswith("BadZipFile") and got["f.html"].markdown == "hi"


def test_archives(spark):
    data = _zip([("a.md", "1"), ("A.md", "2"), ("../x.md", "3"), ("b.exe", "4"), ("#U4e2d.txt", "5")])
    rows = spark.createDataFrame([("z.zip", bytearray(data)), ("bad.zip", bytearray(b"no"))], "relativePath string, content binary")
    got = files.unzip(rows).collect()
    assert {r.entry for r in got if r.skipped is None} == {"a.md", "A-2.md", "中.txt"}
    assert {r.skipped for r in got if r.skipped} == {"unsafe path", "unsupported", "not an archive"}


def test_uploads(spark):
    data = b"hello world"
    sha = hashlib.sha256(data).hexdigest()
    rows = [("u", 1, 6, 5, bytearray(data[6:]), sha), ("u", 0, 0, 6, bytearray(data[:6]), sha), ("u", 0, 0, 6, bytearray(data[:6]), sha), ("v", 1, 3, 1, bytearray(b"x"), "")]
    got = files.assemble_uploads(spark.createDataFrame(rows, "upload_id string, idx int, offset long, size long, data binary, sha256 string")).collect()
    assert len(got) == 1 and bytes(got[0].content) == data and got[0].valid


def test_sinks(spark, tmp_path):
    t = str(tmp_path / "t")
    sinks.replace_table(spark.range(3).withColumn("signature", F.lit("a")), t)
    sinks.sync_index(t, spark.range(1, 5).withColumn("signature", F.lit("b")))
    assert sorted(r.id for r in sinks.read_table(spark, t).collect()) == [1, 2, 3, 4]
    page = spark.range(1).select(sinks.source_page(*map(F.lit, ("raw/a", 'T "q"', "markdown", "sum")), F.array(F.lit("p")), F.array().cast("array<string>"), F.lit("x\ny"), F.lit("now")).alias("b")).first().b
    assert 'title: "T \\"q\\""' in page and "- p" in page and "_暂无_" in page and "> x\n> y" in page


def test_a_failing_replacement_leaves_the_old_table(spark, tmp_path):
    t = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, t)
    assert sinks.read_table(spark, t, missing_ok=True) is None
    sinks.replace_table(spark.range(10), t)
    half = spark.range(100).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        sinks.replace_table(half, t)
    assert sinks.read_table(spark, t).count() == 10
    held = sinks.read_table(spark, t)
    sinks.replace_table(held.filter("id > 4"), t)
    assert held.count() == 10 and sinks.read_table(spark, t).count() == 5  # who had begun can end
    sinks.replace_table(sinks.read_table(spark, t).filter("id > 7").withColumn("n", F.col("id") + 1), t, ("id",))
    assert sorted(r.id for r in sinks.read_table(spark, t).collect()) == [8, 9]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) <= 3  # the failed one is swept by the next


def test_pages_are_added_and_unsafe_paths_refused(spark, tmp_path):
    root, schema = str(tmp_path / "pages"), "path string, body string"
    write = lambda rows: sinks.write_pages(spark.createDataFrame(rows, schema), root)
    write([("wiki/a.md", "one"), ("wiki~a.md", "tilde"), ("wiki/50%.md", "x\ny\n")])
    write([("wiki/b.md", "two"), ("wiki/a.md", "new")])
    want = {("wiki/a.md", "new"), ("wiki~a.md", "tilde"), ("wiki/50%.md", "x\ny\n"), ("wiki/b.md", "two")}
    assert {tuple(r) for r in sinks.read_pages(spark, root).collect()} == want
    for bad in ("../x", "/x", "a/../b", "C:x", "", None, "..\\x"):
        with pytest.raises(ValueError):
            write([("wiki/c.md", "no"), (bad, "no")])
    assert {tuple(r) for r in sinks.read_pages(spark, root).collect()} == want


def test_stream_resumes_and_skips_what_it_has_seen(spark, tmp_path):
    root, sink, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    root.mkdir()
    (root / "a.md").write_text("# Alpha\n\nSome text that is a long enough sentence.")
    ingest.run_once(spark, str(root), sink, cp).awaitTermination()
    first = spark.read.parquet(sink).collect()
    (root / "b.doc").write_bytes(b"x")
    ingest.run_once(spark, str(root), sink, cp).awaitTermination()
    rows = spark.read.parquet(sink).collect()
    assert len(first) == 1 and len(rows) == 2 and {r.status for r in rows} == {"ready", "failed"}
    again = [("a.md", b"changed"), ("a.md", b"changed"), (rows[0].relativePath, b"x"), (rows[1].relativePath, b"x")]
    batch = spark.createDataFrame([(p, bytearray(d)) for p, d in again], "relativePath string, content binary")
    doc = next(r.relativePath for r in rows if r.relativePath.endswith("b.doc"))
    left = sorted((r.relativePath == doc, bytes(r.content)) for r in ingest.new_files(batch, sink, 7).collect())
    assert left == [(False, b"changed"), (False, b"x")]  # a path's new content is new, b.doc's is not
    assert not list((tmp_path / "cp" / "state").glob("*"))  # no state is kept


def test_recovery(spark):
    queue = spark.createDataFrame([("a", "running"), ("b", "done")], "id string, status string")
    assert {(r.id, r.status) for r in ingest.recover(queue).collect()} == {("a", "queued"), ("b", "done")}


def test_circuit_breaker(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(title, text):
        (calls / f"{os.getpid()}-{title}").write_text("x")
        if title != "fine":
            raise RuntimeError("down")
        return {"title": "model"}

    run = ingest.circuit_broken(model, lambda t, x: {"title": t}, "title string")
    rows = spark.createDataFrame([(str(i), "t") for i in range(8)], "title string, text string").repartition(8)
    assert sorted(r.title for r in run(rows).collect()) == [str(i) for i in range(8)]
    assert len(run(rows).collect()) == 8 and len(os.listdir(calls)) == 1  # eight tasks, two batches, one call
    alive = ingest.circuit_broken(model, lambda t, x: {"title": t}, "title string")
    assert [r.title for r in alive(spark.createDataFrame([("fine", "t")] * 3, "title string, text string")).collect()] == ["model"] * 3
    assert alive(rows.limit(0)).count() == 0


@pytest.mark.parametrize("text,n", [("a\fb\f", 2), ("one", 1)])
def test_pdf_pages(spark, text, n):
    assert files.pdf_pages(spark.createDataFrame([("p", text)], "path string, text string")).count() == n
