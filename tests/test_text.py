import pytest
from pyspark.sql import functions as F

from folioforge.functions import codecs, markdown, paths, query, text

P = text.PLACEHOLDER


def test_unknown_runs(col):
    assert col(text.clean_unknown, ["a???b", "a��", "锟斤拷锟斤拷", "??? ??", "a??b"]) == [f"a{P}b", f"a{P}", P, f"{P} ??", "a??b"]
    assert col(text.is_unknown, ["", "?", "??", "？", "?? ok ok", "��!!", "中文??"]) == [False, False, True, False, False, True, False]
    assert col(lambda c: text.readable_or(c, F.lit("x")), ["  a \n b ", "????", ""]) == ["a b", "x", "x"]


def test_normalize(col):
    assert col(text.normalize, ["a\r\nb", "a\tb", "a \u00a0 b", "a\n\n\n\nb", "\u3000a\ufeff", ""]) == ["a\nb", "a b", "a b", "a\n\nb", "a", ""]


@pytest.mark.parametrize(
    "label,low",
    [
        ("untitled", True), ("Untitled-abc", True), ("未命名页面", True), ("deadbeef01", True), ("pdf", True), ("2024", True), ("12mm", True),
        ("2024-01-02", True), ("3d", True), ("12ab34", True), ("---", True), ("", True), ("１２３", True), ("12a4", True), ("machine learning", False),
        ("合同法", False), ("GPT-4 model", False), ("page", True), ("pages of history", False),
    ],
)
def test_low_information(col, label, low):
    assert col(text.is_low_information, [label]) == [low]


def test_tokens(col):
    got = col(text.tokens, ["The Quick-fox and 合同法律 的规定 中", "Ab c12 é-été", "一二三四五六七八九"])
    assert got == [["quick-fox", "合同法律"], ["c12"], []]
    assert query.tokenize("The Quick-fox and 合同法律 的规定 中") == got[0]
    assert col(lambda c: text.top_keywords(c, 2), ["bbb aaa bbb ccc aaa", "", "zzz"]) == [["aaa", "bbb"], [], ["zzz"]]
    assert col(lambda c: text.by_count(F.split(c, " ")), ["b a b c a d"]) == [["b", "a", "c", "d"]]


def test_sentences(col):
    s = "This is the first sentence. And here is another one! Short. 这是第一句话，它的长度超过了十八个字符。第二句也要足够长才可以被保留下来，是的。"
    got = col(text.sentences, [s])[0]
    assert got[0] == "This is the first sentence." and got[1] == "And here is another one!" and len(got) == 4


def test_sentences_keep_digits_at_their_ends(col):
    s = "0997523947200283 is where it starts. 1683436113538828 comes second. This third sentence ends in 12"
    assert col(text.sentences, [s]) == [["0997523947200283 is where it starts.", "1683436113538828 comes second.", "This third sentence ends in 12"]]


def test_named_phrases(col):
    got = col(text.named_phrases, ["中文Hello World中 Foo and The Big Big Apple Big Apple 《民法典》 “quoted name” a"])[0]
    assert got[:2] == ["Hello World", "Foo"] and "民法典" in got and "quoted name" in got
    assert col(text.compact_repeat, ["A B A B", "A B C", "A b a B"]) == ["A B", "A B C", "A b"]


def test_headings_and_titles(col):
    assert col(text.headings, ["# One\ntext\n## `Two`\n##### no"]) == [["One", "Two"]]
    assert col(text.clean_title, ["# Heading *x*", "https://a.b", "标题：名字", "x" * 70]) == ["Heading x", "", "名字", "x" * 63 + "…"]
    assert col(text.url_title, ["https://Ex.com/a%20b/", "no url", "https://ex.com/"]) == ["ex.com/a b", "no url", "ex.com"]
    assert col(lambda c: text.derive_title(c, F.lit("none")), ["# A Real Heading\nbody", "see https://ex.com/guide now", "12"]) == ["A Real Heading", "ex.com/guide", "none"]


def test_titles_look_at_their_text_once(spark):
    # Every mention inside a lambda is evaluated anew, so expressions that repeat their argument multiply.
    size = lambda f: len(spark.range(1).select(f(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString())
    assert size(lambda c: text.derive_title(text.clean_title(c), F.lit("none"))) < 3 * size(lambda c: text.derive_title(c, F.lit("none")))


def test_excerpt_takes_the_latest_first_occurrence(col):
    s = "alpha " + "x" * 400 + " omega " + "y" * 400
    got = col(lambda c: text.excerpt_around(c, ["alpha", "omega"]), [s, ""])
    assert "omega" in got[0] and "alpha" not in got[0] and len(got[0]) <= 260 and got[1] == ""
    assert col(lambda c: text.excerpt_around(c, ["nope"]), ["short text"]) == ["short text"]


def test_paragraphs(col):
    md = "---\ntitle: x\n---\n# Head\n\n> Quoted prose, with a stop.\n\n- item that must, be kept!\n```\ncode; here.\n```\nno stop\nURL: https://x.y.\n合同是指双方的协议"
    assert col(text.content_paragraphs, [md]) == [["Quoted prose, with a stop.", "item that must, be kept!", "合同是指双方的协议"]]
    assert col(text.first_paragraph, [md])[0] == "Quoted prose, with a stop."


def test_occurrences_do_not_overlap(col):
    assert col(lambda c: text.occurrences(c, "aa"), ["aaaa", "aaa", "b"]) == [2, 1, 0]


def test_low_quality(col):
    assert col(lambda c: text.is_low_quality(F.lit("t"), c), ["fine", "one ??? run", "a \ufffd", ""]) == [False, True, True, False]
    assert col(lambda c: text.is_unreadable(c), ["问题内容包含无法识别字符", "x ???", "ok"]) == [True, True, False]


def test_redaction_and_slug(col):
    got = col(lambda c: text.diagnostic(c, ["s3cret"]), ["Authorization: Bearer abc.def", "key s3cret x", "fetch failed: s3cret", "a\ufffd\ufffd"])
    assert got == ["Authorization: Bearer [已隐藏]", "key [已隐藏] x", "无法连接服务，请检查地址、端口及服务是否运行。", "a[无法识别字符]"]
    assert col(lambda c: text.source_text(c, 9), ["<b>a</b>  &lt;x&gt; and more", "bad\x07", "&amp;lt;"]) == ["a <x> and", "", "<"]
    assert col(text.slug, ["Hello, World!", "合同 法"]) == ["hello-world", "合同-法"] and len(col(text.slug, ["!!!"])[0]) == 8


def test_query_tokens():
    got = query.search_tokens("如何签订合同法律规定")
    assert "签订合同法律规定" in got and all(len(t) >= 2 for t in got) and len(got) <= 40 and "如何" not in got
    assert query.anchors("Quick fox jumps")[0] == "quick fox jumps" and query.anchors("") == []
    assert query.is_follow_up("继续") and not query.is_follow_up("合同")


def test_markdown(col):
    md = "See [[A#x|label]] and [[B]] `[[no]]`\n```\n[[code]]\n~~~\n```\n[t](page.md) [u](http://x)"
    assert col(markdown.wiki_links, [md]) == [["A", "B"]] and col(markdown.markdown_links, [md]) == [["page.md"]]
    assert col(markdown.plain_text, ["## H\n- **b** [t](u) [[P|L]] `c` ![i](j)"]) == ["H\nb t L c "]
    fm = "---\ntitle: Name\ntags: [a, b]\nsources: one\n---\n# Head\ntext"
    assert col(lambda c: markdown.title(markdown.front_matter_json(c), c, F.lit("f")), [fm, "# Only\nx", "none"]) == ["Name", "Only", "f"]
    assert col(lambda c: markdown.front_list(markdown.front_matter_json(c), "tags"), [fm, "x"]) == [["a", "b"], []]
    assert col(lambda c: markdown.front_list(markdown.front_matter_json(c), "sources"), [fm]) == [["one"]]
    assert col(lambda c: markdown.body(c, markdown.front_matter_json(c)), [fm, "---\n- list\n---\nx"]) == ["# Head\ntext", "---\n- list\n---\nx"]
    assert col(markdown.html_to_text, ["<p>a</p><script>x<b></script><style>y</style> b"]) == ["a b"]
    assert col(markdown.column_index, ["A1", "Z9", "AA3"]) == [0, 25, 26]
    assert col(markdown.table, [[["a"], ["b", "c"]]], "array<array<string>>") == ["| a |  |\n| --- | --- |\n| b | c |"]
    assert col(lambda c: markdown.title_from_text(c, F.lit("fb")), ["x\nA real title\n", "# Top\n", ""]) == ["A real title", "Top", "fb"]
    note = "### T\n\n来源：[[p|T]]\n来源路径：`wiki/p.md`\n\nsome text\n"
    assert col(markdown.source_notes, [note])[0][0]["path"] == "wiki/p.md"


def test_paths(col):
    assert col(paths.kind, ["a.MD", "b.xlsx", "c.bin"]) == ["markdown", "table", "bin"]
    assert col(paths.page_type, ["sources/converted/a", "sources/a", "x.md"]) == ["source_extract", "source", "note"]
    assert col(paths.is_unsafe_entry, ["a/../b", "/x", "C:\\x", "a/b..c"]) == [True, True, True, False]
    assert col(paths.is_web_url, ["https://a.b/c", "ftp://a", "http://u:p@a", "x"]) == [True, False, False, False]
    assert col(paths.is_evidence, ["wiki/index.md", "wiki/queries/a", "wiki/notes/a"]) == [False, False, True]


def test_codecs(col):
    s = "中华人民共和国法律规定"
    data = [s.encode("utf-8"), s.encode("gb18030"), s.encode("utf-16"), s.encode("utf-8").decode("latin-1").encode("utf-8"), "plain".encode()]
    assert [codecs.decode_bytes(d) for d in data] == [s, s, s, s, "plain"]
    assert col(codecs.decode_text, [bytearray(data[1])], "binary") == [s]
    assert codecs.repair_name("#U4e2d#U6587.txt") == "中文.txt" and codecs.repair_name("中文".encode("gb18030").decode("cp437")) == "中文"
    long = codecs.safe_name("长" * 100 + ".pdf")
    assert len(long.encode()) <= 180 and long.endswith(".pdf") and codecs.safe_name('a<b>:"c') == "a_b___c"
    assert codecs.shorten_utf8("中文", 4) == "中"


def test_compatibility_forms(col):
    assert col(text.nfkc, ["ﬁle ⑩ ㎏ ｶﾞ ＡＢ", "e\u0301", "plain", None]) == ["file 10 kg ガ AB", "é", "plain", None]
    assert col(text.slug, ["Crème Brûlée", "ﬁne №5", "Ångström"]) == ["creme-brulee", "fine-no5", "angstrom"]
    assert col(text.is_low_information, ["１２３", "⑫㎏", "ﬁle", "ｶﾞｲﾄﾞ", "Überblick"]) == [True, True, True, True, False]


def test_low_quality_is_seen_in_sound_bodies_too(spark):
    rows = [("t", "good text"), ("??", "good text"), (None, "good text"), ("t", "bad ??? text"), ("t", "bad \ufffd"), ("无法识别的问题", "good"), ("t", "?!"), ("t", "!"), ("", ""), ("t", None), (None, None), ("a", "锟斤拷")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, b string")
    got = [r.q for r in df.orderBy("i").select(text.is_low_quality(F.col("t"), F.col("b")).alias("q")).collect()]
    assert got == [False, True, False, True, True, True, False, False, True, False, True, True]


def test_trim_leaves_what_is_no_white_space(col):
    assert col(text.trim, ["a \u0085", "﻿　a b\r\n", " \n", ""]) == ["a \u0085", "a b", "", ""]


def test_composition_is_asked_for_only_where_it_may_change_a_text(spark, col):
    import unicodedata

    latin = [chr(c) + "x" for c in range(0x80, 0x180)] + ["é", "ȩ́", "知識"]
    assert col(text.nfkc, latin) == [unicodedata.normalize("NFKC", v) for v in latin]
    assert col(lambda c: c.rlike(text._COMPOSED), ["plain", "Größe über São Émile ñ", "²", "é", "ﬁ"]) == [False, False, True, True, True]
