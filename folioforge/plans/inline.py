"""Queries over sources, sinks and text functions: the driver's tables, encoded, written or packed first, then read by the operator.

They register in the same catalogue; each twin says in SQL what must come out.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioforge.functions import codecs, display, markdown, paths, text
from folioforge.operators import activity, analyze, graph, listing, projects, registry, tasks, topics
from folioforge.operators.tables import scratch_root
from folioforge.plans import shapes
from folioforge.plans.catalogue import GRAPH, QU, REG, WEB, _linked_pages, _quote, query, sql_normalize
from folioforge.plans.shapes import table
from folioforge.sources import external, files, sinks


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _case(c: str, values: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} IN ({', '.join(map(_quote, v))}) THEN {_quote(k)}" for k, v in values.items()) + f" ELSE {other} END"


# ---------------------------------------------------------------- bytes and files
@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, length(text)::BIGINT AS n FROM documents")
def decoded_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as UTF-16 bytes with a mark, decoded again."""
    rows = table(spark, sf_dir, "documents").select("doc_id", codecs.decode_text(F.encode("text", "UTF-16")).alias("t"))
    return rows.select("doc_id", F.sha2(F.coalesce("t", F.lit("")), 256).alias("sha"), F.length("t").cast("long").alias("n"))


@query("SELECT 'wiki/notes/' || r_name || '/' || n_name || '.md' AS path, n_name || chr(10) || r_name AS body FROM nation JOIN region ON r_regionkey = n_regionkey")
def written_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written in two goes, by region, and read back; the second go leaves the first one's alone."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pages = rows.select(F.concat(F.lit("wiki/notes/"), "r_name", F.lit("/"), "n_name", F.lit(".md")).alias("path"), F.concat("n_name", F.lit("\n"), "r_name").alias("body"), "r_name")
    root = _folder(spark, "pages")
    sinks.write_pages(pages.filter("r_name < 'B'"), root)
    sinks.write_pages(pages.filter("r_name >= 'B'"), root)
    return sinks.read_pages(spark, root)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, S3: a table written as one JSON array with a byte-order mark and read back."""
    rows = table(spark, sf_dir, "nation")
    one = rows.agg(F.concat(F.lit("﻿"), F.to_json(F.collect_list(F.struct(*rows.columns)))).alias("value"))  # 25 rows
    root = _folder(spark, "json")
    one.coalesce(1).write.text(root)
    return files.json_table(spark, root, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT p_partkey, p_name, p_size FROM part")
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3: a table replaced by one made from itself."""
    root = _folder(spark, "parts")
    sinks.replace_table(table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") + 1).alias("p_size")), root)
    sinks.replace_table(sinks.read_table(spark, root).withColumn("p_size", F.col("p_size") - 1), root)
    return sinks.read_table(spark, root)


@query("SELECT 'ingest' AS kind, r_name AS text FROM region")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each region, appended one after the other."""
    root = _folder(spark, "log")
    for r in table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect():  # five rows
        sinks.append_log(spark, root, "ingest", r.r_name)
    return spark.read.parquet(root).select("kind", "text")


def _zipped(entries: list[tuple[str, str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def _packed(rows: DataFrame, pack) -> DataFrame:
    """(relativePath, content): a file for each key of (key, name), packed on the executors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path, content = pack(pdf["key"].iloc[0], sorted(pdf["name"]))
        return pd.DataFrame({"relativePath": [path], "content": [content]})

    return rows.groupBy("key").applyInPandas(run, "relativePath string, content binary").withColumn("size", F.length("content").cast("long"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("r_name").alias("key"), F.col("n_name").alias("name"))


RN = "rn AS (SELECT r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey)"


@query(
    f"""WITH {RN} SELECT r_name || '.zip' AS archive, 'n/' || n_name || '.txt' AS entry, length(n_name)::BIGINT AS size, n_name AS content, NULL AS skipped FROM rn
UNION ALL SELECT r_name || '.zip', '中.txt', 1, 'x', NULL FROM region UNION ALL SELECT r_name || '.zip', 'a.exe', 1, NULL, 'unsupported' FROM region
UNION ALL SELECT r_name || '.zip', 'A.md', 1, '1', NULL FROM region UNION ALL SELECT r_name || '.zip', 'a-2.md', 1, '2', NULL FROM region"""
)
def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive a region, with escaped names, names that collide and a kind that is not taken."""
    more = [("#U4e2d.txt", "x"), ("a.exe", "y"), ("A.md", "1"), ("a.md", "2")]
    packed = _packed(_regions(spark, sf_dir), lambda key, names: (f"{key}.zip", _zipped([(f"n/{n}.txt", n) for n in names] + more)))
    return files.unzip(packed).select("archive", "entry", "size", F.col("content").cast("string").alias("content"), "skipped")


@query(f"""WITH {RN} SELECT r_name || '.docx' AS "relativePath", '# ' || r_name || chr(10) || chr(10) || string_agg(n_name, chr(10) || chr(10) ORDER BY n_name) AS markdown FROM rn GROUP BY r_name""")
def word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Word document a region, a paragraph a nation."""

    def pack(key, names):
        p = lambda t, style="": f"<w:p>{style}<w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
        head = p(key, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>')
        return f"{key}.docx", _zipped([("word/document.xml", f'<w:document xmlns:w="w"><w:body>{head}{"".join(map(p, names))}</w:body></w:document>')])

    return files.extract(_packed(_regions(spark, sf_dir), pack)).select("relativePath", "markdown")


@query(
    f"""WITH {RN} SELECT r_name || '.xlsx' AS "relativePath", '## Nations' || chr(10) || chr(10) || '| name | | n |' || chr(10) || '| --- | --- | --- |' || chr(10)
|| string_agg('| ' || n_name || ' | | 1 |', chr(10) ORDER BY n_name) AS markdown FROM rn GROUP BY r_name"""
)
def spreadsheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook a region, a row a nation, with shared strings and an empty cell."""

    def pack(key, names):
        shared = "".join(f"<si><t>{escape(n)}</t></si>" for n in ["name", "n", *names])
        head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        rows = "".join(f'<row r="{i + 2}"><c r="A{i + 2}" t="s"><v>{i + 2}</v></c><c r="C{i + 2}"><v>1</v></c></row>' for i in range(len(names)))
        return f"{key}.xlsx", _zipped(
            [
                ("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Nations" r:id="rId1"/></sheets></workbook>'),
                ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet7.xml"/></Relationships>'),
                ("xl/sharedStrings.xml", f"<sst>{shared}</sst>"),
                ("xl/worksheets/sheet7.xml", f"<worksheet><sheetData>{head}{rows}</sheetData></worksheet>"),
            ]
        )

    done = files.extract(_packed(_regions(spark, sf_dir), pack))
    return done.select("relativePath", F.regexp_replace("markdown", " +", " ").alias("markdown"))


@query(f"""WITH {RN} SELECT r_name || '.pptx' AS "relativePath", count(*)::BIGINT AS slides, string_agg(n_name, ' ' ORDER BY n_name) AS names FROM rn GROUP BY r_name""")
def presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A presentation a region, a slide a nation, in order of their numbers."""

    def pack(key, names):
        slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:t>{escape(t)}</a:t></a:p></p:sld>'
        return f"{key}.pptx", _zipped([(f"ppt/slides/slide{i + 1}.xml", slide(n)) for i, n in reversed(list(enumerate(names)))])

    done = files.extract(_packed(_regions(spark, sf_dir), pack))
    parts = F.filter(F.split("markdown", "\\n+"), lambda x: (x != "") & ~x.startswith("## "))
    return done.select("relativePath", F.regexp_count("markdown", F.lit("(?m)^## ")).cast("long").alias("slides"), F.array_join(parts, " ").alias("names"))


@query(f"""WITH {RN} SELECT r_name || '.docx' AS archive, 'word/media/' || n_name || '.png' AS asset, length(n_name)::BIGINT AS size, 'raw/assets/' || substr(sha256(r_name || '.docx'), 1, 12) || '/' || n_name || '.png' AS path FROM rn""")
def media_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3: the pictures in a document a region."""
    return files.media(_packed(_regions(spark, sf_dir), lambda key, names: (f"{key}.docx", _zipped([("word/document.xml", "<x/>"), *((f"word/media/{n}.png", n) for n in names)]))), "raw/assets")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(12)), chr(12))) AS x, generate_subscripts(string_split(replace(text, chr(10), chr(12)), chr(12)), 1) AS i FROM documents)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS page, sha256(x) AS sha FROM l WHERE trim(x) <> ''"""
)
def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of layout text, one for each line of a document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\n", "\f").alias("text"))
    return files.pdf_pages(rows).select("doc_id", F.col("page").cast("long").alias("page"), F.sha2("page_text", 256).alias("sha"))


@query(f"WITH {WEB}, t AS (SELECT page_id, {sql_normalize("regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[\\s\\S]*?</script>', ' ', 'g'), '(?i)<style[\\s\\S]*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')")} AS t FROM pages) SELECT page_id::VARCHAR AS id, title, url, sha256('URL: ' || url || chr(10) || chr(10) || t) AS sha FROM web JOIN pages USING (page_id) JOIN t USING (page_id)")
def web_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a clip."""
    return files.web_clips(table(spark, sf_dir, "pages")).select("id", "title", "url", F.sha2("text", 256).alias("sha"))


# ---------------------------------------------------------------- uploads, chats, listings
CHUNKS = """ch AS (SELECT l_orderkey AS upload_id, (row_number() OVER w - 1)::INT AS idx, l_quantity::BIGINT AS size, l_linestatus AS st,
    coalesce(sum(l_quantity::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
cu AS (SELECT upload_id, idx, size, begins + CASE WHEN st = 'F' AND idx = 2 THEN 1 ELSE 0 END AS "offset" FROM ch)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as chunks of uploads; some third chunks begin a byte too late."""
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    before = F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload_id"), (F.row_number().over(along) - 1).alias("idx"), F.col("l_quantity").cast("long").alias("size"), before.alias("at"), "l_linestatus")
    late = F.when((F.col("l_linestatus") == "F") & (F.col("idx") == 2), 1).otherwise(0)
    return rows.select("upload_id", "idx", "size", (F.col("at") + late).alias("offset"))


@query(
    f"""WITH {CHUNKS}, x AS (SELECT *, "offset" = coalesce(lag("offset" + size) OVER (PARTITION BY upload_id ORDER BY idx), 0) AS ok FROM cu)
SELECT upload_id, count(*)::BIGINT AS chunks, sum(size)::BIGINT AS size, bool_and(ok) AS complete FROM x GROUP BY upload_id"""
)
def upload_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads whose chunks follow each other without a gap."""
    return listing.chunks_in_order(_chunks(spark, sf_dir))


@query(
    f"""WITH {CHUNKS}, x AS (SELECT *, "offset" = coalesce(lag("offset" + size) OVER (PARTITION BY upload_id ORDER BY idx), 0) AS ok FROM cu),
y AS (SELECT *, bool_and(ok) OVER (PARTITION BY upload_id ORDER BY idx) AS whole FROM x), z AS (SELECT upload_id, coalesce(sum(size) FILTER (WHERE whole), 0)::BIGINT AS received, sum(size)::BIGINT AS total FROM y GROUP BY upload_id)
SELECT upload_id, total, received, received = total AS complete FROM z"""
)
def upload_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every upload goes on."""
    chunks = _chunks(spark, sf_dir)
    return listing.upload_sessions(chunks.groupBy("upload_id").agg(F.sum("size").alias("total")), chunks)


@query("SELECT doc_id, n_chars, true AS limited FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100)")
def limited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred longest documents, and that there are more."""
    rows, flag = listing.limited(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 100, F.desc("n_chars"), F.asc("doc_id"))
    return rows.select("doc_id", "n_chars", flag.alias("limited"))


@query(f"WITH {WEB} SELECT path, title FROM web WHERE contains(regexp_replace(path, '^wiki/', ''), '7') ORDER BY path LIMIT 40 OFFSET 10")
def pages_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the pages whose path has a 7."""
    return listing.pages_page(shapes.web_pages(spark, sf_dir), "7", 40, 10).select("path", "title")


@query(f"WITH {WEB}, l AS (SELECT DISTINCT path AS source, title AS href FROM web WHERE title <> '') SELECT source, href, min(path) AS path FROM l JOIN web ON lower(title) = lower(href) GROUP BY ALL")
def href_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by title; pages of the same folder first, here all."""
    pages = shapes.web_pages(spark, sf_dir)
    links = pages.filter("title <> ''").select(F.col("path").alias("source"), F.col("title").alias("href")).distinct()
    return listing.resolve_hrefs(links, pages)


@query(
    """SELECT conv_id, turn, role, text FROM conversations UNION ALL
SELECT 1, max(turn) + d, r, t FROM conversations, (VALUES (1, 'user', 'why?'), (2, 'assistant', 'so.')) AS v(d, r, t) WHERE conv_id = 1 GROUP BY d, r, t"""
)
def chat_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question and its answer at the end of a conversation."""
    return listing.append_turn(table(spark, sf_dir, "conversations"), 1, "why?", "so.")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def chat_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations but those with a system message."""
    chats = table(spark, sf_dir, "conversations")
    return listing.delete_chats(chats, chats.filter("role = 'system'").select("conv_id")).select("conv_id", "turn")


@query(
    """WITH a AS (SELECT conv_id, bool_or(role = 'assistant') AS h FROM conversations WHERE turn >= 2 GROUP BY conv_id), r AS (SELECT conv_id, turn, role = 'user' AS uses_history FROM conversations WHERE turn < 2)
SELECT r.conv_id, turn, uses_history, NOT coalesce(a.conv_id IS NOT NULL AND (uses_history OR h), false) AS admitted FROM r LEFT JOIN a ON a.conv_id = r.conv_id"""
)
def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early turns as requests while later ones are being answered."""
    chats = table(spark, sf_dir, "conversations")
    requests = chats.filter("turn < 2").select("conv_id", "turn", (F.col("role") == "user").alias("uses_history"))
    return listing.admit_turns(requests, chats.filter("turn >= 2").select("conv_id", (F.col("role") == "assistant").alias("uses_history")))


# ---------------------------------------------------------------- paths, names, Markdown
_KINDS = {k: [e[1:] for e in v.split()] for k, v in paths.KINDS.items()}
_EXT = "lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1))"


@query(
    f"""WITH p AS (SELECT p_partkey, replace(p_brand, '#', '/') || '/' || p_name || [{', '.join(_quote(e) for e in ('.md', '.PDF', '.xlsx', '', '.zip', '.yaml', '.exe'))}][p_size % 7 + 1] AS path FROM part),
e AS (SELECT *, {_EXT} AS extension FROM p)
SELECT p_partkey, extension, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem,
{_case("ltrim(extension, '.')", _KINDS, "CASE WHEN extension = '' THEN 'file' ELSE ltrim(extension, '.') END")} AS kind, extension IN ({', '.join(map(_quote, paths.SUPPORTED))}) AS supported,
extension IN ({', '.join(map(_quote, paths.RAW_TEXT))}) AS raw FROM e"""
)
def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a path says."""
    ends = F.array(*(F.lit(e) for e in (".md", ".PDF", ".xlsx", "", ".zip", ".yaml", ".exe")))
    path = F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("/")), F.lit("/"), "p_name", F.get(ends, F.col("p_size") % 7))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    p = F.col("path")
    return rows.select(
        "p_partkey", paths.extension(p).alias("extension"), paths.base_name(p).alias("base"), paths.stem(p).alias("stem"), paths.kind(p).alias("kind"),
        paths.is_supported(p).alias("supported"), paths.is_searchable(p, "raw").alias("raw"),
    )


_UNSAFE = ("", "/", "../", "a/../", "C:", "..\\\\", "a..b/")


@query(
    """WITH v AS (SELECT n_name, unnest(['', '/', '../', 'a/../', 'C:', '..\\', 'a..b/']) || n_name || '/x' AS path FROM nation)
SELECT path, starts_with(replace(path, '\\', '/'), '/') OR regexp_matches(path, '^[A-Za-z]:') OR regexp_matches(replace(path, '\\', '/'), '(^|/)\\.\\.(/|$)') AS unsafe,
regexp_replace(replace(path, '\\', '/'), '^/+', '') AS posix FROM v"""
)
def unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that lead out, and their plain form."""
    starts = F.explode(F.array(*(F.lit(s) for s in ("", "/", "../", "a/../", "C:", "..\\", "a..b/"))))
    rows = table(spark, sf_dir, "nation").select("n_name", starts.alias("s")).select(F.concat("s", "n_name", F.lit("/x")).alias("path"))
    return rows.select("path", paths.is_unsafe_entry(F.col("path")).alias("unsafe"), paths.posix(F.col("path")).alias("posix"))


@query(
    """WITH v AS (SELECT url FROM pages UNION ALL SELECT unnest(['ftp://', 'HTTP://', 'https://u:p@', 'http:///', 'mailto:', '']) || lower(n_name) || '.org/a' FROM nation UNION ALL SELECT 'https://x.org/' || n_name || ' y' FROM nation)
SELECT url, coalesce(regexp_matches(url, '(?i)^https?://[^/?#@\\s]+([/?#]|$)') AND NOT regexp_matches(url, '[\\x00-\\x20\\x7f]'), false) AS ok FROM v"""
)
def web_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which urls may be cited."""
    nation = table(spark, sf_dir, "nation")
    starts = F.explode(F.array(*(F.lit(s) for s in ("ftp://", "HTTP://", "https://u:p@", "http:///", "mailto:", ""))))
    odd = nation.select(starts.alias("s"), F.lower("n_name").alias("n")).select(F.concat("s", "n", F.lit(".org/a")).alias("url"))
    every = table(spark, sf_dir, "pages").select("url").unionByName(odd).unionByName(nation.select(F.concat(F.lit("https://x.org/"), "n_name", F.lit(" y")).alias("url")))
    return every.select("url", paths.is_web_url(F.col("url")).alias("ok"))


@query("SELECT p_partkey, 'e-' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-fi' AS slug, lower(trim(p_name)) AS key, '10 kg ' || p_name AS folded FROM part")
def slugs_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names with accents, full-width letters, ligatures and units, brought to plain characters."""
    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    rows = table(spark, sf_dir, "part")
    return rows.select(
        "p_partkey",
        text.slug(F.concat(F.lit("É "), "p_name", F.lit(" ﬁ"))).alias("slug"),
        topics.topic_key(F.concat(F.lit(" "), wide, F.lit("　"))).alias("key"),
        text.nfkc(F.concat(F.lit("⑩ ㎏ "), "p_name")).alias("folded"),
    )


@query(
    """SELECT c_custkey, c_name AS title, 'entity' AS type, c_mktsegment || ',x' AS tags, c_name || chr(10) || chr(10) || 'In ' || c_mktsegment || '.' AS body FROM customer"""
)
def front_matter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with front matter, written and parsed."""
    # Short rows that cost much: dealt out, or a file of few row groups is the work of few tasks.
    rows = table(spark, sf_dir, "customer").repartition(4 * spark.sparkContext.defaultParallelism)
    front = F.concat(sinks.front_matter(title=F.col("c_name")), F.lit("tags:\n- "), "c_mktsegment", F.lit("\n- x\n"))
    page = markdown.serialize(front, F.concat("c_name", F.lit("\n\nIn "), "c_mktsegment", F.lit(".\n\n")))
    rows = rows.select("c_custkey", page.alias("page")).withColumn("front", markdown.front_matter_json("page"))
    body = markdown.body(F.col("page"), F.col("front"))
    return rows.select(
        "c_custkey", markdown.title(F.col("front"), body, F.lit("none")).alias("title"), paths.page_type(F.lit("entities/x.md")).alias("type"),
        F.array_join(markdown.front_list(F.col("front"), "tags"), ",").alias("tags"), text.trim(body).alias("body"),
    )


@query("SELECT p_partkey, p_name || '|' || p_brand AS wiki, 'a/' || p_partkey || '.md' AS local, 'See ' || p_name || ', X and here.' || chr(10) || 'Bold' AS plain FROM part")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M5, M6, M7: links outside code, and the text without marks."""
    links = F.concat(F.lit("[["), "p_name", F.lit("#h|x]] `[[no]]` [["), "p_brand", F.lit("]]\n```\n[[fenced]]\n[z](q.md)\n```\n[l](a/"), F.col("p_partkey").cast("string"), F.lit(".md) [w](https://x.y)"))
    links = F.regexp_replace(links, "Brand#", "Brand-")  # brands have a sign that begins a fragment
    marked = F.concat(F.lit("## See [["), "p_name", F.lit("]], [[y|X]] and [here](z).\n- **Bold**"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(F.transform(markdown.wiki_links(links), lambda x: F.regexp_replace(x, "^Brand-", "Brand#")), "|").alias("wiki"),
        F.array_join(markdown.markdown_links(links), "|").alias("local"),
        markdown.plain_text(marked).alias("plain"),
    )


@query("SELECT p_partkey, 'Head' || chr(10) || p_name || ' b c' AS extracted, '# Head' || chr(10) || chr(10) || p_name AS tidy, 'x' || chr(10) || '# ' || p_name || chr(10) || 'y' AS swapped, '<' || p_name || '> A' AS entities FROM part")
def extracted_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extracted document's plain text and tidy form, another heading, entities."""
    doc = F.concat(F.lit("# Head\n![p](x)"), "p_name", F.lit(" *b* [c](d)"))
    loose = F.concat(F.lit("\r\n# Head\r\n\n\n\n"), "p_name", F.lit("\n"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.regexp_replace(markdown.extracted_plain_text(doc), "\\n ", "\n").alias("extracted"),
        markdown.normalize_markdown(loose).alias("tidy"),
        markdown.replace_top_heading(F.lit("x\n# old\ny"), F.col("p_name")).alias("swapped"),
        markdown.decode_entities(F.concat(F.lit("&lt;"), "p_name", F.lit("&gt; &#65;"))).alias("entities"),
    )


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') THEN '' ELSE substr(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(
regexp_replace(text, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 1200) END AS snippet FROM documents"""
)
def snippet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as snippets of search results (their length is the feature's)."""
    return table(spark, sf_dir, "documents").select("doc_id", text.source_text(F.col("text"), 1200).alias("snippet"))


@query("SELECT p_partkey, length(regexp_replace(p_name, '[^e]', '', 'g'))::BIGINT + ((length(p_name) - length(replace(p_name, 'wid', ''))) // 3)::BIGINT AS terms, p_name AS bare FROM part")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of two terms; a leading byte-order mark goes."""
    return table(spark, sf_dir, "part").select("p_partkey", text.count_terms(F.col("p_name"), ["e", "wid"]).alias("terms"), text.strip_bom(F.concat(F.lit("﻿"), "p_name")).alias("bare"))


@query("SELECT c_custkey, 'Authorization: Bearer [已隐藏] for [已隐藏] in ' || c_mktsegment AS shown FROM customer")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens and secrets never show."""
    message = F.concat(F.lit("Authorization: Bearer "), F.replace(F.col("c_name"), F.lit(" "), F.lit("")), F.lit(" for s3cret in "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", text.diagnostic(message, ["s3cret"]).alias("shown"))


# ---------------------------------------------------------------- queue and registry
@query(f"WITH {QU} SELECT id, CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status FROM qu")
def queue_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was running is queued again."""
    from folioforge.streaming.ingest import recover

    return recover(shapes.queue(spark, sf_dir)).select("id", "status")


@query(f"WITH {QU} SELECT id FROM qu WHERE status = 'running'")
def newly_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that ran at the last look and are done now."""
    q = shapes.queue(spark, sf_dir)
    after = q.withColumn("status", F.when(F.col("status") == "running", "done").otherwise(F.col("status")))
    return activity.newly_done(q, after).select("id")


@query(f"""WITH {QU}, {REG} SELECT qu.id, qu.status, coalesce(reg."fileName", "sourceId" || '.md') AS "fileName", size FROM qu LEFT JOIN reg ON reg.id = qu."sourceId" """)
def queue_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue items with what the registry knows of their source."""
    return activity.with_source(shapes.queue(spark, sf_dir), shapes.registry(spark, sf_dir)).select("id", "status", "fileName", "size")


@query(f"""WITH {REG} SELECT id, status, error FROM reg""")
def compact_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without their summaries."""
    out = activity.compact(shapes.registry(spark, sf_dir))
    assert "summary" not in out.columns
    return out.select("id", "status", "error")


@query(f"""WITH {REG} SELECT id, coalesce(regexp_matches(summary, '无法识别|\\?{{3,}}') OR contains(summary, chr(65533)), false) OR coalesce(error, '') <> '' AS review FROM reg""")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that need a look."""
    c = F.col
    return shapes.registry(spark, sf_dir).select("id", display.needs_review(c("title"), c("summary"), c("error")).alias("review"))


@query(f"""WITH {REG} SELECT reg.id, CASE WHEN lang = 'en' THEN 'ready' ELSE status END AS status, CASE WHEN lang = 'en' THEN 'wiki/sources/' || reg.id || '.md' ELSE "wikiPath" END AS "wikiPath" FROM reg JOIN documents d ON d.doc_id = reg.ord""")
def ready_by_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that have a page made of exactly their bytes are ready."""
    reg = shapes.registry(spark, sf_dir)
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "lang")
    sha = F.when(F.col("lang") == "en", F.col("sha256")).otherwise(F.lit("other"))
    pages = reg.join(lang, "ord").select(F.col("id").alias("source_id"), F.col("relativePath").alias("source_path"), sha.alias("source_sha"), F.concat(F.lit("wiki/sources/"), "id", F.lit(".md")).alias("path"))
    return registry.ready_by_pages(reg, pages).select("id", "status", "wikiPath")


@query(
    f"""WITH {REG}, old AS (SELECT * FROM reg WHERE status <> 'queued') SELECT "relativePath", "fileName", kind, status, error FROM old
UNION ALL SELECT "relativePath", "fileName", 'markdown', 'failed', 'too large' FROM reg WHERE status = 'queued'"""
)
def failed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of files that have no record yet become records; the others change nothing."""
    reg = shapes.registry(spark, sf_dir)
    failures = reg.select("relativePath", F.lit("too large").alias("error"), "size")
    return registry.record_failures(reg.filter("status <> 'queued'"), failures, F.lit("2024-06-01 00:00:00").cast("timestamp")).select("relativePath", "fileName", "kind", "status", "error")


@query("""SELECT c_mktsegment AS topic, min(c_custkey) AS first FROM customer GROUP BY c_mktsegment HAVING c_mktsegment <> 'BUILDING'""")
def research_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal requests the first; none that an active task equals."""
    rows = table(spark, sf_dir, "customer")
    none = F.array().cast("array<string>")
    requests = rows.select(F.col("c_mktsegment").alias("topic"), none.alias("queries"), F.lit("m").alias("modelId"), F.col("c_custkey").alias("createdAt"))
    active = requests.filter("topic = 'BUILDING'").limit(1).select(F.lower("topic").alias("topic"), "queries", "modelId", F.lit("running").alias("status"))
    return tasks.submit(active, requests).select("topic", F.col("createdAt").alias("first"))


@query("""WITH t AS (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status, ts FROM events) SELECT id, 'running' AS status FROM (SELECT * FROM t WHERE status = 'queued' ORDER BY ts, id LIMIT 2)""")
def research_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two tasks that run."""
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("queued")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("createdAt"))
    return tasks.admit(rows).select("id", "status")


@query(
    f"""WITH {WEB}, v AS (SELECT regexp_extract(url, '^https?://[^/?#]*?([a-z]+)(?:[/?#]|$)', 1) AS query, page_id, url, title, CASE WHEN contains(title, '%') THEN '' ELSE title END AS snippet FROM web JOIN pages USING (page_id) WHERE title <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY page_id) AS rank FROM v QUALIFY rank <= 3),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY snippet <> '' DESC, query, rank) = 1), l AS (SELECT *, row_number() OVER (ORDER BY query, rank) AS p FROM u ORDER BY query, rank LIMIT 12)
SELECT url AS path, title, (101 - p)::BIGINT AS score, CASE WHEN snippet <> '' THEN snippet ELSE url END AS excerpt FROM l"""
)
def external_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as results of a search for their top-level domain."""
    domain = F.regexp_extract("url", "^https?://[^/?#]*?([a-z]+)(?:[/?#]|$)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", "url", domain.alias("query"), markdown.html_title(F.col("html")).alias("title")).filter("title <> ''")
    place = F.row_number().over(Window.partitionBy("query").orderBy("page_id"))
    rows = rows.withColumn("rank", place).withColumn("snippet", F.when(F.col("title").contains("%"), "").otherwise(F.col("title")))
    from folioforge.operators.search import external_hits

    return external_hits(rows).select("path", "title", "score", "excerpt")


@query("SELECT r_name AS query, 1 AS rank, 'https://x.org/' || r_name AS url, r_name || ' & co' AS title, 'In ' || r_name AS snippet, p AS provider FROM region, (SELECT unnest(['searxng', 'serpapi', 'tavily']) AS p)")
def external_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of three services in one shape."""
    rows, parts = table(spark, sf_dir, "region"), []
    for name in ("searxng", "serpapi", "tavily"):
        root, url, title, snippet = external.PROVIDERS[name]
        one = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("https://x.org/"), "r_name").alias(url), F.concat("r_name", F.lit(" &amp; <b>co</b>")).alias(title), F.concat(F.lit("In "), "r_name").alias(snippet))).alias(root)))
        found = external.results(rows.select(F.col("r_name").alias("query"), F.lit(name).alias("provider"), one.alias("payload")))
        parts.append(found.withColumn("provider", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- pages of the collection, graph, projects
@query(
    """WITH p AS (SELECT 'wiki/notes/' || doc_id || '.md' AS path, 'T' || doc_id AS title, CASE lang WHEN 'en' THEN 'source' WHEN 'fr' THEN 'concept' ELSE 'note' END AS type, n_chars AS m, split_part(text, chr(10), 1) AS summary, doc_id AS ord FROM documents),
n AS (SELECT * FROM p WHERE type = 'source' ORDER BY m DESC, ord LIMIT 12)
SELECT '# 知识库总览' || chr(10) || chr(10) || '## 当前结构' || chr(10) || chr(10) || '- 来源页：' || (SELECT count(*) FROM p WHERE type = 'source') || chr(10) || '- 概念页：' || (SELECT count(*) FROM p WHERE type = 'concept')
|| chr(10) || chr(10) || '## 最近来源摘要' || chr(10) || chr(10) || (SELECT string_agg('- [[' || path || '|' || title || ']]: ' || substr(regexp_replace(summary, '\\s+', ' ', 'g'), 1, 180), chr(10) ORDER BY m DESC, ord) FROM n) AS body"""
)
def overview_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type and the newest sources' summaries."""
    kind = F.when(F.col("lang") == "en", "source").when(F.col("lang") == "fr", "concept").otherwise("note")
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("wiki/notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), kind.alias("type"),
        F.timestamp_seconds("n_chars").alias("mtime"), F.get(F.split("text", "\n"), F.lit(0)).alias("summary"), F.col("doc_id").alias("ord"),
    )
    return topics.overview(rows)


@query(
    """WITH p AS (SELECT '[[wiki/notes/' || doc_id || '.md|T' || doc_id || ']]' AS link, CASE lang WHEN 'en' THEN 'source' WHEN 'fr' THEN 'concept' ELSE 'note' END AS type, n_chars AS m, doc_id AS ord FROM documents)
SELECT '# 知识库索引' || chr(10) || chr(10) || '## 最近更新' || chr(10) || chr(10) || (SELECT string_agg('- ' || link || ' - ' || type, chr(10) ORDER BY m DESC, ord) FROM (SELECT * FROM p ORDER BY m DESC, ord LIMIT 20))
|| chr(10) || chr(10) || '## 概念' || chr(10) || chr(10) || (SELECT string_agg('- ' || link, chr(10) ORDER BY ord) FROM (SELECT * FROM p WHERE type = 'concept' ORDER BY ord LIMIT 25))
|| chr(10) || chr(10) || '## 来源' || chr(10) || chr(10) || (SELECT string_agg('- ' || link, chr(10) ORDER BY ord) FROM (SELECT * FROM p WHERE type = 'source' ORDER BY ord LIMIT 25)) AS body"""
)
def index_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the collection."""
    kind = F.when(F.col("lang") == "en", "source").when(F.col("lang") == "fr", "concept").otherwise("note")
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("wiki/notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), kind.alias("type"),
        F.timestamp_seconds("n_chars").alias("mtime"), F.col("doc_id").alias("ord"),
    )
    return topics.index_page(rows)


@query(
    """WITH w AS (SELECT doc_id, unnest(list_distinct(['Lang ' || lang, 'LANG ' || upper(lang)])) AS topic FROM documents), k AS (SELECT lower(topic) AS key, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM w GROUP BY 1)
SELECT 'concept' AS kind, key, n::BIGINT AS sources, CASE WHEN key IN ('lang en', 'lang fr') THEN 'wiki/concepts/old-' || right(key, 2) || '.md' ELSE 'wiki/concepts/' || replace(key, ' ', '-') || '-' || substr(sha256(key), 1, 6) || '.md' END AS page,
key NOT IN ('lang en', 'lang fr') AS created FROM k"""
)
def topic_page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics named in two ways are one; those that have a page keep it."""
    wide = F.translate(F.concat(F.lit("LANG "), F.upper("lang")), "LANG", "ＬＡＮＧ")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.lit("t").alias("title"), F.col("doc_id").alias("ord"), "text", F.array(F.concat(F.lit("Lang "), "lang"), wide).alias("topics")
    )
    noted = topics.notes(rows, "topics", "concept")
    existing = spark.createDataFrame([("concept", f"lang {x}", f"wiki/concepts/old-{x}.md") for x in ("en", "fr")], "kind string, key string, page string")
    found = topics.find_or_create(noted, existing, lambda c: text.slug(c)).select("kind", "key", "page", "created")
    many = topics.merge(noted.withColumn("evidence", F.array().cast("array<string>")), most=10**6).select("kind", "key", F.size("sources").cast("long").alias("sources"))
    return found.join(many, ["kind", "key"])


@query(f"""{GRAPH.replace('WITH ', 'WITH RECURSIVE ', 1)}, ad AS (SELECT source AS x, target AS y FROM ke UNION SELECT target, source FROM ke),
r AS (SELECT path AS x, place AS root FROM nd UNION SELECT ad.y, r.root FROM r JOIN ad ON ad.x = r.x), m AS (SELECT x AS path, min(root) AS root FROM r GROUP BY x),
c AS (SELECT (dense_rank() OVER (ORDER BY root) - 1)::INT AS community FROM m) SELECT community, count(*)::BIGINT AS n FROM c GROUP BY 1 ORDER BY n DESC, community LIMIT 8""")
def largest_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight largest communities of the graph."""
    pages = _linked_pages(spark, sf_dir).withColumn("mtime", F.timestamp_seconds(F.col("ord")))
    return graph.community_sizes(graph.build(pages)[0])


@query(f"""{GRAPH}, sh AS (SELECT path FROM nd WHERE contains(title, 'th') OR contains(path, 'th') OR contains('concept', 'th')) SELECT source, target FROM ke WHERE source IN (SELECT path FROM sh) AND target IN (SELECT path FROM sh)""")
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the nodes that a reader's filter leaves."""
    pages = _linked_pages(spark, sf_dir).withColumn("mtime", F.timestamp_seconds(F.col("ord")))
    nodes, edges, _ = graph.build(pages)
    return graph.visible(nodes, edges, "th")[1].select("source", "target")


@query(
    """WITH c AS (SELECT page_id AS id, 'T' || page_id AS title, 'source' AS type, NULL AS s, 'x' || (page_id % 3) AS src FROM pages)
SELECT 'wiki/s/' || page_id AS source, 'wiki/x/' || page_id AS target, 4::BIGINT AS weight FROM pages ORDER BY page_id LIMIT 3500"""
)
def converted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source page with the page of its full text."""
    base = table(spark, sf_dir, "pages").select("page_id")
    ident = F.col("page_id").cast("string")
    src = base.select(F.concat(F.lit("wiki/s/"), ident).alias("path"), F.lit("source").alias("type"), F.col("page_id").alias("ord"), F.array(F.concat(F.lit("none/"), ident), F.concat(F.lit("raw/"), ident)).alias("sources"))
    full = base.select(F.concat(F.lit("wiki/x/"), ident).alias("path"), F.lit("source_extract").alias("type"), F.col("page_id").alias("ord"), F.array(F.concat(F.lit("raw/"), ident)).alias("sources"))
    return graph.extract_edges(src.unionByName(full)).select("source", "target", "weight")


@query("SELECT 'region-' || r_regionkey || '' AS id, r_name AS name FROM region UNION ALL SELECT 'region-0-2', 'Region 0'")
def project_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project whose name's slug is taken gets a number."""
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    rows = table(spark, sf_dir, "region").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("").alias("description"), now.alias("createdAt"), now.alias("updatedAt"))
    return projects.public(projects.listed(projects.create(rows, "Region 0", "", now), "/data")).select("id", "name")


@query("SELECT n_nationkey AS id, 'wiki/' || n_name || '.md' AS path, CASE WHEN n_regionkey = 0 THEN 1 ELSE 2 END AS created FROM nation")
def kept_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written anew keep the time of their creation."""
    rows = table(spark, sf_dir, "nation")
    pages = rows.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("wiki/"), "n_name", F.lit(".md")).alias("path"))
    before = pages.join(rows.filter("n_regionkey = 0").select(F.col("n_nationkey").alias("id")), "id", "left_semi").withColumn("created", F.lit(1))
    return sinks.keep_created(pages, before, F.lit(2))


# ---------------------------------------------------------------- pages, sessions and records in their formats
_NOW = "2024-06-01"


def _sql_front(**values: str) -> str:
    return " || ".join(f"'{k}: \"' || {v} || '\"' || chr(10)" for k, v in values.items())


@query(
    f"""SELECT n_nationkey, '---' || chr(10) || {_sql_front(title="n_name", type="'source'", source_path="'raw/sources/' || n_name", source_kind="'text'", updated=_quote(_NOW))} || '---' || chr(10)
|| '# ' || n_name || chr(10) || chr(10) || '来源文件：`raw/sources/' || n_name || '`' || chr(10) || chr(10) || '## 摘要' || chr(10) || chr(10) || 'About ' || n_name || chr(10) || chr(10)
|| '## 关键要点' || chr(10) || chr(10) || '- a' || chr(10) || '- ' || n_name || chr(10) || chr(10) || '## 待确认问题' || chr(10) || chr(10) || '_暂无_' || chr(10) || chr(10) || '## 摘录' || chr(10) || chr(10) || '> x' || chr(10) || '> y' || chr(10) AS page,
'---' || chr(10) || {_sql_front(title="n_name || ' - 全文'", type="'source_extract'", source_path="'raw/sources/' || n_name", updated=_quote(_NOW))} || '---' || chr(10) || '# ' || n_name || chr(10) || chr(10) || '来源路径：`raw/sources/' || n_name || '`'
|| chr(10) || chr(10) || '## 转换正文' || chr(10) || chr(10) || 'text' || chr(10) AS converted,
'---' || chr(10) || {_sql_front(title="n_name", type="'query'", updated=_quote(_NOW))} || '---' || chr(10) || '# ' || replace(n_name, '_', chr(92) || '_') || chr(10) || chr(10) || 'yes' || chr(10) || chr(10) || '## 引用' || chr(10) || chr(10) || '- [[a.md|a.md]]' || chr(10) AS saved FROM nation"""
)
def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a source, its full text and a saved answer."""
    name, now = F.col("n_name"), F.lit(_NOW)
    path, none = F.concat(F.lit("raw/sources/"), name), F.array().cast("array<string>")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        sinks.source_page(path, name, F.lit("text"), F.concat(F.lit("About "), name), F.array(F.lit("a"), name), none, F.lit("x\ny"), now).alias("page"),
        sinks.converted_page(path, name, F.lit("text"), now).alias("converted"),
        sinks.query_page(name, F.lit("yes"), F.array(F.lit("a.md")), now).alias("saved"),
    )


@query(
    """SELECT 'wiki/concepts/' || n_name || '.md' AS path, n_name AS title, 'concept' AS type, 't' AS tags, 'raw/x,raw/' || n_nationkey AS sources, 'Other|' || n_name AS links, 'H ' || n_name || '=raw/' || n_nationkey AS notes FROM nation"""
)
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's head says, and the notes in it."""
    key = F.col("n_nationkey").cast("string")
    body = F.concat(
        F.lit("---\ntitle: "), "n_name", F.lit("\ntags: [t]\nsources: raw/x\n---\n# X\n\nSee [[Other]] and [["), "n_name", F.lit("|it]].\n\n### H "), "n_name",
        F.lit("\n\n来源：[[Other]]\n来源路径：`raw/"), key, F.lit("`\n\nsome text\n"),
    )
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("concepts/"), "n_name", F.lit(".md")).alias("relativePath"), body.alias("text"), F.encode(body, "UTF-8").alias("content"), F.lit(1).alias("size"), F.lit(None).cast("timestamp").alias("mtime")
    )
    notes = markdown.source_notes(F.col("text"))
    shown = F.array_join(F.transform(notes, lambda n: F.concat(n["heading"], F.lit("="), n["path"])), "|")
    meta = files.page_metadata(rows).select("path", "title", "type", F.array_join("tags", ",").alias("tags"), F.array_join("sources", ",").alias("sources"), F.array_join("links", "|").alias("links"))
    return meta.join(rows.select(F.concat(F.lit("wiki/"), "relativePath").alias("path"), shown.alias("notes")), "path")


@query("SELECT r_name AS conv_id, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1)::BIGINT AS turn, 'user' AS role, n_name AS text FROM nation JOIN region ON r_regionkey = n_regionkey")
def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions read from their JSON, a message a row."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda m: F.struct(F.lit("user").alias("role"), m["n_name"].alias("content")))
    sessions = rows.groupBy(F.col("r_name").alias("id")).agg(said.alias("messages")).withColumn("updatedAt", F.lit("2024-01-01T00:00:00Z"))
    root = _folder(spark, "chats")
    sessions.agg(F.to_json(F.collect_list(F.struct("id", "updatedAt", "messages"))).alias("value")).coalesce(1).write.text(root)  # five sessions
    return files.messages(files.chats(spark, root)).select("conv_id", "turn", "role", "text")


@query("SELECT n_name AS id, 'raw/' || n_name AS \"relativePath\", 'ready' AS status, n_nationkey::BIGINT AS size, 'q' || n_name AS queued, 't' || n_name AS topic, 2 AS steps FROM nation")
def state_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry, queue and research tasks read from their JSON."""
    rows, name = table(spark, sf_dir, "nation"), F.col("n_name")

    def written(kind: str, *columns):
        root = _folder(spark, kind)
        rows.agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value")).coalesce(1).write.text(root)  # 25 records
        return root

    reg = files.registry(spark, written("registry", name.alias("id"), F.concat(F.lit("raw/"), name).alias("relativePath"), F.lit("ready").alias("status"), F.col("n_nationkey").alias("size")))
    todo = files.queue(spark, written("queue", F.concat(F.lit("q"), name).alias("id"), name.alias("sourceId")))
    step = F.struct(F.lit("s").alias("id"), F.lit("done").alias("status"))
    work = files.research_tasks(spark, written("research", name.alias("id"), F.concat(F.lit("t"), name).alias("topic"), F.array(step, step).alias("steps")))
    out = reg.select("id", "relativePath", "status", "size").join(todo.select(F.col("sourceId").alias("id"), F.col("id").alias("queued")), "id")
    return out.join(work.select("id", "topic", F.size("steps").alias("steps")), "id")


@query(
    """SELECT p_partkey, p_name || '|More' AS headings, 'It is described here, in full length.' AS paragraph, p_name AS derived, p_name AS cleaned, p_name AS of_text, 'see ' || p_name || ' for more' AS signal,
'# ' || p_name || chr(10) || chr(10) || 'a b' AS page, 'x1,' || p_name AS items FROM part"""
)
def titles_and_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a short document says of itself."""
    name = F.col("p_name")
    doc = F.concat(F.lit("# "), name, F.lit("\n\nIt is described here, in full length.\n\n## More\n\nIt goes on, for a while."))
    noisy = F.concat(F.lit("see https://x.org/a?b "), name, F.lit(" deadbeefdeadbeef0123 www for more"))
    # Short rows that cost much: dealt out, or a file of few row groups is the work of few tasks.
    rows = table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.select(
        "p_partkey",
        F.array_join(text.headings(doc), "|").alias("headings"),
        text.first_paragraph(doc).alias("paragraph"),
        text.derive_title(doc, F.lit("none")).alias("derived"),
        text.clean_title(F.concat(F.lit("## *"), name, F.lit("*"))).alias("cleaned"),
        markdown.title_from_text(F.concat(F.lit("目录\n\n> "), name, F.lit(" \nurl: x")), F.lit("none")).alias("of_text"),
        text.squeeze(text.strip_low_signal(noisy)).alias("signal"),
        markdown.text_to_markdown(F.lit("a  b\n\n"), name).alias("page"),
        F.array_join(text.clean_list(F.array(F.lit("x1"), F.lit("???"), F.lit("y"), name, F.concat(F.lit(" "), name)), 5), ",").alias("items"),
    )


@query("SELECT p_partkey, '![a](docs/' || p_partkey || '/media/i.png) ![b](http://x/media/i.png)' AS media, p_size AS of_reply, printf('%d.0 KB', p_size) AS size, p_size || ' B' AS small, 27 AS col, p_name AS shown FROM part")
def small_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media links, JSON in a reply, sizes, cell references, titles for display."""
    key = F.col("p_partkey").cast("string")
    reply = F.concat(F.lit("Sure:\n```json\n{\"size\": "), F.col("p_size").cast("string"), F.lit("}\n```"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        display.rewrite_media(F.lit("![a](./media/i.png) ![b](http://x/media/i.png)"), F.concat(F.lit("docs/"), key)).alias("media"),
        markdown.first_json_object(reply, "size int")["size"].alias("of_reply"),
        display.format_bytes(F.col("p_size").cast("long") * 1024).alias("size"),
        display.format_bytes(F.col("p_size")).alias("small"),
        markdown.column_index(F.lit("AB12")).alias("col"),
        markdown.display_title(F.col("p_name"), F.lit("note"), F.lit(""), F.lit("other")).alias("shown"),
    )


@query("SELECT n_name, '中华人民共和国规定' || n_name AS legacy, n_name || '/中.txt' AS entry, length(n_name) <= 8 AS kept FROM nation")
def legacy_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of an old codec and names that archives mangled or that are too long."""
    old = F.unhex(F.lit("中华人民共和国规定".encode("gb18030").hex()))
    mangled = F.concat("n_name", F.lit("/#U4e2d.txt"))
    long = codecs.entry_name(F.concat("n_name", F.repeat(F.lit("é"), 200), F.lit(".md")))
    return table(spark, sf_dir, "nation").select(
        "n_name", codecs.decode_text(F.concat(old, F.encode("n_name", "UTF-8"))).alias("legacy"), codecs.entry_name(mangled).alias("entry"),
        ((F.octet_length(long) <= 180) & long.endswith(".md") & (F.length("n_name") <= 8)).alias("kept"),
    )


@query("SELECT 'note ' || n_name AS title, 'ready' AS status, 'note ' || n_name AS analysed FROM nation")
def ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found by a stream, extracted, analysed and written; a second run finds nothing new."""
    from folioforge.streaming.ingest import run_once

    rows = table(spark, sf_dir, "nation")
    packed = rows.select(F.concat(F.lit("note "), "n_name", F.lit(".md")).alias("name"), F.concat(F.lit("Here "), "n_name", F.lit(" is described in one long sentence.")).alias("value"))
    root, sink, state = _folder(spark, "incoming"), _folder(spark, "ingested"), _folder(spark, "state")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for r in packed.collect():  # 25 files, as an upload would leave them
        path = hadoop.Path(f"{root}/{r.name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(r.value.encode()))
        out.close()
    for _ in range(2):
        run_once(spark, root, sink, state).awaitTermination()
    return spark.read.parquet(sink).select("title", "status", F.col("analysis.title").alias("analysed"))


@query(
    f"""{GRAPH.replace('WITH ', 'WITH RECURSIVE ', 1)}, ad AS (SELECT source AS x, target AS y FROM ke UNION SELECT target, source FROM ke),
r AS (SELECT path AS x, place AS root FROM nd UNION SELECT ad.y, r.root FROM r JOIN ad ON ad.x = r.x), m AS (SELECT x AS path, min(root) AS root FROM r GROUP BY x),
c AS (SELECT path, place, (dense_rank() OVER (ORDER BY root) - 1)::INT AS community FROM m JOIN nd USING (path)),
b AS (SELECT community, count(*)::BIGINT AS n FROM c GROUP BY 1 ORDER BY n DESC, community LIMIT 1), g AS (SELECT path, place FROM nd WHERE path NOT IN (SELECT x FROM ad))
SELECT 'cluster' AS kind, n, community, (SELECT string_agg(path, '|' ORDER BY place) FROM (SELECT c.path, place FROM c WHERE c.community = b.community ORDER BY place LIMIT 8)) AS paths FROM b
UNION ALL SELECT 'gap', count(*)::BIGINT, NULL, (SELECT string_agg(path, '|' ORDER BY place) FROM (SELECT * FROM g ORDER BY place LIMIT 6)) FROM g HAVING count(*) > 0"""
)
def graph_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unconnected pages and the largest community."""
    pages = _linked_pages(spark, sf_dir).withColumn("mtime", F.timestamp_seconds(F.col("ord")))
    return graph.build(pages)[2].select("kind", "n", "community", F.array_join("paths", "|").alias("paths"))
