"""File sources: directories, text, registries, office documents, archives, web clips.

Every reader is a Spark scan; byte formats are parsed in ``mapInPandas`` on the executors, a file at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions import markdown, paths
from folioforge.functions.codecs import decode_bytes, decode_text, repair_name, safe_name
from folioforge.functions.text import normalize

#: Archive guards: entries, bytes of an entry, bytes in all.
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 100_000, 256 << 20, 10 << 30
HEAD_BYTES = 262_144

REGISTRY = "id string, fileName string, relativePath string, kind string, size long, sha256 string, title string, summary string, wikiPath string, convertedPath string, importedAt timestamp, updatedAt timestamp, status string, error string"
QUEUE = "id string, sourceId string, relativePath string, status string, createdAt timestamp, updatedAt timestamp, error string"
CHATS = "id string, title string, createdAt timestamp, updatedAt timestamp, messages array<struct<role:string,content:string,createdAt:timestamp,citations:array<string>>>"
RESEARCH = "id string, topic string, status string, createdAt timestamp, updatedAt timestamp, queries array<string>, steps array<struct<id:string,status:string,detail:string,progress:int>>, result struct<path:string,summary:string>"


def files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """All files below ``root`` with relative path, size, time and bytes; bytes are read only if used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
    base = re.sub("^[a-z]+:/+", "/", root.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), f"^{re.escape(base)}/", "")
    rows = reader.load(root).withColumn("relativePath", relative)
    hidden = F.col("relativePath").rlike("(^|/)(node_modules|\\.git)/")
    return rows.filter(~hidden).select("relativePath", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def texts(spark: SparkSession, root: str, *extensions: str) -> DataFrame:
    """Text files whole, decoded from whatever codec they are in; structured formats stay text."""
    return files(spark, root, extensions).withColumn("text", decode_text("content")).drop("content")


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: a JSON array or object, with or without a byte-order mark; an empty file has no rows."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\ufeff", "").alias("v")).filter(F.trim("v") != "")
    one = F.when(F.ltrim("v").startswith("["), F.col("v")).otherwise(F.concat(F.lit("["), F.col("v"), F.lit("]")))
    return whole.select(F.explode(F.from_json(one, f"array<struct<{schema_fields(schema)}>>")).alias("r")).select("r.*")


def schema_fields(schema: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return json_table(spark, path, REGISTRY)


def queue(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return json_table(spark, path, QUEUE)


def chats(spark: SparkSession, path: str) -> DataFrame:
    """Sessions, newest first."""
    return json_table(spark, path, CHATS).orderBy(F.desc("updatedAt"))


def research_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks, newest first."""
    return json_table(spark, path, RESEARCH).orderBy(F.desc("createdAt"))


def messages(sessions: DataFrame) -> DataFrame:
    """The messages of nested sessions as rows."""
    each = sessions.select(F.col("id").alias("conv_id"), F.posexplode("messages").alias("turn", "m"))
    return each.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.col("m.content").alias("text"), "m.citations")


def page_metadata(pages: DataFrame, head: int = HEAD_BYTES) -> DataFrame:
    """(path, title, type, tags, sources, links, size, mtime) of Markdown files, from their head."""
    text = F.decode(F.substring("content", 1, head), "utf-8")
    rows = pages.withColumn("_t", text).withColumn("_f", markdown.front_matter_json("_t"))
    rows = rows.withColumn("_b", markdown.body(F.col("_t"), F.col("_f")))
    kind = F.coalesce(markdown.front_string(F.col("_f"), "type"), paths.page_type(F.col("relativePath")))
    sources = F.array_distinct(F.concat(markdown.front_list(F.col("_f"), "sources"), markdown.inline_source_paths(F.col("_t"))))
    return rows.select(
        F.concat(F.lit("wiki/"), F.col("relativePath")).alias("path"),
        markdown.title(F.col("_f"), F.col("_b"), paths.stem(F.col("relativePath"))).alias("title"),
        kind.alias("type"),
        markdown.front_list(F.col("_f"), "tags").alias("tags"),
        sources.alias("sources"),
        markdown.wiki_links(F.col("_b")).alias("links"),
        "size",
        "mtime",
    )


# ---------------------------------------------------------------- office documents
def _tag(node) -> str:
    return node.tag.rpartition("}")[2]


def _text_of(node, tags: tuple[str, ...] = ("t",)) -> str:
    out = []
    for n in node.iter():
        name = _tag(n)
        if name in tags:
            out.append(n.text or "")
        elif name in ("tab",):
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def _table(rows: list[list[str]]) -> str:
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def docx_markdown(data: bytes) -> str:
    """Paragraphs, headings and tables of a Word document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = next((n for n in root.iter() if _tag(n) == "body"), root)
    out = []
    for node in body:
        if _tag(node) == "p":
            style = next((v for n in node.iter() if _tag(n) == "pStyle" for k, v in n.attrib.items() if k.endswith("val")), "")
            level = re.search(r"(?i)heading\s*(\d)", style)
            text = _text_of(node).strip()
            if text:
                out.append(f"{'#' * min(6, int(level[1]))} {text}" if level else text)
        elif _tag(node) == "tbl":
            rows = [[_text_of(c).strip().replace("\n", " ") for c in r if _tag(c) == "tc"] for r in node.iter() if _tag(r) == "tr"]
            out.append(_table(rows))
    return "\n\n".join(x for x in out if x)


def pptx_markdown(data: bytes) -> str:
    """The slides' texts in order."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            root = ElementTree.fromstring(z.read(name))
            lines = [t for p in root.iter() if _tag(p) == "p" and (t := _text_of(p).strip())]
            out.append(f"## 第 {number} 页\n\n" + "\n\n".join(lines))
    return "\n\n".join(out)


def column_number(reference: str) -> int:
    """Zero-based column of a cell reference."""
    out = 0
    for c in re.match("[A-Za-z]*", reference)[0].upper():
        out = out * 26 + ord(c) - 64
    return out - 1


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet in workbook order; sparse cells keep their column."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_text_of(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(n) == "si"]
        links = {}
        if "xl/_rels/workbook.xml.rels" in names:
            links = {n.get("Id"): n.get("Target", "") for n in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in (n for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(n) == "sheet"):
            ref = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), "")
            target = links.get(ref, "").lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            if part not in names:
                continue
            rows = []
            for r in (n for n in ElementTree.fromstring(z.read(part)).iter() if _tag(n) == "row"):
                cells: list[str] = []
                for c in (n for n in r if _tag(n) == "c"):
                    at = column_number(c.get("r", "")) if c.get("r") else len(cells)
                    value = next((n.text or "" for n in c if _tag(n) == "v"), "")
                    if c.get("t") == "s":
                        value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                    elif c.get("t") == "inlineStr":
                        value = _text_of(c)
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = " ".join(value.split())
                rows.append(cells)
            out.append((sheet.get("name", ""), rows))
        return out


def xlsx_markdown(data: bytes) -> str:
    return "\n\n".join(f"## {name}\n\n{_table(rows)}".strip() for name, rows in xlsx_sheets(data))


_OFFICE = {".docx": docx_markdown, ".pptx": pptx_markdown, ".xlsx": xlsx_markdown}
_EXTRACTED = "relativePath string, size long, sha256 string, kind string, markdown string, metadata_only boolean, warning string"


def extract(rows: DataFrame) -> DataFrame:
    """Files (relativePath, size, content) as Markdown; what cannot be read is metadata only, with a warning."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, data in zip(pdf["relativePath"], pdf["content"], strict=True):
                ext, data, text, warning = "." + path.rpartition(".")[2].lower(), bytes(data), None, None
                try:
                    if ext in _OFFICE:
                        text = _OFFICE[ext](data)
                    elif ext in paths.RAW_TEXT:
                        text = decode_bytes(data)
                    else:
                        warning = "no text extractor"
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
                    warning = f"{type(e).__name__}: {e}"
                out.append((text, text is None, warning))
            yield pd.DataFrame(out, columns=["markdown", "metadata_only", "warning"]).assign(relativePath=pdf["relativePath"].values, size=pdf["size"].values, sha256=pdf["sha256"].values, kind=pdf["kind"].values)[
                ["relativePath", "size", "sha256", "kind", "markdown", "metadata_only", "warning"]
            ]

    keyed = rows.select("relativePath", "size", F.sha2("content", 256).alias("sha256"), paths.kind(F.col("relativePath")).alias("kind"), "content")
    done = keyed.mapInPandas(run, _EXTRACTED)
    html = paths.extension(F.col("relativePath")).isin(".html", ".htm", ".xml")
    return done.withColumn("markdown", F.when(html, markdown.html_to_text(F.col("markdown"))).otherwise(normalize(F.col("markdown"))))


def pdf_pages(texts_: DataFrame, text: str = "text") -> DataFrame:
    """Pages of layout text, split at form feeds (the text itself comes from outside)."""
    parts = F.filter(F.split(text, "\\f"), lambda x: F.trim(x) != "")
    return texts_.select(*[c for c in texts_.columns if c != text], F.posexplode(parts).alias("page", "page_text"))


def media(archives: DataFrame, folder: str) -> DataFrame:
    """Z3: the pictures inside office documents: (archive, asset, size, path below ``folder``), in order of name; bytes stay where they are."""

    def run(batches):
        for pdf in batches:
            out = []
            for archive, data in zip(pdf["relativePath"], pdf["content"], strict=True):
                try:
                    entries = zipfile.ZipFile(io.BytesIO(bytes(data))).infolist()
                except zipfile.BadZipFile:
                    continue
                out += [(archive, e.filename, e.file_size) for e in sorted(entries, key=lambda e: e.filename) if re.match("(word|ppt|xl)/media/[^/]+$", e.filename)]
            yield pd.DataFrame(out, columns=["archive", "asset", "size"])

    found = archives.select("relativePath", "content").mapInPandas(run, "archive string, asset string, size long")
    return found.withColumn("path", F.concat(F.lit(f"{folder.rstrip('/')}/"), F.sha2("archive", 256).substr(1, 12), F.lit("/"), F.regexp_extract("asset", "([^/]*)$", 1)))


# ---------------------------------------------------------------- archives, clips, uploads
def entries_of(infos, max_entries: int = MAX_ENTRIES, max_entry: int = MAX_ENTRY, max_total: int = MAX_TOTAL):
    """(entry of the directory, safe name, why it is left out or None) in the directory's order."""
    seen: dict[str, int] = {}
    total = 0
    for i, info in enumerate(x for x in infos if not x.is_dir()):
        name = info.filename if info.flag_bits & 0x800 else repair_name(info.filename)
        plain = name.replace("\\", "/")
        reason = None
        if plain.startswith("/") or re.match("[A-Za-z]:", plain) or ".." in plain.split("/"):
            reason = "unsafe path"
        elif "." + plain.rpartition(".")[2].lower() not in paths.SUPPORTED:
            reason = "unsupported"
        elif i >= max_entries or info.file_size > max_entry or total + info.file_size > max_total:
            reason = "over the limit"
        entry = "/".join(safe_name(repair_name(p)) for p in plain.split("/") if p not in ("", "."))
        if reason is None:
            n = seen[entry.lower()] = seen.get(entry.lower(), 0) + 1
            if n > 1:
                stem, dot, ext = entry.rpartition(".")
                entry = f"{stem}-{n}{dot}{ext}"
            total += info.file_size
        yield info, entry, reason


def unzip(archives: DataFrame, max_entries: int = MAX_ENTRIES, max_entry: int = MAX_ENTRY, max_total: int = MAX_TOTAL) -> DataFrame:
    """Entries of archives (relativePath, content): repaired safe names, told apart within an archive.

    Unsafe paths, unsupported kinds and what exceeds a guard are rows with a reason and no content.
    """

    def run(batches):
        for pdf in batches:
            for archive, data in zip(pdf["relativePath"], pdf["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(bytes(data)))
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(archive, "", 0, None, "not an archive")], columns=["archive", "entry", "size", "content", "skipped"])
                    continue
                for info, entry, reason in entries_of(z.infolist(), max_entries, max_entry, max_total):
                    content = z.read(info) if reason is None else None
                    yield pd.DataFrame([(archive, entry, info.file_size, content, reason)], columns=["archive", "entry", "size", "content", "skipped"])

    return archives.select("relativePath", "content").mapInPandas(run, "archive string, entry string, size long, content binary, skipped string")


def web_clips(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as sources with title, url and text."""
    return pages.select(
        F.col("page_id").cast("string").alias("id"),
        markdown.html_title(F.col("html")).alias("title"),
        F.col("url"),
        F.concat(F.lit("URL: "), F.col("url"), F.lit("\n\n"), markdown.html_to_text(F.col("html"))).alias("text"),
    )


def assemble_uploads(chunks: DataFrame) -> DataFrame:
    """Whole files from chunks (upload_id, idx, offset, size, data, sha256), checked; repeated chunks count once.

    An upload's bytes meet in one row, bounded by the upload limit of the service that took them.
    """
    from folioforge.operators.listing import chunks_in_order

    one = chunks.dropDuplicates(["upload_id", "idx"])
    state = chunks_in_order(one).filter("complete")
    # Hexadecimal text keeps the order-and-join inside native functions.
    joined = one.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.hex("data").alias("x")))).alias("p"), F.max("sha256").alias("sha256"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: x["x"]), ""))
    whole = joined.select("upload_id", data.alias("content"), "sha256").join(state.select("upload_id", "chunks", "size"), "upload_id")
    return whole.withColumn("valid", F.sha2("content", 256) == F.col("sha256"))
