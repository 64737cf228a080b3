"""Sinks: atomic tables, pages as text files, append-only logs, index upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.markdown import blockquote, bullet_list, escape, wiki_link
from folioforge.functions.paths import is_unsafe_entry


#: The file that names a published table's current version; Spark's readers pass over names that begin so.
CURRENT = "_current"


def replace_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """K1-K3: publish ``df`` as the whole table ``path``, all or nothing; it may read what it replaces.

    The rows go to a new folder under Spark's commit protocol; then one small file that names the folder is put in place
    by a rename.  Until then, and if anything fails, readers (``read_table``) see the former version.  The version before the
    former one is deleted, so a reader that has begun can end.
    """
    spark = df.sparkSession
    before = current_version(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{name}")
    files, at = _files(spark, path)
    kept = {f"{path}/{name}", f"{path}/{before}"}
    folder = spark._jvm.org.apache.hadoop.fs.Path
    temporary, current = folder(f"{path}/_{name}"), folder(f"{path}/{CURRENT}")
    out = files.create(temporary, True)
    out.write(f"{name}".encode())
    out.close()
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(temporary, current, options)
    for status in files.listStatus(at):
        found = status.getPath().getName()
        if found.startswith("v-") and f"{path}/{found}" not in kept:
            files.delete(status.getPath(), True)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of a published table that readers see; None if nothing was published."""
    files, _ = _files(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame | None:
    """The current version of a table that ``replace_table`` published."""
    name = current_version(spark, path)
    if name is None:
        if missing_ok:
            return None
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{name}")


def append_log(spark: SparkSession, path: str, kind: str, text: str) -> None:
    """K10."""
    row = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(kind).alias("kind"), F.lit(text).alias("text"))
    row.write.mode("append").parquet(path)


def write_pages(pages: DataFrame, root: str, path: str = "path", body: str = "body") -> None:
    """Pages as text files, a folder for each path, for readers that want files.

    Pages that are there already and not among these stay as they are.  A path that is empty or leads out of the root
    is an error, and nothing is written.  Spark escapes a path into a folder's name and back, so no two paths share one.
    """
    bad = pages.filter(F.col(path).isNull() | (F.trim(path) == "") | is_unsafe_entry(F.col(path)))
    if not bad.isEmpty():
        raise ValueError(f"unsafe page path: {bad.first()[path]!r}")
    rows = pages.groupBy(F.col(path).alias("page")).agg(F.max_by(body, F.xxhash64(body)).alias("value"))  # one file a page
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page").text(root)


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, body) of the pages that ``write_pages`` wrote."""
    rows = spark.read.schema("value string, page string").text(root, wholetext=True)
    return rows.select(F.col("page").alias("path"), F.regexp_replace("value", "\\n\\z", "").alias("body"))


def keep_created(pages: DataFrame, before: DataFrame, now: Column) -> DataFrame:
    """Pages (path, ...) with ``created``: what an earlier version of the page has, else ``now``."""
    old = before.groupBy("path").agg(F.min("created").alias("_created"))
    return pages.drop("created").join(old, "path", "left").withColumn("created", F.coalesce("_created", now)).drop("_created")


def front_matter(**values: Column) -> Column:
    """YAML lines from columns: strings quoted, arrays as lists, null left out."""
    parts = []
    for key, c in values.items():
        quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x.cast("string"), "\\\\", "\\\\\\\\"), '"', '\\\\"'), F.lit('"'))
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"{key}: "), quoted(c), F.lit("\n"))).otherwise(F.lit("")))
    return F.concat(*parts)


def source_page(path: Column, title: Column, kind: Column, summary: Column, points: Column, questions: Column, excerpt: Column, now: Column) -> Column:
    """K5: the page of a source."""
    head = front_matter(title=title, type=F.lit("source"), source_path=path, source_kind=kind, updated=now)
    body = F.concat(
        F.lit("# "), title, F.lit("\n\n来源文件：`"), path, F.lit("`\n\n## 摘要\n\n"), summary, F.lit("\n\n## 关键要点\n\n"), bullet_list(points),
        F.lit("\n\n## 待确认问题\n\n"), bullet_list(questions), F.lit("\n\n## 摘录\n\n"), blockquote(excerpt), F.lit("\n"),
    )
    return F.concat(F.lit("---\n"), head, F.lit("---\n"), body)


def converted_page(path: Column, title: Column, text: Column, now: Column) -> Column:
    """K6: the full text of a source as a page."""
    head = front_matter(title=F.concat(title, F.lit(" - 全文")), type=F.lit("source_extract"), source_path=path, updated=now)
    return F.concat(F.lit("---\n"), head, F.lit("---\n# "), title, F.lit("\n\n来源路径：`"), path, F.lit("`\n\n## 转换正文\n\n"), text, F.lit("\n"))


def query_page(question: Column, answer: Column, citations: Column, now: Column) -> Column:
    """A saved answer with its sources."""
    head = front_matter(title=question, type=F.lit("query"), updated=now)
    cited = bullet_list(F.transform(citations, lambda c: wiki_link(c, c)))
    return F.concat(F.lit("---\n"), head, F.lit("---\n# "), escape(question), F.lit("\n\n"), answer, F.lit("\n\n## 引用\n\n"), cited, F.lit("\n"))


def sync_index(index_path: str, documents: DataFrame) -> None:
    """An index table brought to ``documents`` (id, signature, ...); unchanged rows are carried over."""
    from folioforge.operators.registry import upsert_index

    spark = documents.sparkSession
    old = read_table(spark, index_path)
    replace_table(upsert_index(old, documents), index_path)
