"""The driver's tables in the shapes of a knowledge base: pages, registry, queue, versions, web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import markdown


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: the first line, 80 characters of it, is the title."""
    title = F.trim(F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 80))
    path = F.concat(F.lit("wiki/notes/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(
        path.alias("path"), title.alias("title"), F.lit("note").alias("type"), F.col("text").alias("body"), F.col("doc_id").alias("ord"), "source"
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as registry records: labelled good ones are ready, bad ones failed, others queued; the first line is the summary."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    status = F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").otherwise("queued")
    page = F.concat(F.lit("wiki/notes/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        name.alias("fileName"),
        F.concat(F.lit("raw/sources/"), F.col("source"), F.lit("/"), name).alias("relativePath"),
        F.lit("markdown").alias("kind"),
        F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("sha256"),
        F.lit(None).cast("string").alias("title"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("summary"),
        F.when(status == "ready", page).alias("wikiPath"),
        F.when(F.col("doc_id") % 3 == 0, page).alias("convertedPath"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("importedAt"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 977 as int))").alias("updatedAt"),
        status.alias("status"),
        F.when(status == "failed", "parse error").alias("error"),
        F.col("doc_id").alias("ord"),
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queue items."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "done").when(kind == "signup", "running").otherwise("queued")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("sourceId"),
        F.concat(F.lit("raw/sources/"), F.col("user_id").cast("string"), F.lit(".md")).alias("relativePath"),
        status.alias("status"),
        F.col("ts").alias("createdAt"),
        F.col("ts").alias("updatedAt"),
        F.col("event_id").alias("ord"),
    )


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the title and links of their html."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id"),
        F.concat(F.lit("wiki/web/"), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".md")).alias("path"),
        markdown.html_title(F.col("html")).alias("title"),
        F.lit("source").alias("type"),
        markdown.html_links(F.col("html")).alias("links"),
        F.col("page_id").alias("ord"),
    )
