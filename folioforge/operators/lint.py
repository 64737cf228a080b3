"""The integrity audit: fourteen checks as anti joins and aggregates.

Pages: (path, title, type, content, body, sources, links, source_path, ord); registry: (relativePath, status,
error, wikiPath, convertedPath, ord); files: (path) of everything that exists besides pages and registry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.paths import is_external
from folioforge.operators.graph import alias_map, resolve_links

MAX_PAGES = 2500
MAX_ISSUES = 1000
#: Page types that need no sources and are never orphans.
FREE_TYPES = ("index", "log", "synthesis")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def issue(rows: DataFrame, order: int, severity: str, check: str, detail: Column | str = "", path: str = "path") -> DataFrame:
    """Issues with a deterministic id; ``order`` keeps the checks' order among equals."""
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return rows.select(
        F.lit(severity).alias("severity"),
        F.regexp_replace(path, "\\\\", "/").alias("path"),
        F.lit(check).alias("check"),
        F.coalesce(detail, F.lit("")).alias("detail"),
        F.lit(order).alias("_order"),
        F.col("ord").cast("long").alias("_ord"),
    ).withColumn("id", F.sha2(F.concat_ws("\x1f", "severity", "path", "check", "detail"), 256))


def orphans(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pages that no link names; a page's link to itself counts."""
    named = resolved.filter("target IS NOT NULL").select(F.col("target").alias("path"))
    return pages.filter(~F.col("type").isin(*FREE_TYPES, "source", "source_extract")).join(named, "path", "left_anti")


def incoming(resolved: DataFrame) -> DataFrame:
    """Links to each page, its own included."""
    return resolved.filter("target IS NOT NULL").groupBy(F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("incoming"))


def broken_links(resolved: DataFrame) -> DataFrame:
    """J8."""
    return resolved.filter("target IS NULL").select(F.col("source").alias("path"), "link", "ord")


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Every page whose title, whatever its case, another page has."""
    key = F.lower("title")
    same = pages.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return pages.join(same, key == F.col("_key")).drop("_key")


def missing(references: DataFrame, key: str, *existing: DataFrame) -> DataFrame:
    """References of which none of ``existing`` (one column each) has the key."""
    known = reduce(DataFrame.union, existing).toDF("_k").distinct()
    return references.join(known, references[key] == F.col("_k"), "left_anti")


def lint(pages: DataFrame, registry: DataFrame, files: DataFrame, max_pages: int = MAX_PAGES, max_issues: int = MAX_ISSUES) -> DataFrame:
    """(id, severity, path, check, detail), errors first, at most ``max_issues``."""
    scanned = pages.orderBy("ord").limit(max_pages + 1)
    limited = scanned.count() > max_pages
    pages = scanned.orderBy("ord").limit(max_pages)
    resolved = resolve_links(pages, alias_map(pages))
    refs = pages.select("path", "ord", F.explode("sources").alias("ref")).filter(~is_external(F.col("ref")))
    page_paths, registry_paths, on_disk = pages.select("path"), registry.select("relativePath"), files.select("path")
    alive = registry.filter("status <> 'failed'")
    out = []
    if limited:
        one = pages.sparkSession.range(1).select(F.lit("wiki/index.md").alias("path"), F.lit(0).alias("ord"))
        out.append(issue(one, 0, "info", "scan_limited", str(max_pages)))
    out += [
        issue(pages.filter(~F.col("content").startswith("---")), 1, "warning", "no_front_matter"),
        issue(pages.filter(~F.col("body").rlike("(?m)^#\\s+.+$")), 2, "warning", "no_h1"),
        issue(pages.filter(~F.col("type").isin(*FREE_TYPES) & (F.size("sources") == 0)), 3, "info", "no_sources"),
        issue(missing(refs.filter(F.col("ref").startswith("raw/sources/")), "ref", registry_paths, on_disk), 4, "error", "source_file_missing", F.col("ref")),
        issue(missing(refs.filter(F.col("ref").startswith("wiki/")), "ref", page_paths, on_disk), 5, "error", "source_page_missing", F.col("ref")),
        issue(missing(pages.filter("type = 'source' AND source_path IS NOT NULL"), "source_path", registry_paths), 6, "error", "registry_record_missing", F.col("source_path")),
    ]
    if not limited:
        out.append(issue(broken_links(resolved), 7, "error", "broken_link", F.col("link")))
    out += [
        issue(orphans(pages, resolved), 8, "info", "orphan_page"),
        issue(duplicate_titles(pages), 9, "warning", "duplicate_title", F.concat_ws(" x", "title", F.col("n").cast("string"))),
        issue(registry.filter("status = 'failed'"), 10, "error", "source_failed", F.coalesce("error", F.lit("未知错误。")), "relativePath"),
        issue(missing(alive, "relativePath", on_disk), 11, "error", "raw_file_missing", path="relativePath"),
        issue(missing(alive.filter("wikiPath <> ''"), "wikiPath", page_paths, on_disk), 12, "error", "source_page_gone", F.col("wikiPath"), "relativePath"),
        issue(missing(alive.filter("convertedPath <> ''"), "convertedPath", page_paths, on_disk), 13, "error", "converted_page_gone", F.col("convertedPath"), "relativePath"),
    ]
    every = reduce(DataFrame.unionByName, out)
    best = every.orderBy(severity_rank(F.col("severity")), "_order", "_ord", "path", "detail").limit(max_issues)
    return best.select("id", "severity", "path", "check", "detail")


def for_display(issues: DataFrame) -> DataFrame:
    """Issues by severity, then path."""
    return issues.orderBy(severity_rank(F.col("severity")), "path", "check", "detail")


def severity_counts(issues: DataFrame) -> DataFrame:
    """A14."""
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
