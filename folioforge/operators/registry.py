"""Registry maintenance: keyed merges of whole tables.

Ids are hashes of what they name, so a rerun writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import paths
from folioforge.functions.text import slug
from folioforge.operators.tables import numbered

ACTIVE = ("queued", "running")


def stable_id(name: Column, *salt: Column) -> Column:
    """slug and eight hexadecimal digits of a hash; no clock in it."""
    return F.concat(F.substring(slug(name, fallback="untitled"), 1, 48), F.lit("-"), F.substring(F.sha2(F.concat_ws("\x1f", name, *salt), 256), 1, 8))


def candidates(files: DataFrame) -> DataFrame:
    """Distinct supported files (relativePath, size, sha256), below ``raw/sources/``; one row a path."""
    path = paths.posix(F.col("relativePath"))
    path = F.when(path.startswith("raw/sources/"), path).otherwise(F.concat(F.lit("raw/sources/"), path))
    rows = files.withColumn("relativePath", path).filter(paths.is_supported(F.col("relativePath")))
    return rows.groupBy("relativePath").agg(F.max_by(F.struct("size", "sha256"), "sha256").alias("f")).select("relativePath", "f.*")


def register(files: DataFrame, sources: DataFrame, queue: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all sources, new queue items, outcome per candidate: 'skipped', 'updated' or 'inserted').

    A file that is ready, converted and unchanged is skipped; a changed one keeps its record's id and is
    queued again; a source that is queued or running is not queued twice.
    """
    new = candidates(files).select(F.col("relativePath").alias("_path"), F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    both = sources.join(new, F.col("relativePath") == F.col("_path"), "full_outer")
    known, come = F.col("id").isNotNull(), F.col("_path").isNotNull()
    same = known & come & (F.col("sha256") == F.col("_sha")) & (F.col("status") == "ready") & (F.coalesce("convertedPath", F.lit("")) != "")
    action = F.when(~come, "kept").when(same, "skipped").when(known, "updated").otherwise("inserted")
    both = both.withColumn("action", F.coalesce(action, F.lit("updated")))
    fresh = F.col("action").isin("updated", "inserted")
    path = F.coalesce("relativePath", "_path")
    values = {
        "id": F.coalesce("id", stable_id(path)),
        "fileName": F.coalesce("fileName", paths.base_name(path)),
        "relativePath": path,
        "kind": F.when(fresh, paths.kind(path)).otherwise(F.col("kind")),
        "size": F.when(fresh, F.col("_size")).otherwise(F.col("size")),
        "sha256": F.when(fresh, F.col("_sha")).otherwise(F.col("sha256")),
        "status": F.when(fresh, F.lit("queued")).otherwise(F.col("status")),
        "importedAt": F.coalesce("importedAt", F.when(come, now)),
        "updatedAt": F.when(fresh, now).otherwise(F.col("updatedAt")),
        "error": F.when(fresh, F.lit(None)).otherwise(F.col("error")),
    }
    merged = both.select(*[values.get(c, F.col(c)).alias(c) for c in sources.columns], "action")
    busy = queue.filter(F.col("status").isin(*ACTIVE)).select(F.col("sourceId").alias("id")).distinct()
    todo = merged.filter(F.col("action").isin("updated", "inserted")).join(busy, "id", "left_anti")
    items = todo.select(
        stable_id(F.col("id"), F.col("sha256")).alias("id"), F.col("id").alias("sourceId"), "relativePath", F.lit("queued").alias("status"), now.alias("createdAt"), now.alias("updatedAt")
    )
    return merged.drop("action"), items, merged.filter("action <> 'kept'").select("relativePath", "action")


def apply_patches(rows: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the non-null values of their patch."""
    changed = [c for c in patches.columns if c != key]
    p = patches.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in changed])
    joined = rows.join(p, rows[key] == F.col("_k"), "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), rows[c]).alias(c) if c in changed else rows[c] for c in rows.columns])


def index_diff(old: DataFrame, new: DataFrame, key: str = "id", signature: str = "signature") -> DataFrame:
    """(key, action) of what an index needs - 'insert', 'update', 'delete' or 'keep'."""
    o, n = old.select(F.col(key).alias("_o"), F.col(signature).alias("_os")), new.select(F.col(key).alias("_n"), F.col(signature).alias("_ns"))
    both = o.join(n, F.col("_o") == F.col("_n"), "full_outer")
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(F.col("_os").eqNullSafe(F.col("_ns")), "keep").otherwise("update")
    return both.select(F.coalesce("_n", "_o").alias(key), action.alias("action"))


def upsert_index(index: DataFrame, documents: DataFrame, key: str = "id", signature: str = "signature") -> DataFrame:
    """The index after a sync: unchanged documents stay as they are, missing ones go."""
    keep = index_diff(index, documents, key, signature).filter("action = 'keep'").select(key)
    return index.join(keep, key, "left_semi").unionByName(documents.join(keep, key, "left_anti"))


def ready_by_pages(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Sources whose generated page carries their id, path and hash are ready."""
    made = pages.select(F.col("source_id").alias("id"), F.col("source_path").alias("relativePath"), F.col("source_sha").alias("sha256"), F.col("path").alias("_page"))
    made = made.groupBy("id", "relativePath", "sha256").agg(F.min("_page").alias("_page"))
    out = sources.join(made, ["id", "relativePath", "sha256"], "left")
    found = F.col("_page").isNotNull()
    return out.select(
        *[
            F.when(found, F.lit("ready")).otherwise(F.col("status")).alias(c)
            if c == "status"
            else (F.when(found, F.col("_page")).otherwise(F.col("wikiPath")).alias(c) if c == "wikiPath" else F.col(c))
            for c in sources.columns
        ]
    )


def delete_cascade(removed: DataFrame, key: str, **tables: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """Each table without the rows that belong to ``removed`` keys."""
    gone = removed.select(F.col(key).alias("_gone")).distinct()
    return {name: df.join(gone, df[col] == F.col("_gone"), "left_anti") for name, (df, col) in tables.items()}


def record_failures(sources: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Uploads that failed become records, unless their path has one."""
    rows = failures.join(sources.select("relativePath"), "relativePath", "left_anti")
    path = F.col("relativePath")
    values = {"id": stable_id(path), "fileName": paths.base_name(path), "relativePath": path, "kind": paths.kind(path), "status": F.lit("failed"), "error": F.col("error"), "importedAt": now, "updatedAt": now, "size": F.col("size")}
    kinds = dict(sources.dtypes)
    return sources.unionByName(rows.select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in sources.columns]))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names made distinct, whatever their case, by -2, -3, ... before the ending.

    A name that most rows have is numbered in ordered ranges by several tasks, not in one window.
    """
    rows = numbered(rows.withColumn("_name", F.lower(name)), "_name", F.col(order), to="_nth")
    stem, ext = F.regexp_replace(name, "\\.[^./]*$", ""), F.regexp_extract(name, "(\\.[^./]*)$", 1)
    new = F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), F.col("_nth").cast("string"), ext))
    return rows.withColumn(name, new).drop("_name", "_nth")
