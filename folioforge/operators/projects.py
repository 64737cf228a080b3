"""Projects as a table: id, name, description, createdAt, updatedAt; each owns a folder of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import validate
from folioforge.functions.text import readable_or, slug, trim

PROJECT = "id string, name string, description string, createdAt timestamp, updatedAt timestamp"
# The folders that a project has from the start.
FOLDERS = (
    "raw/sources raw/assets wiki/sources wiki/sources/converted wiki/concepts wiki/entities wiki/queries wiki/research wiki/synthesis .state .state/chats .state/uploads"
).split()


def root(data: str, project_id: Column) -> Column:
    """The folder of a project below the data folder."""
    return F.concat(F.lit(f"{data.rstrip('/')}/projects/"), project_id)


def listed(projects: DataFrame, data: str) -> DataFrame:
    """All projects with their folders."""
    return projects.withColumn("root", root(data, F.col("id")))


def get(projects: DataFrame, project_id: str) -> DataFrame:
    """One project; an id that does not exist is an error."""
    row = projects.filter(F.col("id") == validate.identifier(project_id, "project"))
    if row.isEmpty():
        raise KeyError(f"no project {project_id}")
    return row


def create(projects: DataFrame, name: str, description: str, now: Column) -> DataFrame:
    """The projects and a new one, whose id is its name's slug, told apart by -2, -3, ... from those that exist."""
    validate.text(name, "name", required=True, most=200)
    validate.text(description, "description", most=4000)
    one = projects.sparkSession.range(1).select(F.lit(name).alias("name"))
    base = slug(F.col("name"), fallback="wiki")
    taken = projects.select(F.lower("id").alias("id"))
    # The first free number among one more than there are projects of that slug.
    like = one.withColumn("base", base).join(taken, F.col("id").startswith(F.col("base")), "left").groupBy("name", "base").agg(F.count("id").alias("n"))
    options = like.select("name", F.explode(F.sequence(F.lit(1), F.col("n").cast("int") + 1)).alias("k"), "base")
    options = options.withColumn("id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("k").cast("string"))))
    free = options.join(taken, "id", "left_anti").groupBy("name").agg(F.min_by("id", "k").alias("id"))
    shown = readable_or(trim(F.col("name")), F.lit("未命名知识库"))
    new = free.select("id", shown.alias("name"), F.lit(description.strip()).alias("description"), now.alias("createdAt"), now.alias("updatedAt"))
    return projects.select(*new.columns).unionByName(new)


def touch(projects: DataFrame, project_id: str, now: Column) -> DataFrame:
    """The projects with a new time of change for one."""
    return projects.withColumn("updatedAt", F.when(F.col("id") == project_id, now).otherwise(F.col("updatedAt")))


def public(projects: DataFrame) -> DataFrame:
    """What a listing shows, without folders."""
    return projects.drop("root")
