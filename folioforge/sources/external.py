"""External search results: payloads of search services as one table shape.

A payload row is (query, provider, payload); the JSON of each provider is read by path, natively, so the
same code serves a live connector's output and an archived one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import source_text

# Where each provider keeps its results, and the names of their fields.
PROVIDERS = {
    "searxng": ("results", "url", "title", "content"),
    "tavily": ("results", "url", "title", "content"),
    "serpapi": ("organic_results", "link", "title", "snippet"),
    "typesense": ("hits[*].document", "url", "title", "content"),
}
TITLE_CHARS, SNIPPET_CHARS = 300, 1200
#: Fields that may hold a document's text, best first.
TEXT_FIELDS = ("content", "text", "body", "summary", "description")


def results(payloads: DataFrame) -> DataFrame:
    """(query, rank, url, title, snippet); malformed payloads have no rows."""
    out = None
    for provider, (path, url, title, snippet) in PROVIDERS.items():
        rows = payloads.filter(F.col("provider") == provider)
        found = F.get_json_object("payload", f"$.{path}")
        found = F.when(found.startswith("{"), F.concat(F.lit("["), found, F.lit("]"))).otherwise(found)  # a wildcard's only match comes bare
        each = F.from_json(found, "array<map<string,string>>")
        rows = rows.select("query", F.posexplode(each).alias("at", "r"))
        rows = rows.select(
            "query",
            (F.col("at") + 1).alias("rank"),
            F.col("r")[url].alias("url"),
            source_text(F.coalesce(F.col("r")[title], F.lit("")), TITLE_CHARS).alias("title"),
            source_text(F.coalesce(F.col("r")[snippet], F.lit("")), SNIPPET_CHARS).alias("snippet"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


# The fields of an external index and their types.
INDEX_FIELDS = {"project_id": "string", "path": "string", "kind": "string", "title": "string", "content": "string", "type": "string", "citations": "string[]"}


def index_gaps(fields: dict[str, str]) -> list[str]:
    """The fields that a collection lacks or has under another type; it can be used if there are none."""
    return [name for name, kind in INDEX_FIELDS.items() if fields.get(name) != kind]


def collection_name(project_id: str, wanted: str = "") -> str:
    """The collection of a project: the one asked for, else one made of a hash of its id."""
    import hashlib
    import re

    name = wanted.strip() or f"wiki_{hashlib.sha256(project_id.encode()).hexdigest()[:24]}"
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,100}", name):
        raise ValueError("a collection's name has letters, digits, underscores and hyphens, at most 100")
    return name


def pick_fields(columns: list[str], most: int = 24) -> list[str]:
    """The text fields of a collection, known names first."""
    known = [c for c in TEXT_FIELDS if c in columns]
    return (known + [c for c in columns if c not in known])[:most]
