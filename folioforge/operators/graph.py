"""The knowledge graph.

Nodes: (path, title, type, sources, links, mtime, ord); edges: (source, target, weight, reasons, ord), with
``ord`` for first-seen order.  Everything is joins, aggregates and windows over keys; only connected
components loop, each round a checkpointed edge list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import is_low_information, is_unknown, trim
from folioforge.operators.tables import look_up, materialise, ranked

MAX_NODES = 600
MAX_EDGES = 3500
PAGES_PER_SOURCE = 4
CANDIDATES = 3
# Markup words that are no titles, and the order of page types.
ARTEFACTS = "span smallcaps mark style width col class font div table tbody thead tr td img br hr svg path atom".split()
TYPE_ORDER = (("index", 0), ("synthesis", 0), ("source", 1), ("source_extract", 2), ("concept", 3), ("entity", 3))


def type_rank(kind: Column) -> Column:
    out = F.lit(4)
    for name, rank in TYPE_ORDER:
        out = F.when(kind == name, F.lit(rank)).otherwise(out)
    return out


def is_useful(title: Column, kind: Column, sources: Column, links: Column) -> Column:
    """P13."""
    t = trim(title)
    bare = (F.size(sources) == 0) & (F.size(links) == 0)
    return (
        (t != "")
        & ~is_unknown(t)
        & ~t.rlike(f"(?i)^\\[?({'|'.join(ARTEFACTS)})\\]?$")
        & ((F.length(t) > 1) | (kind == "index"))
        & ~(is_low_information(t) & bare)
    )


def page_score() -> Column:
    """What candidates are ordered by."""
    return type_rank(F.col("type")) * -100000 + F.size("links") * 10 + F.size("sources")


def alias_map(pages: DataFrame) -> DataFrame:
    """(alias, path) - title, path, path without prefix and ending, and base name, lower-cased; the last writer wins."""
    path = F.col("path")
    keys = F.array(
        F.col("title"), path, F.regexp_replace(F.regexp_replace(path, "^wiki/", ""), "\\.md$", ""), F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "\\.md$", "")
    )
    each = pages.select("path", "ord", F.posexplode(keys).alias("k", "alias"))
    return each.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("path", F.struct("ord", "k")).alias("path"))


def resolve_links(pages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(source, link, target, ord, pos): each link with the page it names, null where none."""
    aliases = alias_map(pages) if aliases is None else aliases
    each = pages.select(F.col("path").alias("source"), "ord", F.posexplode("links").alias("pos", "link"))
    return each.join(aliases.select(F.col("alias"), F.col("path").alias("target")), F.lower("link") == F.col("alias"), "left").drop("alias")


def _edge(family: int, weight: int, order: tuple[str, str], reason: Column) -> list[Column]:
    """Weight, reasons and place of an edge: its family, then two keys of its page."""
    place = F.struct(F.lit(family).alias("f"), F.col(order[0]).cast("long").alias("a"), F.col(order[1]).cast("long").alias("b"))
    return [F.lit(weight).cast("long").alias("weight"), F.array(reason).alias("reasons"), place.alias("ord")]


def link_edges(pages: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    found = resolve_links(pages).filter(F.col("target").isNotNull() & (F.col("target") != F.col("source")))
    return found.orderBy("ord", "pos").limit(limit).select("source", "target", *_edge(0, 3, ("ord", "pos"), F.lit("wikilink")))


def source_edges(pages: DataFrame, limit: int = MAX_EDGES, per_source: int = PAGES_PER_SOURCE, key: str = "sources") -> DataFrame:
    """Pairs of the first ``per_source`` pages of each source, by type and recency."""
    each = pages.select("path", "type", "mtime", "ord", F.posexplode(F.array_distinct(key)).alias("at", "s"))
    first = each.groupBy("s").agg(F.min(F.struct("ord", "at")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("s").orderBy(type_rank(F.col("type")), F.desc("mtime"), "ord"))
    few = each.withColumn("rn", rank).filter(F.col("rn") <= per_source).select("s", "path", "rn")
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.rn") < F.col("b.rn")) & (F.col("a.path") != F.col("b.path")))
    pairs = pairs.select(F.col("a.s").alias("s"), F.col("a.path").alias("source"), F.col("b.path").alias("target"), F.col("a.rn").alias("i"), F.col("b.rn").alias("j")).join(first, "s")
    pairs = pairs.withColumn("o", F.col("seen.ord")).withColumn("p", F.col("seen.at"))
    # Four keys order this family; the two of the page and source come first.
    return (
        pairs.orderBy("o", "p", "i", "j")
        .limit(limit)
        .select("source", "target", *_edge(1, 3, ("o", "p"), F.concat(F.lit("shared source: "), F.col("s"))), "i", "j")
    )


def extract_edges(pages: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    """Each source page with the extract of its first source that has one."""
    each = pages.select("path", "type", "ord", F.posexplode("sources").alias("at", "s"))
    extract = each.filter("type = 'source_extract'").groupBy("s").agg(F.min_by("path", F.struct("ord", "at")).alias("target"))
    found = each.filter("type = 'source'").join(extract, "s").groupBy("path", "ord").agg(F.min_by("target", "at").alias("target"))
    found = found.withColumn("z", F.lit(0)).orderBy("ord").limit(limit)
    return found.select(F.col("path").alias("source"), "target", *_edge(2, 4, ("ord", "z"), F.lit("converted markdown")))


def merge_edges(edges: DataFrame, limit: int | None = MAX_EDGES) -> DataFrame:
    """One edge per unordered pair - weights added, reasons distinct in order, ends as first seen."""
    at = F.struct("ord", "i", "j")
    merged = edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(
        F.min_by(F.struct("source", "target"), at).alias("e"),
        F.sum("weight").alias("weight"),
        F.sort_array(F.collect_list(F.struct("ord", "i", "j", "reasons"))).alias("r"),
        F.min(at).alias("ord"),
    )
    reasons = F.array_distinct(F.flatten(F.transform("r", lambda x: x["reasons"])))
    merged = merged.select("e.source", "e.target", "weight", reasons.alias("reasons"), "ord")
    return merged if limit is None else merged.orderBy("ord").limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    """A9."""
    return edges.select(F.explode(F.array("source", "target")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("degree"))


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("path").alias(end)), end, "left_semi")
    return edges


def components(nodes: DataFrame, edges: DataFrame, key: str = "path", order: str = "ord") -> DataFrame:
    """G1: nodes with ``community``, numbered by first node.

    Labels are smallest node orders; each round a node takes the smallest label around it and then its
    label's own label, so long chains shorten by doubling.  A node with very many neighbours, and a label that
    very many nodes have, are looked up where those rows are (``look_up``).
    """
    labels = materialise(nodes.select(F.col(key).alias("k"), F.col(order).cast("long").alias("label"), F.col(order).cast("long").alias("own")), "labels")
    both = edges.select(F.col("source").alias("x"), F.col("target").alias("y"))
    both = materialise(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "adjacent")
    while True:
        around = look_up(both, "y", labels.select(F.col("k").alias("y"), F.col("label").alias("near")), "near").groupBy("x").agg(F.min("near").alias("near"))
        step = labels.join(around, F.col("k") == F.col("x"), "left").select("k", "own", F.least("label", F.coalesce("near", "label")).alias("l"), F.col("label").alias("was"))
        step = materialise(step, "near")
        step = look_up(step, "l", step.select(F.col("own").alias("l"), F.col("l").alias("up")), "up")
        step = materialise(step.select("k", "own", "was", F.least("l", F.coalesce("up", "l")).alias("label")), "labels")
        moved = not step.filter("label <> was").isEmpty()
        labels = step.select("k", "label", "own")
        if not moved:
            break
    numbers = ranked(labels.select("label").distinct(), F.col("label").asc(), to="community").withColumn("community", F.col("community").cast("int"))
    named = look_up(labels, "label", numbers, "community").select(F.col("k").alias(key), "community")
    return nodes.join(named, key)


def layout(nodes: DataFrame) -> DataFrame:
    """The twelve largest communities as spirals on an ellipse, the others on a grid.

    Integer positions round half up.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("community"))
    nodes = nodes.withColumn("_n", size)
    place = nodes.select("community", "_n").distinct().withColumn("_c", F.row_number().over(Window.orderBy(F.desc("_n"), "community")) - 1)
    nodes = nodes.join(place.select("community", "_c"), "community")
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weight"), "title", "path")) - 1
    nodes = nodes.withColumn("_i", rank)
    large = F.least(F.lit(12), F.max("_c").over(Window.partitionBy()) + 1)  # at most MAX_NODES rows here
    angle = (F.col("_c") - 1) / F.greatest(F.lit(1), large - 1) * 2 * math.pi
    cx = F.when(F.col("_c") == 0, F.lit(340.0)).otherwise(340 + F.cos(angle) * 250)
    cy = F.when(F.col("_c") == 0, F.lit(260.0)).otherwise(270 + F.sin(angle) * 185)
    ring = F.greatest(F.lit(34), F.least(F.lit(150), 24 + F.col("_n") * 2)) * F.sqrt("_i")
    turn = F.col("_i") * (math.pi * (3 - math.sqrt(5)))
    rest = Window.partitionBy(F.col("_c") >= 12)
    k = F.row_number().over(rest.orderBy("_c", "_i")) - 1
    columns = F.greatest(F.lit(1), F.ceil(F.sqrt(F.count(F.lit(1)).over(rest))))
    half_up = lambda v: F.floor(v + 0.5)
    x = F.when(F.col("_c") < 12, half_up(cx + F.cos(turn) * ring)).otherwise(80 + (k % columns) * 34)
    y = F.when(F.col("_c") < 12, half_up(cy + F.sin(turn) * ring)).otherwise(560 + F.floor(k / columns) * 34)
    return nodes.withColumn("x", x.cast("long")).withColumn("y", y.cast("long")).drop("_n", "_c", "_i")


def insights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n, community, paths): unconnected pages and the largest community.

    A bridge between communities cannot occur: communities are components over the same edges.
    """
    d = nodes.join(degrees(edges), "path", "left")
    first = lambda n: F.slice(F.transform(F.sort_array(F.collect_list(F.struct("ord", "path"))), lambda s: s["path"]), 1, n)
    gap = d.filter(F.col("degree").isNull() & (F.col("type") != "index")).agg(F.count(F.lit(1)).alias("n"), first(6).alias("paths"))
    gap = gap.filter("n > 0").select(F.lit("gap").alias("kind"), "n", F.lit(None).cast("int").alias("community"), "paths")
    best = nodes.groupBy("community").agg(F.count(F.lit(1)).alias("n"), first(8).alias("paths")).orderBy(F.desc("n"), "community").limit(1)
    return gap.unionByName(best.select(F.lit("cluster").alias("kind"), "n", "community", "paths"))


def build(pages: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, insights)."""
    useful = pages.filter(is_useful(F.col("title"), F.col("type"), F.col("sources"), F.col("links")))
    best = useful.withColumn("_s", page_score()).orderBy(F.desc("_s"), F.desc("mtime"), "ord").limit(max_nodes * CANDIDATES)
    place = F.row_number().over(Window.orderBy(F.desc("_s"), F.desc("mtime"), "ord"))  # at most max_nodes * CANDIDATES rows
    chosen = materialise(best.withColumn("ord", place).drop("_s"), "candidates")
    zero = lambda e: e if "i" in e.columns else e.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    families = [link_edges(chosen, max_edges), source_edges(chosen, max_edges), extract_edges(chosen, max_edges)]
    edges = zero(families[0]).unionByName(zero(families[1])).unionByName(zero(families[2]))
    raw = materialise(merge_edges(edges, max_edges), "edges")
    d = chosen.join(degrees(raw), "path", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    anchor = F.when(F.col("type").isin("index", "synthesis"), 0).when(F.col("degree") > 0, 1).otherwise(2)
    d = d.withColumn("_o", F.struct(anchor.alias("a"), "ord")).withColumn("_s", page_score() + 12 * F.col("degree"))
    nodes = d.orderBy(F.desc(F.col("degree") > 0), F.desc("_s"), "_o").limit(max_nodes)
    place = F.row_number().over(Window.orderBy(F.desc(F.col("degree") > 0), F.desc("_s"), "_o"))  # at most max_nodes rows
    nodes = materialise(nodes.withColumn("ord", place).drop("_o", "_s"), "nodes")
    kept = between(raw, nodes)
    inner = degrees(kept).withColumnRenamed("degree", "inner")
    weight = F.greatest(F.lit(1), F.size("links") + F.size("sources") + F.col("degree"), F.coalesce(F.col("inner") + 1, F.lit(1)))
    nodes = components(nodes.join(inner, "path", "left").withColumn("weight", weight), kept)
    nodes = nodes.select("path", "title", "type", "community", "weight", "ord")
    return layout(nodes), kept, insights(nodes, kept)


def community_sizes(nodes: DataFrame, most: int = 8) -> DataFrame:
    """The largest communities, the first of equals."""
    return nodes.groupBy("community").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "community").limit(most)


def visible(nodes: DataFrame, edges: DataFrame, needle: str) -> tuple[DataFrame, DataFrame]:
    """Nodes whose title, path or type contains ``needle``, and the edges between them."""
    n = needle.strip().lower()
    shown = nodes.filter(F.lower("title").contains(n) | F.lower("path").contains(n) | F.lower("type").contains(n))
    return shown, between(edges, shown)
