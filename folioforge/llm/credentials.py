"""Secrets in texts, told from examples by who owns them; native DataFrame functions only.

Base kinds are found by pattern, leftmost and without overlaps, each kind by itself: ``assign`` (a keyword, a sign and
a value of 8 or more characters), ``access`` (an access-key id of 16 or more) and ``hex`` (32 or more hexadecimal
digits).  Base spans are always reported.

Corpus-wide ownership frequency: every base value, and every bare run of 16 or more key characters with a letter and
a digit that lies outside assignments and holds no base match, is a candidate.  Candidates are hashed and aggregated, first by repository,
then by owner: how many of each hold the value, and whether some place assigns it to a keyword.  A value that
more than ``MAX_OWNERS`` owners hold is an *example*, copied from page to page; else it is owner-specific.  A bare run is
reported as ``owned`` if it is owner-specific and looks live: it is assigned somewhere, or it has ``STRONG`` or
more characters with lower case, upper case, digits and ``DISTINCT`` different ones.  ``n_live`` and ``n_example`` count
the reported spans by this, base ones included.

A repository is the ``source`` column (null is one of its own); its owner is what stands before the first ``/``, without
regard to case.

Null text is empty and has no spans.  Whole texts are searched, however long, in time proportional to their length.  Spans of one place and kind
occur once; spans are ordered by start, then kind in the order above, ``owned`` last.  Repeated rows, equal ids included, are
judged each by itself, though all of them count as one repository.  An empty table gives an empty result.  Other columns are
ignored, or, named in ``keep``, passed on.

Texts are read once and never shuffled: a scan leaves the matches and what lies between them as lengths; positions are
running sums of these.  A value that a third of all rows hold is counted by map-side aggregation and its rows are dealt to several
tasks when the counts are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm.shared import attach, hot_keys, integral, materialise

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
#: Bare runs of key characters.
RUN = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "owned")
#: The most owners of a value that still counts as owner-specific: one, and one that forked or mirrors it.
MAX_OWNERS = 2
#: Least length and least number of different characters of a bare run that looks live by itself.
STRONG, DISTINCT = 20, 10


def owner_of(repository: Column) -> Column:
    return F.lower(F.substring_index(repository, "/", 1))


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Matches in order, each with the length of what lies between it and the one before."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.lit(kind).alias("kind"), m.alias("value")))
    return F.filter(each, lambda x: x["value"].isNotNull())


def _assigned_and_runs(text: Column) -> Column:
    """Assignments, and the bare runs between them, in order."""
    pieces = F.split(text, ASSIGN, -1)
    whole = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))

    def of(piece: Column, match: Column) -> Column:
        runs = F.when(piece.rlike(RUN), _found(piece, RUN, "run")).otherwise(_none())
        rest = F.coalesce(F.length(F.get(F.split(piece, RUN, -1), F.size(runs))), F.length(piece))
        last = F.array(F.struct(rest.alias("gap"), F.lit("assign").alias("kind"), match.alias("value")))
        return F.when(match.isNull(), runs).otherwise(F.concat(runs, last))

    return F.flatten(F.zip_with(pieces, whole, of))


def _none() -> Column:
    return F.array().cast("array<struct<gap:int,kind:string,value:string>>")


def _scan(docs: DataFrame, keep: list[str], repository: str, text: str) -> DataFrame:
    """One row a document: its place, ``keep``, repository and three lists of matches."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    some = lambda pattern, found: F.when(F.col("_t").rlike(pattern), found).otherwise(_none())
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{repository}`").alias("_repo"), t.alias("_t"))
    return rows.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"),
        "_repo",
        F.array(
            some(f"{ASSIGN}|{RUN}", _assigned_and_runs(F.col("_t"))),
            some(ACCESS, _found(F.col("_t"), ACCESS, "access")),
            some(HEX, _found(F.col("_t"), HEX, "hex")),
        ).alias("_lists"),
    )


def candidates(scanned: DataFrame) -> DataFrame:
    """Spans with their values: (row, repository, kind, start, end, hash, assigned, strong)."""
    lists = scanned.select("_row", "_repo", F.posexplode("_lists").alias("_list", "_m")).filter(F.size("_m") > 0)
    each = lists.select("_row", "_repo", "_list", F.posexplode("_m").alias("_at", "_m")).select("_row", "_repo", "_list", "_at", "_m.*")
    before = Window.partitionBy("_row", "_list").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = each.withColumn("end", F.sum(F.col("gap").cast("long") + F.length("value")).over(before))
    spans = ended.withColumn("start", F.col("end") - F.length("value"))
    assigned = F.col("kind") == "assign"
    value = F.when(assigned, F.regexp_extract("value", ASSIGN, 1)).otherwise(F.col("value"))
    spans = spans.withColumn("value", value)
    bare = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & ~F.col("value").rlike(f"{ACCESS}|{HEX}")
    spans = spans.filter(F.when(assigned, F.length("value") >= LEAST_VALUE).when(F.col("kind") == "run", bare).otherwise(True))
    strong = (
        (F.length("value") >= STRONG)
        & F.col("value").rlike("[a-z]")
        & F.col("value").rlike("[A-Z]")
        & (F.size(F.array_distinct(F.split("value", ""))) >= DISTINCT)
    )
    return spans.select("_row", "_repo", "kind", "start", "end", F.md5("value").alias("hash"), assigned.alias("assigned"), strong.alias("strong"))


def ownership(spans: DataFrame) -> DataFrame:
    """One row a candidate value: occurrences, repositories and owners that hold it, and whether it is assigned somewhere."""
    by_repo = spans.groupBy("hash", F.coalesce("_repo", F.lit("")).alias("_repo"), F.col("_repo").isNull().alias("_unnamed")).agg(
        F.count(F.lit(1)).alias("n"), F.max("assigned").alias("assigned")
    )
    by_owner = by_repo.groupBy("hash", owner_of(F.col("_repo")).alias("_owner"), "_unnamed").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"), F.max("assigned").alias("assigned")
    )
    return by_owner.groupBy("hash").agg(
        F.sum("n").alias("n_places"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.max("assigned").alias("assigned")
    )


def annotate(docs: DataFrame, *keep: str, doc_id: str = "doc_id", repository: str = "source", text: str = "text") -> DataFrame:
    """doc_id and ``keep`` with ``found``: array of (start, kind, end, live), and the numbers of live and example spans."""
    integral(docs, doc_id)
    keep = list(dict.fromkeys((doc_id, *keep)))
    scanned = materialise(_scan(docs, keep, repository, text), "scanned")
    spans = materialise(candidates(scanned), "spans")
    owners = materialise(ownership(spans), "owners")
    hot = hot_keys(owners, "hash", "n_places")
    known = owners.select("hash", (F.col("n_owners") <= MAX_OWNERS).alias("specific"), F.col("assigned").alias("known"))
    judged = attach(spans, known, ["hash"], hot, "_row", "inner", owners.count())
    judged = judged.filter((F.col("kind") != "run") | (F.col("specific") & (F.col("strong") | F.col("known"))))
    kind = F.when(F.col("kind") == "run", F.lit(KINDS.index("owned")))
    for i, k in enumerate(KINDS[:-1]):
        kind = kind.when(F.col("kind") == k, F.lit(i))
    span = F.struct("start", kind.alias("kind"), "end", F.col("specific").alias("live"))
    by_row = judged.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("found"))  # as many as its document has
    matched = F.exists("_lists", lambda x: F.size(x) > 0)
    own = scanned.select("_row", "_keep", matched.alias("_matched"))
    none = F.array().cast(by_row.schema["found"].dataType)
    quiet = own.filter(~F.col("_matched")).select("_keep.*", none.alias("found"))
    loud = own.filter("_matched").join(by_row, "_row", "left").select("_keep.*", F.coalesce("found", none).alias("found"))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = lambda x: F.struct(x["start"].alias("start"), F.get(names, x["kind"]).alias("kind"), x["end"].alias("end"), x["live"].alias("live"))
    live = F.size(F.filter("found", lambda x: x["live"])).cast("long")
    return (
        quiet.unionByName(loud)
        .withColumn("n_live", live)
        .withColumn("n_example", F.size("found").cast("long") - F.col("n_live"))
        .withColumn("found", F.transform("found", named))
    )
