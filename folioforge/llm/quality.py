"""Quality rules at host level, in native DataFrame functions only.

Per document: counts over the whole text (one narrow pass, words of ``[^\\x20\\x09-\\x0D]+``), a base
verdict, and the rules it fails.  Per host (the ``source`` column; null is a host of its own): failures
are summed, an empirical beta prior is fitted by moments over all hosts, and each host's failure rate is
shrunk towards the corpus.  Per document again: the host's verdict is joined back.

Host verdicts: ``rejected`` (shrunk rate ``REJECT_RATE`` or more) - all its documents go; ``trusted`` - only
base failures go; ``watched`` - documents failing any rule go.  A host is trusted if there is evidence for it: by its
posterior, the rate is above the corpus's with a probability of ``DOUBT`` at most.  A host of few documents, or one
among hosts that differ no more than their sizes explain, has to be better by more for that, because both pull its
posterior to the corpus; one without evidence is watched.

Null or empty text has no words and fails the base rule.  Ties and repeated rows are judged alike, each
row on its own.  An empty table gives an empty result.  Other columns, whatever their names, are ignored
by ``judge`` and passed through unchanged by ``keep_good``.

Repeated 3-word windows are found by 64-bit window hashes sorted inside the row: no explode, no shuffle
of words, linearithmic in the length of a text, however long.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.shared import lookup, materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Soft rules: symbols per 100 words, repeated lines per 100 lines, mean word length outside the range.
MAX_SYMBOL_PERCENT = 20
MAX_DUP_LINE_PERCENT = 30
WORD_LENGTH = (2, 15)
REJECT_RATE = 0.9
#: A host is trusted if its rate is above the corpus's with this probability at most; as a normal deviate.
DOUBT = 0.4
DOUBT_Z = NormalDist().inv_cdf(DOUBT)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def repeated_positions(h: Column) -> Column:
    """Positions, ascending, of the values of the array of longs ``h`` that it has twice or more.

    Each value becomes one long - its high bits above, its position in the low bits - so that a plain sort brings
    equal ones together.  Values that agree in the high bits only do so, too; so what has such a neighbour is sorted
    again, value and position as a pair, and equal values are neighbours then.
    """

    def sort(m: Column) -> Column:
        packed = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))
        return _let(F.sort_array(packed), lambda s: suspects(s, m))

    def suspects(s: Column, m: Column) -> Column:
        high = lambda k: F.get(s, k).bitwiseAND(F.bitwise_not(m))
        near = F.filter(s, lambda x, k: (high(k) == high(k - 1)) | (high(k) == high(k + 1)))
        pairs = F.transform(near, lambda x: _let(x.bitwiseAND(m), lambda i: F.struct(F.get(h, i.cast("int")).alias("h"), i.alias("i"))))
        return _let(F.sort_array(pairs), equal)

    def equal(p: Column) -> Column:
        at = lambda k: F.get(p, k)["h"]
        return F.sort_array(F.transform(F.filter(p, lambda x, k: (at(k) == at(k - 1)) | (at(k) == at(k + 1))), lambda x: x["i"]))

    bits = F.length(F.bin(F.size(h))).cast("int")
    return _let(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, sort)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more in ``words``, first ones included."""

    def cover(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, k + 1) - x, F.lit(3).cast("long"))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def windows(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(_let(h, lambda x: _let(repeated_positions(x), cover)))

    return _let(words, windows)


def measures(text: Column) -> Column:
    """The five counts of one text and its number of lines with a word, as a struct."""
    text = F.coalesce(text, F.lit(""))

    def over(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return F.struct(
        _let(words_of(text), over).alias("w"),
        _let(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lines).alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )


def measure(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns, the five counts, ``base_failed`` and ``failed`` (any rule failed)."""
    m = docs.select(*keep, measures(F.col(text)).alias("_m"))
    m = m.select(
        *keep,
        F.col("_m.w.n_words"),
        F.col("_m.w.word_chars"),
        F.col("_m.n_symbols"),
        F.col("_m.l.n_dup_lines"),
        F.col("_m.w.n_repeat_words"),
        F.col("_m.l.n_lines").alias("_n_lines"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("_n_lines"))
        | (F.col("word_chars") < WORD_LENGTH[0] * F.col("n_words"))
        | (F.col("word_chars") > WORD_LENGTH[1] * F.col("n_words"))
    )
    return m.withColumn("base_failed", base).withColumn("failed", base | soft).drop("_n_lines")


def host_verdicts(measured: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, its deviate from the corpus's rate, and verdict.

    The prior Beta(a, b) has the corpus's failure rate as mean and a strength fitted by moments to how
    much host rates spread beyond what their sizes explain: hosts that agree pull each other close, and
    a host of few documents stays near the corpus.  The posterior is taken as normal: ``host_z`` is how many of its
    standard deviations its mean lies above the corpus's rate, 0 where nothing or everything fails.
    """
    hosts = measured.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("k"))
    total = hosts.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"), F.count(F.lit(1)).alias("th"))
    rate = F.col("tk") / F.greatest(F.col("tn"), F.lit(1))
    spread = hosts.crossJoin(F.broadcast(total)).agg(  # one row of totals
        F.first("tn").alias("tn"),
        F.first("tk").alias("tk"),
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - rate, 2)).alias("ss"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.first("th").alias("th"),
    )
    p = F.col("tk") / F.greatest(F.col("tn"), F.lit(1))
    within = p * (1 - p)
    # Moments: E[ss] = (h-1) p(1-p)(1-rho) + rho p(1-p)(N - sum n^2 / N); strength = 1/rho - 1.
    rho = (F.col("ss") - (F.col("th") - 1) * within) / F.nullif(within * (F.col("tn") - F.col("n2") / F.col("tn") - F.col("th") + 1), F.lit(0.0))
    rho = F.least(F.lit(0.5), F.greatest(F.lit(0.001), F.coalesce(rho, F.lit(0.5))))
    prior = spread.select(p.alias("p"), (1 / rho - 1).alias("strength"))
    shrunk = (F.col("k") + F.col("p") * F.col("strength")) / (F.col("n") + F.col("strength"))
    spread_of = F.sqrt(F.greatest(F.lit(0.0), F.col("host_rate") * (1 - F.col("host_rate"))) / (F.col("n") + F.col("strength") + 1))
    z = F.coalesce((F.col("host_rate") - F.col("p")) / F.nullif(spread_of, F.lit(0.0)), F.lit(0.0))
    verdict = F.when(F.col("host_rate") >= REJECT_RATE, "rejected").when(F.col("host_z") <= DOUBT_Z, "trusted").otherwise("watched")
    return (
        hosts.crossJoin(F.broadcast(prior))  # one row
        .withColumn("host_rate", shrunk)
        .withColumn("host_z", z)
        .withColumn("host_verdict", verdict)
        .select(host, F.col("n").alias("host_docs"), F.col("k").alias("host_failed"), "host_rate", "host_z", "host_verdict")
    )


def _with_hosts(measured: DataFrame, host: str) -> DataFrame:
    hosts = materialise(host_verdicts(measured, host), "hosts")
    out = lookup(measured, hosts, host, hosts.count())
    gone = F.col("base_failed") | (F.col("host_verdict") == "rejected") | ((F.col("host_verdict") == "watched") & F.col("failed"))
    return out.withColumn("kept", ~gone)


def judge(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Counts, verdicts and host figures of every document.  The text is read once: counts go to a scratch table."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text"))
    judged = _with_hosts(materialise(measure(rows, "_doc", "_host", text="_text"), "measures"), "_host")
    return judged.withColumnsRenamed({"_doc": doc_id, "_host": host})


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were.

    Rows and counts are written together once, so that rows without or with equal keys need no join.
    """
    cols = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text"))
    m = materialise(measure(row, "_row", "_host", text="_text").select("_row", "_host", "base_failed", "failed"), "measured")
    return _with_hosts(m, "_host").filter("kept").select("_row.*")
