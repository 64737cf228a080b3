"""Listings, chats and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_PAGE = 5000
# The order of statuses in a listing, and the words that find them.
STATUS_ORDER = {"ready": 0, "ingesting": 1, "queued": 2, "failed": 3, "skipped": 4}
STATUS_WORDS = {
    "queued": "queued 排队摄入 待摄入 排队 等待 待处理 处理中 摄入队列",
    "ingesting": "ingesting 摄入中 正在摄入 处理中 正在处理",
    "ready": "ready 可用 已完成 完成 已摄入 可用文件",
    "skipped": "skipped 跳过 已跳过 忽略",
    "failed": "failed 失败 摄入失败 错误 需要处理 异常",
}
HISTORY = 8
HISTORY_CHARS = 2200


def _case(c: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def matches(needle: str, *columns: str) -> Column:
    """Any of the columns, or a word for the status, contains ``needle``."""
    n = needle.strip().lower()
    values = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns], _case(F.col("status"), STATUS_WORDS))
    return F.exists(values, lambda v: v.contains(n))


def sources_page(sources: DataFrame, needle: str = "", limit: int = 100, offset: int = 0, compact: bool = False) -> DataFrame:
    """A page of the registry by status, newest first, then name; ``total`` is the count before the cut."""
    limit, offset = min(MAX_PAGE, max(1, int(limit))), max(0, int(offset))
    rows = sources.filter(matches(needle, "title", "fileName", "relativePath", "kind", "status", "error")) if needle.strip() else sources
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(_case(F.col("status"), STATUS_ORDER), F.desc(F.coalesce("updatedAt", "importedAt")), "fileName").offset(offset).limit(limit)
    if compact:
        page = page.drop("summary").withColumn("error", F.substring("error", 1, 500))
    return page.crossJoin(F.broadcast(total))  # one row


def pages_page(pages: DataFrame, needle: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """Pages whose path contains ``needle``, files of the root first."""
    rel = F.regexp_replace("path", "^wiki/", "")
    rows = pages.filter(F.lower(rel).contains(needle.strip().lower())) if needle.strip() else pages
    return rows.orderBy(rel.contains("/"), rel).offset(max(0, offset)).limit(min(MAX_PAGE, max(1, limit)))


def limited(rows: DataFrame, n: int, *order: Column | str) -> tuple[DataFrame, Column]:
    """The first ``n`` rows and whether there were more, from one scan of n + 1."""
    some = rows.orderBy(*order).limit(n + 1)
    place = F.row_number().over(Window.orderBy(*order))  # at most n + 1 rows
    marked = some.withColumn("_r", place).withColumn("limited", F.count(F.lit(1)).over(Window.partitionBy()) > n)
    return marked.filter(F.col("_r") <= n).drop("_r"), F.col("limited")


def by_section(pages: DataFrame, most: int = 300) -> DataFrame:
    """Pages by the second part of their path, at most ``most`` each."""
    parts = F.split("path", "/")
    section = F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(F.lit("root"))
    rows = pages.withColumn("section", section)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("path"))).filter(F.col("place") <= most)


# ---------------------------------------------------------------- chats
def history(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", n: int = HISTORY) -> DataFrame:
    """The last ``n`` messages of each conversation, in order, shortened."""
    back = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    rows = messages.withColumn("back", back.cast("long")).filter(F.col("back") <= n)
    return rows.withColumn("text", F.substring("text", 1, HISTORY_CHARS))


def previous_user(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each message with the last thing the user said before it."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("previous_user", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))


def last_answers(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each conversation's last answer with the question before it."""
    with_question = previous_user(messages, conv, turn).filter("role = 'assistant'")
    last = F.max_by(F.struct(turn, "text", "previous_user"), turn)
    return with_question.groupBy(conv).agg(last.alias("m")).select(conv, F.col(f"m.{turn}").alias(turn), F.col("m.text").alias("answer"), F.col("m.previous_user").alias("question"))


def append_turn(messages: DataFrame, conv: int, question: str, answer: str) -> DataFrame:
    """A question and its answer after the conversation's last turn."""
    last = messages.filter(F.col("conv_id") == conv).agg(F.coalesce(F.max("turn"), F.lit(-1)).alias("t"))
    new = last.select(F.lit(conv).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(1).alias("d"), F.lit("user").alias("role"), F.lit(question).alias("text")), F.struct(F.lit(2).alias("d"), F.lit("assistant").alias("role"), F.lit(answer).alias("text")))).alias("m"), "t")
    return messages.select("conv_id", "turn", "role", "text").unionByName(new.select("conv_id", (F.col("t") + F.col("m.d")).alias("turn"), "m.role", "m.text"))


def read_chat(messages: DataFrame, conv: int) -> DataFrame:
    """A conversation in order; one that does not exist is an error."""
    rows = messages.filter(F.col("conv_id") == conv)
    if rows.isEmpty():
        raise KeyError(f"no conversation {conv}")
    return rows.orderBy("turn")


def delete_chats(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Messages of all conversations but those named in ``gone`` (conv_id)."""
    return messages.join(gone.select("conv_id").distinct(), "conv_id", "left_anti")


def admit_turns(requests: DataFrame, active: DataFrame) -> DataFrame:
    """Requests (conv_id, uses_history) with ``admitted``: turns of a conversation overlap only if none uses its history.

    ``active`` holds the turns being answered.
    """
    busy = active.groupBy("conv_id").agg(F.bool_or("uses_history").alias("_history"))
    both = requests.join(busy, "conv_id", "left")
    conflict = F.col("_history").isNotNull() & (F.col("uses_history") | F.col("_history"))
    return both.withColumn("admitted", ~conflict).drop("_history")


def resolve_hrefs(links: DataFrame, pages: DataFrame) -> DataFrame:
    """An href as a path in three forms, else as title or base name, pages of the same folder first."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    forms = F.array("href", F.concat(F.lit("wiki/"), F.col("href")), F.concat(F.lit("wiki/"), F.col("href"), F.lit(".md")))
    a = links.select("source", "href", F.posexplode(forms).alias("rank", "k"))
    exact = a.join(pages.select("path", F.col("path").alias("k")), "k").select("source", "href", "path", "rank")
    names = pages.select("path", F.explode(F.array_distinct(F.array(F.lower("title"), F.lower(F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "\\.md$", ""))))).alias("k"))
    # Of the pages of a name only the first of each folder, and the first of all, can be meant: a name that many pages share makes no pairs.
    inside = names.groupBy("k", folder(F.col("path")).alias("_folder")).agg(F.min("path").alias("_near"))
    every = inside.groupBy("k").agg(F.min("_near").alias("_any"))
    wanted = links.withColumn("k", F.lower("href")).withColumn("_folder", folder(F.col("source")))
    found = wanted.join(every, "k").join(inside, ["k", "_folder"], "left")
    named = found.select("source", "href", F.coalesce("_near", "_any").alias("path"), F.when(F.col("_near").isNotNull(), 3).otherwise(4).alias("rank"))
    return exact.unionByName(named).groupBy("source", "href").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def upload_sessions(declared: DataFrame, chunks: DataFrame) -> DataFrame:
    """Where each upload goes on - ``declared`` (upload_id, total) with the bytes received without a gap.

    A chunk counts from the first byte on as long as each begins where the last one ended; repeated chunks count once.
    """
    one = chunks.select("upload_id", "idx", "offset", "size").distinct()
    along = Window.partitionBy("upload_id").orderBy("idx")
    fits = (F.col("offset") == F.coalesce(F.lag(F.col("offset") + F.col("size")).over(along), F.lit(0))) & (F.col("idx") == F.row_number().over(along) - 1)
    got = one.withColumn("fits", fits.cast("int")).select("upload_id", "size", F.min("fits").over(along).alias("whole"))
    got = got.groupBy("upload_id").agg(F.sum(F.when(F.col("whole") == 1, F.col("size")).otherwise(0)).alias("received"))
    out = declared.join(got, "upload_id", "left").withColumn("received", F.coalesce("received", F.lit(0)).cast("long"))
    return out.withColumn("complete", F.col("received") == F.col("total"))


def chunks_in_order(chunks: DataFrame) -> DataFrame:
    """Uploads whose chunks (upload_id, idx, offset, size) follow each other without a gap."""
    along = Window.partitionBy("upload_id").orderBy("idx")
    ok = (F.col("offset") == F.coalesce(F.lag(F.col("offset") + F.col("size")).over(along), F.lit(0))) & (F.col("idx") == F.row_number().over(along) - 1)
    return chunks.withColumn("_ok", ok).groupBy("upload_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("size"), F.min("_ok").alias("complete"))
