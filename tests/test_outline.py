"""The analysis of a document under its own title, against SQL on texts that name nothing or have headings."""

import duckdb
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators.tables import dealt
from folioforge.plans.catalogue import QUERIES

ODD = (
    "| a line that does begin with a bar. And one more sentence, long enough.", "|\nA longer line of prose that follows it.", ".", "", " ", "!\n\nShort.", "deadbeef",
    "12", "page", "\nThe first line is empty, this one is not.", "## A heading of a few words\nA sentence that is long enough.", "# One heading of this text.\n\n# Another heading of it.\n\nPlain.",
    "document1\nhttps://example.com/a is where it was, and github com too. 0123456789abcdef01 was its name.", None,
)


def test_titles_stand_and_headings_are_sentences(spark, tmp_path):
    rows = [(i, x) for i, x in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    build, sql = QUERIES["offline_analysis"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = build(spark, str(tmp_path))
    want = con.sql(sql)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def test_first_sentences_are_those_of_the_whole_text(col):
    short = "No. " * 60
    texts = ["", "One sentence, long enough, without an end", short + "This comes after many short ones. So does this one here.", "A sentence of this text is here. " * 30, "x\ue0ff A sentence with the mark in it. And another, without it.\n\nThird one, long enough."]
    for most in (1, 5):
        assert col(lambda c: text.first_sentences(c, most), texts) == [x[:most] for x in col(text.sentences, texts)]


def test_first_paragraph_is_the_first_of_prose(col):
    texts = ["---\na: b\n---\n> quoted prose, with an end.\nmore prose here.", "```\ncode; code;\n```\n- prose in a list.", "# Heading\n\nno end in this block\n\nother block", "|", ""]
    assert col(lambda c: text.first_paragraph(c, 20), texts) == ["quoted prose, with a", "prose in a list.", "no end in this block", "|", ""]
    assert col(text.content_paragraphs, texts)[:2] == [["quoted prose, with an end.", "more prose here."], ["prose in a list."]]


def test_low_signal_is_stripped_in_any_case(col):
    texts = ["See HTTPS://x and https://y.z/a b", "GitHub, comma, COM and Gist", "0123456789ABCDEFa 0123456789abcdef_ 12", "nothing of it"]
    assert [x.split() for x in col(text.strip_low_signal, texts)] == [["See", "://x", "and", "b"], [",", "comma,", "and"], ["0123456789abcdef_", "12"], ["nothing", "of", "it"]]


def test_rows_of_one_task_are_dealt_out(spark):
    one, even = spark.range(0, 1000, 1, 1), spark.range(0, 1000, 1, 8)
    assert dealt(one).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and dealt(one).count() == 1000
    assert dealt(even) is even and dealt(spark.range(0)).count() == 0
    spread = dealt(one.select(F.lit(None).cast("long").alias("id"))).groupBy(F.spark_partition_id()).count()  # one key in all rows
    assert spread.count() == 4 * spark.sparkContext.defaultParallelism
