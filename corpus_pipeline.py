"""A corpus pipeline over ``documents``: rules, near duplicates, benchmark passages, mixture, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as
the next stage's ``docs``.  All but the last return the columns of ``docs``.  The mixture repeats rows
that it takes more than once, so the last stage lists them as often.  Rows with null or empty text fail
the first stage.

The token files are the pipeline's product and stay when the session ends: in a new folder below
``spark.folioforge.output``, or the warehouse where that is not set, which is logged.  ``wavelet.files`` opens them.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import decontaminate, jaccard, mixing, quality, wavelet
from folioforge.llm.queries import table, tokenizer
from folioforge.llm.shared import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, hosts' rates included, do not reject."""
    return quality.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, Jaccard 0.8 or more), the one of the smallest doc_id."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.apply_mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids in the wavelet-matrix files."""
    files = wavelet.write(docs, tokenizer())
    logging.getLogger("folioforge").info("token files: %s", files.path)
    return wavelet.read(files, wavelet.crc32, "ids_crc32")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: Byte-pair encoding has no SQL form; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
