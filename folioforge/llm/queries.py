"""The operators of this subpackage as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import alignment, credentials, decontaminate, divergence, html_text, jaccard, language, lengths, mixing, phrases, quality, urls, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    found = decontaminate.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the wavelet-matrix files."""
    files = wavelet.write(table(spark, sf_dir, "documents"), tokenizer())
    return wavelet.read(files, wavelet.crc32, "ids_crc32")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned only from documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    marked = docs.select("doc_id", "text", language.held_out(F.col("doc_id")).alias("held_out"))
    return language.predict(marked, model, "doc_id", "held_out")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram of the encoded documents with its suffix sums."""
    return lengths.histogram(lengths.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer()))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and near-duplicate class of every document."""
    return jaccard.classes(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and host-aware verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document when all 200-byte strings that occur again are cut."""
    out = phrases.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.plan(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that set each source apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, scored by corpus-wide counts."""
    files = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_50k.tiktoken")
    return alignment.annotate(table(spark, sf_dir, "documents"), files)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base kinds, and bare values that one owner alone holds."""
    found = credentials.annotate(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"] != "owned")
    many = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        many("assign").alias("n_assign"),
        many("access").alias("n_access"),
        many("hex").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        "n_live",
        "n_example",
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_decontamination,
        op2_token_output,
        op3_language_id,
        op4_token_counts,
        op5_ngram_jaccard,
        op6_html_extraction,
        op7_url_filters,
        op8_quality_rules,
        op9_suffix_dedup,
        op10_mix_sources,
        op11_source_divergence,
        op12_tokenizer_alignment,
        op13_secret_scan,
    )
    return {f.__name__: f for f in ops}
