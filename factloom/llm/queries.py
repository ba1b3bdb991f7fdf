"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.collocations import collocations
from factloom.llm.common import ascii_lower, read
from factloom.llm.exact_substrings import deduplicate_substrings
from factloom.llm.language_id import identify_languages
from factloom.llm.license_scan import scan_licences
from factloom.llm.line_frequency import apply_rules
from factloom.llm.merkle import verified
from factloom.llm.mixing import mix
from factloom.llm.ngram_join import joined_documents
from factloom.llm.order_minhash import near_duplicates
from factloom.llm.positional_index import decontaminate
from factloom.llm.quotations import as_mail, link_quotations
from factloom.llm.randomness import find_secrets
from factloom.llm.token_counts import count_tokens


def vocabulary() -> str:
    """Where the vocabulary of the registered token counts lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), vocabulary())


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(as_mail(read(spark, sf_dir, "conversations")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_substrings(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_words_left",
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    text = F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return verified(read(spark, sf_dir, "documents"), {"text": text})


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_documents(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_chat_formatting,
        op3_substring_dedup,
        op4_language_id,
        op5_mixing,
        op6_quality_rules,
        op7_decontamination,
        op8_near_duplicates,
        op9_secret_scans,
        op10_license_scans,
        op11_collocations,
        op12_merkle_manifest,
        op13_jaccard_join,
    )
}
