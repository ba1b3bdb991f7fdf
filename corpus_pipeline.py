"""From raw documents to a training mix: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import read
from factloom.llm.line_frequency import apply_rules
from factloom.llm.mixing import mix
from factloom.llm.order_minhash import deduplicated
from factloom.llm.positional_index import marked
from factloom.llm.randomness import redacted, scan
from factloom.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of documents, with another text and its length."""
    return docs.withColumn("text", text).withColumn(
        "n_chars", F.length("text").cast("long")
    ).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that are frequent in their host are taken out."""
    return with_text(apply_rules(docs.select(*COLUMNS)).filter("kept"), F.col("cleaned"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return deduplicated(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    items = read(spark, sf_dir, "benchmark")
    return marked(docs.select(*COLUMNS), items).filter(F.size("hit_words") == 0).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; the documents stay."""
    return with_text(scan(docs.select(*COLUMNS)), redacted(F.col("text"), F.col("spans")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, repeats counted."""
    return mix(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicate),
    ("decontamination", benchmark),
    ("secrets", secrets),
    ("mixing", mixture),
]

# Alignment and the tests of randomness are not SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
