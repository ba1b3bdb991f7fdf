"""Loading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name``.

    A table kept in fewer files than there are cores is spread out first, since
    a small file is one task's work; a table of many files is read as it lies.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the shape of articles: ``doc_id``, ``fulltext``, ``abstract``."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("fulltext"), F.lit("").alias("abstract"), "lang", "source"
    )
