"""Intermediate tables on shared storage.

A result that several later steps read is written once and read back. That cuts
its lineage, survives the loss of executors (unlike cached or locally
checkpointed blocks), and gives Spark the true size of the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Without it, a folder under the warehouse stands in where the session itself is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staging"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used, under the staging root."""
    return f"{staging_root(spark).rstrip('/')}/factloom-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a fresh path and return the table read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
