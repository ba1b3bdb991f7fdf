"""The dictionary file: ``entity;alias,alias``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.schema import DICTIONARY


def scan_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(entity, aliases)`` of a ``;``-separated, ``"``-quoted file."""
    return spark.read.schema(DICTIONARY).csv(
        path, sep=";", quote='"', escape='"', ignoreLeadingWhiteSpace=False
    )
