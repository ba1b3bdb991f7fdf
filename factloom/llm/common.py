"""Small pieces that several operators of this package use."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.lookup import fits_broadcast, lookup_join
from factloom.staging import stage

# A lookup table is broadcast only after it was measured and found within both.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 24 * 1024 * 1024

# Between words, for most of the operators: ASCII white space.
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given table ``name``, split as Spark's reader splits it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_key(doc_id: Column, text: Column) -> Column:
    """A key of a row's id and text. Rows that repeat both share it, and so share results."""
    return F.unhex(
        F.md5(F.concat_ws("\n", F.coalesce(doc_id.cast("string"), F.lit("null")), text))
    )


def cut_words(text: Column, between: str = BETWEEN_WORDS) -> Column:
    """The words of a text, in order: the non-empty pieces left by the pattern ``between``.

    Extracting each match instead took eight times as long where it was measured.
    """
    return F.array_remove(F.split(text, between), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def small(lookup: DataFrame) -> bool:
    """Whether ``lookup`` may be broadcast, by its measured rows and bytes."""
    return fits_broadcast(lookup, BROADCAST_ROWS, BROADCAST_BYTES)


def joined(left: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a table that is read again to be measured, so it should be a written one."""
    return lookup_join(left, lookup, on, how, broadcast=small(lookup))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's place in ``order``, from 0, without a one-task window.

    The rows are range-partitioned in order and written with their place in the
    partition; only the sizes of the partitions are added up in one place.
    """
    placed = stage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), "_part").withColumn(name, place).drop(
        "_id", "_part", "_start"
    )
