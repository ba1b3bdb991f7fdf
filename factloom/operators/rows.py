"""Row sets: one row per key, samples, thresholds, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_by_key(
    df: DataFrame,
    key: Column,
    order: Sequence[Column | str],
    keep_unkeyed: bool = True,
) -> DataFrame:
    """One row per key: the first by ``order``. Rows without a key all stay.

    An empty or null list counts as no key. The survivors are found by an
    aggregate that combines on the map side: however many copies a key has, one
    row per task is shuffled for it. (A window would bring all copies to one
    task.) ``keep_unkeyed=False`` also makes one row of all keys that are null and
    one of all that are empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = F.min_by(row, F.struct(*order)).alias("_row")
    keyed = df
    has_key = None
    if keep_unkeyed:
        has_key = key.isNotNull()
        if dict(df.select(key.alias("_key")).dtypes)["_key"].startswith("array"):
            has_key = has_key & (F.size(key) > 0)
        keyed = df.filter(has_key)
    single = keyed.groupBy(key.alias("_key")).agg(first).select("_row.*")
    if not keep_unkeyed:
        return single
    return single.unionByName(df.filter(~F.coalesce(has_key, F.lit(False))))


def with_doc_id(articles: DataFrame, key: str = "doi") -> DataFrame:
    """One row per ``key`` (an array), with a ``doc_id`` that is the same in every run.

    The id is a digest of the key; of rows that share one, the first by all columns
    stays. Rows without a key all stay: their id is a digest of all columns and the
    number of the copy, copies being counted before they are told apart.
    """
    columns = [F.col(f"`{c}`") for c in articles.columns]
    has_key = F.coalesce(F.size(key) > 0, F.lit(False))
    keyed = dedup_by_key(articles.filter(has_key), F.col(key), columns, keep_unkeyed=False)
    keyed = keyed.withColumn("doc_id", F.md5(F.to_json(key)))
    copies = articles.filter(~has_key).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    digest = F.md5(F.to_json(F.struct(*columns)))
    unkeyed = copies.select(
        *columns, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy")
    ).withColumn("doc_id", F.concat(digest, F.lit("-"), F.col("_copy").cast("string")))
    return keyed.unionByName(unkeyed.drop("_copy"))


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """A Bernoulli sample without replacement; depends on how the data lie."""
    return df.sample(False, fraction, seed)


def sample_by_hash(df: DataFrame, key: Column | str, fraction: float) -> DataFrame:
    """A sample that is the same however the data lie: the key's 32-bit hash is below the fraction."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(key.cast("string").cast("binary"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return df.filter(place < F.lit(fraction * 2**32))


def at_least(df: DataFrame, **minimums: int | None) -> DataFrame:
    """Rows where each named column reaches its minimum; None sets none."""
    for column, minimum in minimums.items():
        if minimum is not None:
            df = df.filter(F.col(column) >= minimum)
    return df


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns, in order."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
