"""Vocabulary fit and term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.operators.lookup import fits_broadcast, lookup_join
from factloom.operators.sentences import SENTENCE_KEY, counted_terms, enough
from factloom.staging import stage


def fit_vocabulary(
    terms: DataFrame,
    min_df: float = 3,
    vocab_size: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``(term, df, tf)`` of the terms found in at least ``min_df`` rows.

    ``terms`` is the output of :func:`marked_terms` or :func:`counted_terms`. The
    aggregate combines on the map side, so a term that is in every row arrives as
    one record per task. A
    ``min_df`` below 1 is a share of ``rows``, the number of sentences, which then
    has to be given. ``vocab_size`` keeps the most frequent terms, ties by name.
    """
    if min_df < 1:
        if rows is None:
            raise ValueError("a min_df below 1 needs the number of rows")
        min_df = min_df * rows
    if "is_first" in terms.columns:
        df, tf = F.sum(F.col("is_first").cast("long")), F.count(F.lit(1))
    else:
        df, tf = F.count(F.lit(1)), F.sum("n")
    vocabulary = (
        terms.groupBy("term").agg(df.alias("df"), tf.alias("tf")).filter(F.col("df") >= min_df)
    )
    if vocab_size is not None:
        # Not a sort with a limit: that would send this many rows of every partition
        # to one task.
        ranked = rank_vocabulary(vocabulary)
        vocabulary = ranked.filter(F.col("idx") < vocab_size).drop("idx")
    return vocabulary


def rank_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """Add ``idx``: position by total count, ties by name, starting at 0.

    Ranked without a one-task window: the table is range-partitioned in rank
    order and written, each row with its partition and its place in it. Only the
    partition sizes, one row each, are summed up in one place.
    """
    place = F.monotonically_increasing_id()
    placed = stage(
        vocabulary.orderBy(F.desc("tf"), "term").withColumn("_place", place), "vocabulary"
    ).select(
        "*",
        F.shiftright("_place", 33).alias("_part"),
        F.col("_place").bitwiseAND((1 << 33) - 1).alias("_row"),
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
    )
    # One row per partition of the sort: bounded by the shuffle partition count.
    return placed.join(F.broadcast(starts), "_part").select(
        *vocabulary.columns, (F.col("_start") + F.col("_row")).alias("idx")
    )


def term_counts(
    sentences: DataFrame,
    min_tf: float = 3,
    min_df: float = 3,
    vocab_size: int | None = None,
) -> DataFrame:
    """``(doc_id, sent_no, term, n)`` for vocabulary terms reaching ``min_tf``.

    With ``min_tf`` above 1 the pairs that pass it are few. They are written
    first, and only their terms need a document frequency at all, so the second
    pass over the sentences is cut down to those terms before it is grouped.
    """
    terms = counted_terms(sentences)
    rows = sentences.count() if min_df < 1 else None
    found = terms.filter(enough(F.col("n"), F.col("size"), min_tf)).drop("size")
    if vocab_size is None and min_tf > 1:
        found = stage(found, "frequent")
        wanted = found.select("term").distinct()
        terms = lookup_join(
            terms,
            wanted,
            ["term"],
            "left_semi",
            broadcast=fits_broadcast(wanted),
            spread_by=SENTENCE_KEY,
        )
    vocabulary = fit_vocabulary(terms, min_df, vocab_size, rows).select("term")
    vocabulary = stage(vocabulary, "vocabulary")
    return lookup_join(
        found,
        vocabulary,
        ["term"],
        "left_semi",
        broadcast=fits_broadcast(vocabulary),
        spread_by=SENTENCE_KEY,
    ).select(*SENTENCE_KEY, "term", "n")
