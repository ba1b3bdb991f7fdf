"""From articles to sentence rows, and from sentences to their terms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.binding import let
from factloom.functions.stopwords import ENGLISH

SENTENCE_KEY = ("doc_id", "sent_no")


def explode_column(df: DataFrame, column: str, output: str, position: str | None = None) -> DataFrame:
    """One row per element of ``column``; all other columns are kept."""
    return explode_rows(df, ["*"], F.col(column), output, position)


def explode_rows(
    df: DataFrame,
    keep: Sequence[str],
    array: Column,
    output: str,
    position: str | None = None,
) -> DataFrame:
    """``keep`` and one row per element of ``array``; an empty list gives no row.

    Written as an outer explode and a filter on the position. For a plain explode
    the optimizer adds a test that the list is not empty, and with a computed list
    it would compute the list twice, once for the test.
    """
    place = position or "_position"
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, output))
    rows = rows.filter(F.col(place).isNotNull())
    return rows if position else rows.drop(place)


def sentences_of(
    articles: DataFrame,
    text_columns: Sequence[str] = ("abstract", "fulltext"),
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """One row per sentence; the sentences of several texts are numbered on.

    An article without any sentence has no row.
    """
    listed = X.concat_lists(*[X.split_sentences(F.col(c)) for c in text_columns])
    return explode_rows(articles, keep, listed, "sentence", "sent_no")


def word_columns(
    sentences: DataFrame,
    sentence: str = "sentence",
    stopwords: Iterable[str] = ENGLISH,
    grams: Sequence[int] = (1, 2),
) -> DataFrame:
    """Add ``words``, ``filtered``, ``bigrams`` and ``raw_features``."""
    return (
        sentences.withColumn("words", X.tokenize_ws(F.col(sentence)))
        .withColumn("filtered", X.remove_stopwords(F.col("words"), stopwords, lowercased=True))
        .withColumn("bigrams", X.ngrams(F.col("filtered"), 2))
        .withColumn("raw_features", X.raw_features(F.col("filtered"), grams))
    )


def counted_terms(
    sentences: DataFrame,
    features: Column | None = None,
    keep: Sequence[str] = SENTENCE_KEY,
) -> DataFrame:
    """Rows ``(keep…, term, n, size)``: each distinct term of each sentence.

    ``size`` is the length of the sentence's whole feature list. Counts are made
    inside the row, so this is a projection and moves nothing.
    """
    if features is None:
        features = X.sentence_features(F.col("sentence"))
    counted = let(
        features,
        lambda f: F.struct(F.size(f).alias("size"), X.count_terms(f).alias("terms")),
    )
    # The list is put in a column of its own before the explode, which would
    # otherwise copy the whole list to each row it makes.
    lists = sentences.select(*keep, counted.alias("_counted")).select(
        *keep, "_counted.size", "_counted.terms"
    )
    return explode_rows(lists, [*keep, "size"], F.col("terms"), "_t").select(
        *keep, "_t.term", "_t.n", "size"
    )


def marked_terms(sentences: DataFrame, features: Column | None = None) -> DataFrame:
    """Rows ``(term, is_first)``: every occurrence, one of each sentence marked.

    Summing the marks of a term gives the number of sentences it is in.
    """
    if features is None:
        features = X.sentence_features(F.col("sentence"))
    lists = sentences.select(X.repeats_last(features).alias("_l")).select("_l.n", "_l.terms")
    rows = explode_rows(lists, ["n"], F.col("terms"), "term", "_place")
    return rows.select("term", (F.col("_place") < F.col("n")).alias("is_first"))


def enough(n: Column, size: Column | None, min_tf: float) -> Column:
    """``n`` reaches ``min_tf``, which is a share of the row's terms if below 1."""
    return n >= (size * min_tf if min_tf < 1 else F.lit(min_tf))
