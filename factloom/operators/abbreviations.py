"""Abbreviations learned from a corpus: words that a period belongs to.

A word is scored by how much likelier its periods are if nearly each of its occurrences
has one than if they come as often as after any word (Dunning's log-likelihood ratio).
Short words, words with periods inside and words hardly seen without one score higher
(Kiss and Strunk, 2006).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.sentences import explode_rows
from factloom.staging import stage

# Runs of letters, periods between them and one after them.
WORD = r"\p{L}+(?:\.\p{L}+)*\.?"
# Share of an abbreviation's occurrences that have their period.
ABBREVIATED = 0.99
MIN_SCORE = 0.3


def score_abbreviations(texts: DataFrame, text: str = "fulltext") -> DataFrame:
    """``(word, n_period, n_plain, score)`` of each lowercased word that a period follows.

    Null and empty texts have no words. Where nearly every word has a period, as in a list
    of abbreviations alone, nothing tells them apart and all scores are 0. One shuffle,
    combined before it.
    """
    listed = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)
    period = F.when(F.col("_word").endswith("."), 1).otherwise(0)
    counts = (
        explode_rows(texts, [], listed, "_word")
        .groupBy(F.rtrim("_word", F.lit(".")).alias("word"))
        .agg(F.sum(period).alias("n_period"), F.sum(1 - period).alias("n_plain"))
    )
    counts = stage(counts, "word-periods")
    share = counts.agg(F.sum("n_period") / F.sum(F.col("n_period") + F.col("n_plain"))).first()[0]
    found = counts.filter("n_period > 0")
    if share is None or share >= ABBREVIATED:
        return found.withColumn("score", F.lit(0.0))
    letters = F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    ratio = 2 * (
        F.col("n_period") * F.log(ABBREVIATED / F.lit(share))
        + F.col("n_plain") * F.log((1 - F.lit(ABBREVIATED)) / (1 - F.lit(share)))
    )
    inner = F.length("word") - letters + 1
    score = ratio * F.exp(-letters) * inner * F.pow(letters, -F.col("n_plain"))
    return found.withColumn("score", score)


def learned_abbreviations(
    scores: DataFrame, min_score: float = MIN_SCORE, most: int = 1_000
) -> list[str]:
    """The words that score ``min_score``, for the pattern that splits sentences.

    They become part of a pattern, so more than ``most`` are an error, not cut off.
    """
    words = [r["word"] for r in scores.filter(F.col("score") >= min_score).limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"more than {most} abbreviations; ask for a higher score")
    return sorted(words)
