"""Capitals that mean something: how words are written away from the start of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.functions.tags import rule_tags
from factloom.functions.text import tokenize_wordpunct
from factloom.operators.lookup import fits_broadcast, lookup_join
from factloom.operators.relations import sentence_triples
from factloom.operators.sentences import SENTENCE_KEY, explode_rows

CAPITAL = r"^\p{Lu}"


def first_word(words: Column) -> Column:
    """Where a sentence's first word with a letter stands, from 0; -1 if none has one."""
    return F.array_position(F.transform(words, lambda w: w.rlike(r"\p{L}")), True) - 1


def learn_casing(sentences: DataFrame, sentence: str = "sentence") -> DataFrame:
    """``(word, n_capital, n_small)``: lowercased words by their first letter's case.

    Words that begin a sentence are left out. Words that begin with neither a capital
    nor a small letter are not counted. One shuffle, combined before it.
    """
    later = let(
        tokenize_wordpunct(F.col(sentence)),
        lambda words: let(
            first_word(words), lambda first: F.filter(words, lambda w, i: (i > first) & (first >= 0))
        ),
    )
    words = explode_rows(sentences, [], later, "_word").filter(F.col("_word").rlike(r"^[\p{Lu}\p{Ll}]"))
    capital = F.when(F.col("_word").rlike(CAPITAL), 1).otherwise(0)
    return words.groupBy(F.lower("_word").alias("word")).agg(
        F.sum(capital).alias("n_capital"), F.sum(1 - capital).alias("n_small")
    )


def usual_capitals(casing: DataFrame) -> DataFrame:
    """``(word)``: what is capitalised more often than not."""
    return casing.filter("n_capital > n_small").select("word")


def cased_triples(
    sentences: DataFrame, casing: DataFrame, tagger=rule_tags, sentence: str = "sentence"
) -> DataFrame:
    """``(doc_id, sent_no, triples)``: all relations between named entities.

    A run of capitalised words is one entity. A sentence's first word belongs to one only if
    ``casing``, which should be a written table, has it capitalised more often than not; a
    word that is never seen later in a sentence does not. One row per sentence looks its
    first word up; a word that begins a third of all sentences is spread over several parts
    if the table is too large to be broadcast.
    """
    capitals = usual_capitals(casing).select(F.col("word").alias("_known"), F.lit(True).alias("_usual"))
    rows = sentences.withColumn("words", tokenize_wordpunct(F.col(sentence)))
    rows = rows.withColumn("_first", first_word(F.col("words")))
    rows = rows.withColumn("_known", F.when(F.col("_first") >= 0, F.lower(F.get("words", F.col("_first").cast("int")))))
    rows = lookup_join(
        rows, capitals, ["_known"], "left", broadcast=fits_broadcast(capitals), spread_by=SENTENCE_KEY
    )
    named = F.transform(
        "words",
        lambda w, i: w.rlike(CAPITAL) & ((i != F.col("_first")) | F.coalesce(F.col("_usual"), F.lit(False))),
    )
    iob = let(
        named,
        lambda flags: F.transform(
            flags,
            lambda named, i: F.when(~named, "O").when((i > 0) & F.get(flags, i - 1), "I-NE").otherwise("B-NE"),
        ),
    )
    labelled = rows.withColumn("tags", tagger(F.col("words"))).withColumn("iob", iob)
    return sentence_triples(labelled, pattern=None)
