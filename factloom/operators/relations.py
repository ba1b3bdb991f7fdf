"""Subject, filler, object: relations between neighbouring chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import chunks as C
from factloom.functions import gazetteer as G
from factloom.functions.binding import let
from factloom.functions.tags import rule_tags
from factloom.functions.text import tokenize_wordpunct
from factloom.operators.chunking import ChunkModel, chunk_features, tag_chunks
from factloom.operators.sentences import SENTENCE_KEY, explode_rows
from factloom.operators.tagging import gather_tokens


def with_chunks(tagged: DataFrame, show_tags: bool = True) -> DataFrame:
    """Add ``chunks`` to sentences that have ``words``, ``tags`` and ``iob``."""
    texts = C.tagged_words(F.col("words"), F.col("tags")) if show_tags else F.col("words")
    return tagged.withColumn("chunks", C.chunks(texts, F.col("iob")))


def chunk_rows(chunked: DataFrame) -> DataFrame:
    """``(doc_id, sent_no, chunk_no, label, text, gap_after)``."""
    rows = explode_rows(chunked, SENTENCE_KEY, F.col("chunks"), "_c")
    return rows.select(*SENTENCE_KEY, "_c.*")


def _related(require_following: bool = True, show_tags: bool = True):
    return C.sentence_relations(
        F.col("words"), F.col("tags"), F.col("iob"), require_following, show_tags
    )


def relation_rows(
    tagged: DataFrame, require_following: bool = True, show_tags: bool = True
) -> DataFrame:
    """``(doc_id, sent_no, chunk_no, subj, filler, obj)`` of labelled sentences."""
    rows = explode_rows(tagged, SENTENCE_KEY, _related(require_following, show_tags), "_r")
    return rows.select(*SENTENCE_KEY, "_r.*")


def sentence_triples(
    tagged: DataFrame,
    pattern: str | None = C.INTERACTION_PATTERN,
    keep: Sequence[str] = (),
    show_tags: bool = True,
) -> DataFrame:
    """``(doc_id, sent_no, keep…, triples)`` of labelled sentences, ``[]`` if there are none.

    Without a pattern all relations are kept.
    """
    related = _related(show_tags=show_tags)
    if pattern is not None:
        related = C.matching(related, pattern)
    return tagged.select(*SENTENCE_KEY, *keep, C.as_triples(related).alias("triples"))


def model_triples(
    tagged: DataFrame,
    model: ChunkModel,
    pattern: str | None = C.INTERACTION_PATTERN,
    keep: Sequence[str] = (),
    show_tags: bool = True,
    placed: bool = False,
) -> DataFrame:
    """``(doc_id, sent_no, keep…, triples)`` with chunks labelled by a trained model.

    ``tagged`` sentences have ``words`` and ``tags``. Unless they are ``placed`` by
    sentence already, like those of a dictionary match, their rows are spread once;
    features, labels and the gathering of the sentence work in place. Without a
    pattern all relations are kept.
    """
    labelled = tag_chunks(chunk_features(tagged, keep, placed), model)
    gathered = gather_tokens(labelled, ("word", "pos", "iob"))
    return sentence_triples(gathered, pattern, keep, show_tags)


def no_triples():
    """An empty list of triples."""
    return F.array().cast("array<struct<subj:string,filler:string,obj:string>>")


def capitalised_iob(words):
    """Labels that make each run of capitalised words one ``NE`` chunk."""
    return let(
        words,
        lambda w: F.transform(
            w,
            lambda word, i: F.when(~word.rlike(r"^\p{Lu}"), "O")
            .when((i > 0) & F.get(w, i - 1).rlike(r"^\p{Lu}"), "I-NE")
            .otherwise("B-NE"),
        ),
    )


def named_triples(sentences: DataFrame, tagger=rule_tags, iob=capitalised_iob) -> DataFrame:
    """``(doc_id, sent_no, triples)``: all relations between named entities.

    ``iob`` makes labels from the list of words; by default a run of capitalised
    words is one entity. No shuffle: each sentence is handled within its row.
    """
    words = sentences.withColumn("words", tokenize_wordpunct(F.col("sentence")))
    labelled = words.withColumn("tags", tagger(F.col("words"))).withColumn(
        "iob", iob(F.col("words"))
    )
    return sentence_triples(labelled, pattern=None)


def gazetteer_sentences(sentences: DataFrame, patterns: G.Patterns, **options) -> DataFrame:
    """Add ``words`` and the gazetteer's ``iob`` labels."""
    phrases = G.find_phrases(F.col("sentence"), patterns)
    return sentences.withColumn("words", tokenize_wordpunct(F.col("sentence"))).withColumn(
        "iob", let(phrases, lambda p: G.phrase_iob(F.col("words"), p, **options))
    )


def gazetteer_triples(
    sentences: DataFrame, patterns: G.Patterns, tagger=rule_tags, **options
) -> DataFrame:
    """``(doc_id, sent_no, triples)``: all relations between gazetteer names."""
    # A sentence without a name has no chunk, so it is not cut into words.
    named = sentences.withColumn("_phrases", G.find_phrases(F.col("sentence"), patterns))
    cut = tokenize_wordpunct(F.col("sentence"))
    none = F.array().cast("array<string>")
    words = F.when(F.size("_phrases") > 0, cut).otherwise(none)
    # Nor are its words labelled and tagged if fewer of them begin a name than a relation has chunks.
    begin = let(
        F.transform("_phrases", lambda p: F.substring_index(p["phrase"], " ", 1)),
        lambda firsts: F.size(F.filter("words", lambda word: F.exists(firsts, lambda f: f == word))),
    )
    iob = G.phrase_iob(F.col("words"), F.col("_phrases"), **options)
    labelled = named.withColumn("words", words).withColumn(
        "iob", F.when(begin >= C.CHUNKS_NEEDED, iob).otherwise(none)
    )
    tags = F.when(F.size("iob") > 0, tagger(F.col("words"))).otherwise(none)
    return sentence_triples(labelled.withColumn("tags", tags), pattern=None)
