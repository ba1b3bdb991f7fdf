"""The whole analysis: articles and a dictionary in, interaction statements out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.chunks import INTERACTION_HINT, INTERACTION_PATTERN, as_lists
from factloom.functions.tags import rule_tags
from factloom.operators.chunking import ChunkModel
from factloom.operators.dictionary import build_dictionary, entity_map, match_dictionary
from factloom.operators.relations import model_triples, no_triples
from factloom.operators.rows import at_least, sample_rows, with_doc_id
from factloom.operators.sentences import SENTENCE_KEY, sentences_of
from factloom.operators.tagging import tag_sentences
from factloom.plans.counts import StageCounts, uncounted
from factloom.sources.articles import scan_json, write_json
from factloom.sources.dictionary import scan_dictionary


def extract_interactions(
    articles: DataFrame,
    dictionary: DataFrame,
    chunk_model: ChunkModel,
    *,
    min_tf: float = 3,
    min_df: float = 3,
    min_entities: int | None = 0,
    min_triples: int | None = 0,
    pattern: str = INTERACTION_PATTERN,
    hint: str | None = INTERACTION_HINT,
    tagger: Callable[[Column], Column] = rule_tags,
    sample: float | None = None,
    counts: StageCounts | None = None,
) -> DataFrame:
    """``(doc_id, sent_no, doi, sentences, entity_matches, entity_counts, triples,
    triples_counts)``; the last six are the result record.

    ``articles`` need a unique ``doc_id`` besides ``doi``, ``abstract`` and
    ``fulltext``; deduplicate them before. ``chunk_model`` comes from :func:`load_chunker`.

    Sentences without a dictionary term never reach the tagger, nor do those that
    miss ``min_entities`` or that lack ``hint``, a regular expression that any
    sentence with a matching filler must match. With a pattern or tagger of your own, give
    a hint, or None to tag every sentence left. All steps after the match work
    on the partitioning by sentence that the match has made.

    ``counts`` gets the rows of each stage as the result is run: articles, sentences,
    those with matches, those with enough entities, and interactions.
    """
    watched = counts.of if counts else uncounted
    own = pattern != INTERACTION_PATTERN or tagger is not rule_tags
    if own and hint == INTERACTION_HINT:
        hint = None
    if sample:
        articles = sample_rows(articles, sample)
    articles = watched("articles", articles.select("doc_id", "doi", "abstract", "fulltext"))
    sentences = watched("sentences", sentences_of(articles, keep=["doc_id", "doi"]))
    matched = match_dictionary(
        sentences, dictionary, min_tf=min_tf, min_df=min_df, keep=["doi"]
    )
    matched = watched("sentences with matches", matched)
    hits = at_least(entity_map(matched), entity_counts=min_entities)
    hits = watched("sentences with enough entities", hits)
    tells = F.lit(True) if hint is None else F.col("sentence").rlike(hint)
    carried = ["sentence", "doi", "entity_matches", "entity_counts"]
    tagged = tag_sentences(hits.filter(tells), tagger)
    found = model_triples(tagged, chunk_model, pattern, keep=carried, placed=True)
    if (min_triples or 0) > 0:
        found = found.filter(F.size("triples") >= min_triples)
    elif hint is not None:
        rest = hits.filter(~tells).select(*SENTENCE_KEY, *carried)
        found = found.unionByName(rest.withColumn("triples", no_triples()))
    found = watched("interactions", found)
    return found.select(
        *SENTENCE_KEY,
        "doi",
        F.col("sentence").alias("sentences"),
        "entity_matches",
        "entity_counts",
        as_lists(F.col("triples")).alias("triples"),
        F.size("triples").alias("triples_counts"),
    )


RESULT = ("doi", "sentences", "entity_matches", "entity_counts", "triples", "triples_counts")


def result_records(found: DataFrame) -> DataFrame:
    """The six columns of the result record."""
    return found.select(*RESULT)


def run_interactions(
    spark: SparkSession,
    articles: str,
    dictionary: str,
    output: str,
    chunk_model: ChunkModel,
    compression: str | None = None,
    **options,
) -> None:
    """From JSON articles and a dictionary file to result records as JSON at ``output``.

    Articles are made one per ``doi`` first. Fails if ``output`` exists; ``options`` are
    those of :func:`extract_interactions`.
    """
    found = extract_interactions(
        with_doc_id(scan_json(spark, articles)),
        build_dictionary(scan_dictionary(spark, dictionary)),
        chunk_model,
        **options,
    )
    write_json(result_records(found), output, compression)
