"""Building the dictionary and matching sentences against it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators.lookup import fits_broadcast, lookup_join
from factloom.operators.sentences import (
    SENTENCE_KEY,
    counted_terms,
    enough,
    explode_rows,
    marked_terms,
)
from factloom.operators.vocabulary import fit_vocabulary


def build_dictionary(
    entries: DataFrame,
    min_words: int = 2,
    max_words: int = 2,
    add_epithet: bool = True,
) -> DataFrame:
    """Distinct ``(entity, alias)`` rows, aliases trimmed and in lower case.

    Only entities of ``min_words`` to ``max_words`` blank-separated words count.
    If the first alias has two words, its second word becomes an alias too. An
    entity that is listed twice gets the aliases of both rows.
    """
    words = F.size(F.split("entity", " "))
    listed = F.split("aliases", ",")
    if add_epithet:
        first = F.split(F.trim(F.regexp_replace(listed[0], r"\s+", " ")), " ")
        epithet = F.when(F.size(first) == 2, F.array(first[1]))
        listed = F.concat(listed, F.coalesce(epithet, F.array().cast("array<string>")))
    return (
        entries.filter(words.between(min_words, max_words))
        .select("entity", F.explode(listed).alias("alias"))
        .select("entity", F.lower(F.trim("alias")).alias("alias"))
        .filter(F.col("alias") != "")
        .distinct()
    )


def dictionary_terms(dictionary: DataFrame) -> DataFrame:
    """The dictionary's aliases as one distinct ``term`` column."""
    return dictionary.select(F.col("alias").alias("term")).distinct()


def dictionary_vocabulary(
    sentences: DataFrame,
    dictionary: DataFrame,
    min_df: float = 3,
    rows: int | None = None,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """``(term, df, tf)`` of the vocabulary terms that are dictionary aliases.

    The dictionary is applied before the terms are grouped. The frequencies of
    the terms kept are the same as in the whole vocabulary. Where that was written
    already, ``vocabulary`` gives it, and the sentences are not counted again.
    """
    wanted = dictionary_terms(dictionary)
    if vocabulary is not None:
        known = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
        return vocabulary.join(known, "term", "left_semi")
    if fits_broadcast(wanted):
        terms = marked_terms(sentences).join(F.broadcast(wanted), "term", "left_semi")
    else:
        terms = lookup_join(
            counted_terms(sentences),
            wanted,
            ["term"],
            "left_semi",
            broadcast=False,
            spread_by=SENTENCE_KEY,
        )
    return fit_vocabulary(terms, min_df, rows=rows)


def match_dictionary(
    sentences: DataFrame,
    dictionary: DataFrame,
    *,
    min_tf: float = 3,
    min_df: float = 3,
    keep: Sequence[str] = (),
    rows: int | None = None,
    broadcast: bool | None = None,
) -> DataFrame:
    """Sentences with a dictionary term: keys, ``sentence``, ``keep``, ``matches``.

    ``matches`` is ``array<struct<term, n>>`` ordered by term, with the terms that
    reach ``min_tf`` in the sentence and occur in ``min_df`` sentences.

    The terms of each sentence are cut down to the dictionary, and what is left is
    gathered per sentence in one shuffle and counted there. Document frequencies
    and matches both read that shuffle, so texts are split only once, and the
    result stays partitioned by sentence for whatever follows.
    """
    wanted = dictionary_terms(dictionary)
    if broadcast is None:
        broadcast = fits_broadcast(wanted)
    if min_df < 1:
        if rows is None:
            raise ValueError("a min_df below 1 needs the number of rows")
        min_df = min_df * rows
    # The length of the feature list matters only where ``min_tf`` is a share of it.
    kept = F.struct(
        "sentence", *keep, *[F.size("_features").alias("_size")] * (min_tf < 1)
    ).alias("_kept")
    # Texts are too wide to go through a shuffle once per term.
    carried = ["_kept"] if broadcast else []
    listed = sentences.select(
        *SENTENCE_KEY, "sentence", *keep, X.sentence_features(F.col("sentence")).alias("_features")
    ).select(*SENTENCE_KEY, kept, "_features")
    terms = explode_rows(listed, [*SENTENCE_KEY, *carried], F.col("_features"), "term")
    found = lookup_join(
        terms, wanted, ["term"], "left_semi", broadcast=broadcast, spread_by=SENTENCE_KEY
    )
    gathered = found.groupBy(*SENTENCE_KEY).agg(
        *[F.first(c).alias(c) for c in carried], F.collect_list("term").alias("_found")
    )
    if not broadcast:
        gathered = gathered.join(listed.drop("_features"), list(SENTENCE_KEY))
    counted = explode_rows(
        gathered, [*SENTENCE_KEY, "_kept"], X.count_terms(F.col("_found")), "_t"
    ).select(*SENTENCE_KEY, "_kept", "_t.*")
    # Counting the carried struct, not rows, keeps the inputs of both readers the
    # same, so the planner reuses the shuffle for the second one.
    frequent = (
        counted.groupBy("term")
        .agg(F.count("_kept").alias("df"))
        .filter(F.col("df") >= min_df)
        .select("term")
    )
    size = F.col("_kept._size") if min_tf < 1 else None
    reaching = counted.filter(enough(F.col("n"), size, min_tf))
    # ``frequent`` holds dictionary terms only, so the dictionary's bound holds for it.
    matched = lookup_join(
        reaching, frequent, ["term"], "left_semi", broadcast=broadcast, spread_by=SENTENCE_KEY
    )
    return (
        matched.groupBy(*SENTENCE_KEY)
        .agg(
            F.first("_kept").alias("_kept"),
            F.sort_array(F.collect_list(F.struct("term", "n"))).alias("matches"),
        )
        .select(*SENTENCE_KEY, *[f"_kept.{c}" for c in ("sentence", *keep)], "matches")
    )


def entity_hits(matched: DataFrame) -> DataFrame:
    """The keys of the sentences that mention a dictionary term."""
    return matched.select(*SENTENCE_KEY)


def entity_map(matched: DataFrame) -> DataFrame:
    """Add ``entity_matches``, a map of alias to count, and ``entity_counts``.

    ``entity_counts`` is the number of different aliases, not the sum of counts.
    """
    as_ints = F.transform(
        "matches", lambda m: F.struct(m["term"].alias("term"), m["n"].cast("int").alias("n"))
    )
    return matched.withColumn("entity_matches", F.map_from_entries(as_ints)).withColumn(
        "entity_counts", F.size("matches")
    )


def matched_entities(matched: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(doc_id, sent_no, alias, n, entity)``: every taxon an alias may stand for.

    An alias shared by several taxa gives a row for each of them.
    """
    listed = explode_rows(matched, SENTENCE_KEY, F.col("matches"), "_m").select(
        *SENTENCE_KEY, F.col("_m.term").alias("alias"), F.col("_m.n").alias("n")
    )
    return lookup_join(
        listed,
        dictionary.select("alias", "entity"),
        ["alias"],
        broadcast=fits_broadcast(dictionary),
        spread_by=SENTENCE_KEY,
    ).select(*SENTENCE_KEY, "alias", "n", "entity")
