"""A gazetteer of many literal names, found on the words of sentences by joins.

Regular expressions cost a pass over the text for each. Names are looked up instead: an
index of the names by their first word says how long the names are that begin with it,
so only words that begin a name are followed any further, and only for those lengths.
The cost grows with the words and the hits, not with the number of names.

Names match whole words (those of ``tokenize_wordpunct``); an expression that matches
within words stays with ``find_phrases``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.gazetteer import span_iob
from factloom.functions.text import tokenize_wordpunct
from factloom.operators.lookup import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, fits_broadcast, lookup_join
from factloom.staging import stage

KEY = ["doc_id", "sent_no"]


def build_names(names: DataFrame) -> DataFrame:
    """``(phrase, first, n, tag)`` of a table of names (``name``, ``tag``), written once.

    ``phrase`` is the name's words joined by blanks. Names without a word are left out;
    of names with several tags the least one counts.
    """
    words = names.select(tokenize_wordpunct(F.col("name")).alias("_words"), "tag").filter("size(_words) > 0")
    spelled = words.select(F.array_join("_words", " ").alias("phrase"), "tag")
    # No word has a blank in it, so the rest is told by the phrase and need not be shuffled.
    once = spelled.groupBy("phrase").agg(F.min("tag").alias("tag"))
    blanks = F.length("phrase") - F.length(F.replace(F.col("phrase"), F.lit(" "), F.lit("")))
    first = F.substring_index("phrase", " ", 1)
    return stage(once.select("phrase", first.alias("first"), (blanks + 1).alias("n"), "tag"), "names")


def name_index(names: DataFrame) -> DataFrame:
    """``(first, lengths)``: how many words the names have that begin with ``first``, rising."""
    return names.groupBy("first").agg(F.array_sort(F.collect_set("n")).alias("lengths"))


def match_names(
    sentences: DataFrame,
    names: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``(doc_id, sent_no, at, n, phrase, tag)``: every occurrence of a name.

    ``names`` come from ``build_names``; ``at`` counts words from 0. Occurrences may
    overlap. A word carries only as many of its followers as the longest name has. Both
    lookups are broadcast if measured to be within the bounds; if not, the words are
    shuffled, those of very common words or phrases spread over parts. Of the names only
    phrases found common in a sample of the sentences are copied for that.
    """
    longest = names.agg(F.max("n")).first()[0] or 0
    index = stage(name_index(names), "name-index")
    small = fits_broadcast(index, max_rows, max_bytes)
    grams = _grams(sentences, index, longest, small)
    listed = names.select("phrase", "n", "tag")
    if fits_broadcast(names, max_rows, max_bytes):
        return grams.join(F.broadcast(listed), ["phrase", "n"]).select(*KEY, "at", "n", "phrase", "tag")
    some = _grams(sentences.sample(HOT_SHARE, seed=7), index, longest, small)
    return lookup_join(
        grams,
        listed,
        ["phrase", "n"],
        broadcast=False,
        spread_by=[*KEY, "at"],
        hot=stage(_most_common(some, ["phrase", "n"]), "hot"),
    ).select(*KEY, "at", "n", "phrase", "tag")


# Which phrases are spread over several tasks is found out from this share of the sentences.
HOT_SHARE = 0.01
HOT_KEYS = 1_000


def _most_common(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys with the most rows, ``HOT_KEYS`` at most, if there are ten rows or more."""
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 10")
    return counted.orderBy(F.desc("_n")).limit(HOT_KEYS).select(*key)


def _grams(sentences: DataFrame, index: DataFrame, longest: int, broadcast: bool) -> DataFrame:
    """``(doc_id, sent_no, at, n, phrase)``: words that may be a name, by its first word and length."""
    words = sentences.select(*KEY, tokenize_wordpunct(F.col("sentence")).alias("_words"))
    starts = words.select(*KEY, "_words", F.posexplode("_words").alias("at", "first")).select(
        *KEY, "at", "first", F.slice("_words", F.col("at") + 1, longest).alias("_next")
    )
    found = lookup_join(starts, index, ["first"], broadcast=broadcast, spread_by=[*KEY, "at"])
    lengths = F.filter("lengths", lambda n: n <= F.size("_next"))
    return found.select(*KEY, "at", "_next", F.explode(lengths).alias("n")).select(
        *KEY, "at", "n", F.array_join(F.slice("_next", F.lit(1), F.col("n")), " ").alias("phrase")
    )


def label_names(
    sentences: DataFrame,
    names: DataFrame,
    longest_first: bool = False,
    join_adjacent: bool = False,
    with_words: bool = True,
    **bounds: int,
) -> DataFrame:
    """``sentences`` with ``words`` and the ``iob`` labels of the names in them.

    With ``with_words=False`` only ``(doc_id, sent_no, iob)``: then the texts stay where they
    are, and only their numbers of words are shuffled.

    As with patterns, words are gone through from left to right, the shortest name that
    begins at a word is taken (the longest if ``longest_first``), and its words are
    skipped. Sentences without a name are labelled ``O``. One shuffle brings the hits of
    a sentence to it.
    """
    hits = match_names(sentences, names, **bounds).select(
        *KEY, "at", F.when(F.lit(longest_first), -F.col("n")).otherwise(F.col("n")).alias("_first"), "n", "tag"
    )
    # Of the names that begin at a word the first one is taken, before they are gathered; hits
    # placed by sentence are shuffled for neither of both.
    hits = hits.repartition(*KEY)
    taken = hits.groupBy(*KEY, "at").agg(F.min(F.struct("_first", "n", "tag")).alias("_name"))
    span = F.struct("at", (F.col("at") + F.col("_name.n")).alias("until"), F.col("_name.tag").alias("tag"))
    spans = taken.groupBy(*KEY).agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    words = tokenize_wordpunct(F.col("sentence"))
    if with_words:
        met = sentences.withColumn("words", words).join(spans, KEY, "left")
    else:
        # Labels depend on the number of words only, so a list of that length stands in.
        sized = sentences.select(*KEY, words.alias("words")).select(
            *KEY, F.when(F.col("words").isNotNull(), F.size("words")).alias("_size")
        )
        met = sized.join(spans, KEY, "left").withColumn("words", F.array_repeat(F.lit(""), F.col("_size")))
    words = met.withColumn("_spans", F.coalesce("_spans", F.array().cast(_SPANS)))
    labelled = words.withColumn("iob", span_iob(F.col("words"), _by_word(), join_adjacent))
    return labelled.drop("_spans") if with_words else labelled.select(*KEY, "iob")


_SPAN = "struct<at:int,until:int,tag:string>"
_SPANS = f"array<{_SPAN}>"


def _by_word() -> Column:
    """The spans in text order as an element for each word, the gaps filled up with nulls."""
    none = F.lit(None).cast(_SPAN)

    def after_gap(span: Column, k: Column) -> Column:
        before = F.coalesce(F.get("_spans", k - 1)["at"] + 1, F.lit(0))
        return F.concat(F.array_repeat(none, span["at"] - before), F.array(span))

    last = F.coalesce(F.get("_spans", F.size("_spans") - 1)["at"] + 1, F.lit(0))
    return F.concat(
        F.flatten(F.transform("_spans", after_gap)), F.array_repeat(none, F.size("words") - last)
    )
