"""Benchmark decontamination with a distributed positional inverted index.

The index stores the postings (document, position) of every term that the test items
use. A window of an item's words is looked up by its rarest term: each posting, less
the term's place in the item, is an alignment of item and document. The postings of
the second rarest term, adjusted the same way, are intersected with these. What is
left is compared word by word, which gives exact phrase matches; with a slop above 0
the second term may stand nearer or farther, which gives proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.llm.common import ascii_lower, cut_words, document_key, joined, small
from factloom.staging import stage

BETWEEN_TERMS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, ASCII letters in lower case; none for null."""
    return cut_words(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_TERMS)


def prepared_items(items: DataFrame) -> DataFrame:
    """``(_item, item_id, _words)`` of the items that have words; repeated rows are one."""
    return (
        items.select(
            document_key(F.col("item_id"), F.col("text")).alias("_item"),
            F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
            words(F.col("text")).alias("_words"),
        )
        .filter(F.size("_words") > 0)
        .dropDuplicates(["_item"])
    )


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(_key, _at, term)``: where in the documents the ``terms`` stand, as a stored table."""
    # The key digests a whole text, so it is made before the words are rows, not for each.
    keyed = docs.select(
        document_key(F.col("doc_id"), F.col("text")).alias("_key"),
        words(F.col("text")).alias("_words"),
    )
    postings = keyed.select("_key", F.posexplode("_words").alias("_at", "term"))
    return stage(joined(postings, terms, ["term"]), "postings")


def windows(items: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """The windows of ``n`` words, with their two rarest places.

    ``(_item, _start, _length, _first, _second, _first_term, _second_term)``; an item of
    fewer words is one window; of one word, the second place is the first. A window with
    a term that no document has is left out, and of windows of an item with the same words
    only the first is kept: it is found wherever the others are, and an item that repeats a
    word is not aligned with each place of the word once for each of its windows.
    """
    counts = stage(index.groupBy("term").agg(F.count(F.lit(1)).alias("_n")), "term_counts")
    placed = items.select("_item", F.posexplode("_words").alias("_at", "term"))
    known = joined(placed, counts, ["term"], "left")
    rows = known.groupBy("_item").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_n", "term"))).alias("_places"),
    )
    places = F.transform("_places", lambda p: F.struct(p["_n"], p["_at"], p["term"]))
    size = F.size("_places")
    rows = rows.select("_item", F.least(F.lit(n), size).alias("_length"), places.alias("_places"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), size - F.col("_length"))).alias("_start"))
    part = F.slice("_places", F.col("_start") + 1, F.col("_length"))
    content = F.sha2(F.array_join(F.transform(part, lambda p: p["term"]), " "), 256)
    rows = rows.select("_item", content.alias("_content"), F.struct("_start", "_length", F.array_sort(part).alias("_part")).alias("_w"))
    rows = rows.filter(~F.exists("_w._part", lambda p: p["_n"].isNull()))
    rows = rows.groupBy("_item", "_content").agg(F.min("_w").alias("_w")).select("_item", "_w.*")
    first, second = F.get("_part", F.lit(0)), F.coalesce(F.get("_part", F.lit(1)), F.get("_part", F.lit(0)))
    return rows.select(
        "_item", "_start", "_length",
        first["_at"].alias("_first"), first["term"].alias("_first_term"),
        second["_at"].alias("_second"), second["term"].alias("_second_term"),
    )


def intersected(index: DataFrame, wanted: DataFrame, slop: int) -> DataFrame:
    """``(_key, _item, _start, _length, _shift, _off)``: alignments of windows and documents.

    ``_shift`` is the place of the item's first word in the document; ``_off`` is how
    many words the second rarest term stands from where it is in the item.
    """
    anchors = wanted.groupBy(F.col("_first_term").alias("term"), "_item", "_first").agg(
        F.collect_set(F.struct("_start", "_length", "_second", "_second_term")).alias("_windows")
    )
    aligned = joined(index, stage(anchors, "anchors"), ["term"]).select(
        "_key", "_item", (F.col("_at") - F.col("_first")).alias("_shift"), F.explode("_windows").alias("_w")
    )
    aligned = aligned.select("_key", "_item", "_shift", "_w.*").filter("_shift + _start >= 0")
    expected = aligned.groupBy(
        "_key",
        F.col("_second_term").alias("term"),
        (F.col("_shift") + F.col("_second")).alias("_expected"),
    ).agg(F.collect_set(F.struct("_item", "_shift", "_start", "_length")).alias("_found"))
    off = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    expected = expected.withColumn("_off", off) if slop else expected.withColumn("_off", F.lit(0))
    expected = expected.withColumn("_at", F.col("_expected") + F.col("_off")).drop("_expected")
    expected = stage(expected, "expected")
    # No key holds more than the alignments of one place, so nothing needs salting.
    listed = F.broadcast(expected) if small(expected.drop("_found")) and small(expected) else expected
    both = index.join(listed, ["_key", "term", "_at"])
    return both.select("_key", "_off", F.explode("_found").alias("_f")).select("_key", "_off", "_f.*")


def alignments(
    docs: DataFrame, items: DataFrame, n: int, slop: int
) -> tuple[DataFrame, DataFrame]:
    """The table of :func:`intersected`, and :func:`prepared_items`, both written."""
    items = stage(prepared_items(items), "items")
    terms = stage(items.select(F.explode("_words").alias("term")).distinct(), "terms")
    index = build_index(docs, terms)
    found = intersected(index, stage(windows(items, index, n), "windows"), slop)
    return stage(found, "matches"), items


def matches(docs: DataFrame, items: DataFrame, n: int = 10, slop: int = 0) -> DataFrame:
    """Candidate matches of the items' windows of ``n`` words in the documents.

    The alignments of :func:`intersected`, with ``item_id`` and ``_words`` of the item.
    Rows with ``_off = 0`` may be exact phrases (:func:`marked` compares all words); all
    rows are proximity matches: the two rarest terms of the window stand in the document
    as far apart as in the item, up to ``slop`` words more or less.
    """
    found, items = alignments(docs, items, n, slop)
    return joined(found, items, ["_item"])


def marked(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` with the words that are in any window of an item.

    Adds ``n_words``, ``hit_words`` (positions of the words hit, ascending) and
    ``hit_items`` (ids of the items with a window in the document, sorted as strings).
    Null and empty texts have no words and no hits; an item without words has no
    window; a null item_id counts as the id ``null``; items with one id are one item;
    repeated documents and items give no more than one of them; other columns are
    passed on; an empty table on either side gives no hits.
    """
    found, items = alignments(docs, items, n, 0)
    # An item's words go with its document once, not with each place.
    places = found.groupBy("_key", "_item").agg(
        F.collect_set(F.struct("_shift", "_start", "_length")).alias("_places")
    )
    found = stage(
        joined(places, items, ["_item"]).groupBy("_key").agg(
            F.collect_list(F.struct("item_id", "_words", "_places")).alias("_aligned")
        ),
        "aligned",
    )
    # The row's own columns are kept apart, whatever their names.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        document_key(F.col("doc_id"), F.col("text")).alias("_key"),
    )
    rows = rows.join(F.broadcast(found) if small(found) else found, "_key", "left")

    def exact(held: Column) -> Column:
        def equal(a: Column, place: Column) -> Column:
            # Word by word: a slice would copy all words of the document first.
            return F.forall(
                F.sequence(place["_start"], place["_start"] + place["_length"] - 1),
                lambda k: F.coalesce(F.get(held, place["_shift"] + k) == F.get(a["_words"], k), F.lit(False)),
            )

        def compared(a: Column) -> Column:
            return F.struct(
                a["item_id"].alias("item_id"),
                F.transform(
                    F.filter(a["_places"], lambda place: equal(a, place)),
                    lambda p: F.sequence(p["_shift"] + p["_start"], p["_shift"] + p["_start"] + p["_length"] - 1),
                ).alias("spans"),
            )

        aligned = F.coalesce(F.col("_aligned"), F.array().cast(found.schema["_aligned"].dataType))
        occurring = F.filter(F.transform(aligned, compared), lambda o: F.size(o["spans"]) > 0)
        return let(
            occurring,
            lambda o: F.struct(
                F.size(held).cast("long").alias("n_words"),
                F.sort_array(F.array_distinct(F.flatten(F.flatten(F.transform(o, lambda x: x["spans"]))))).alias("hit_words"),
                F.array_sort(F.array_distinct(F.transform(o, lambda x: x["item_id"]))).alias("hit_items"),
            ),
        )

    rows = rows.withColumn("_hits", let(words(F.col("_row.text")), exact))
    names = ("n_words", "hit_words", "hit_items")
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in names]
    return rows.select(*kept, *[F.col(f"_hits.{name}") for name in names])


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """One row per document: counts of words hit and of items, digest of the item ids."""
    n_hit = F.size("hit_words").cast("long")
    return marked(docs.select("doc_id", "text"), items.select("item_id", "text"), n).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
