"""Quality rules with the frequency of lines across the documents of a host.

A line that many different documents of one host share is boilerplate. Lines are
normalised and hashed, the distinct documents of each (host, line) are counted, lines
above the limit are removed, and a document that has too little left is rejected,
as are documents that fail the rules on the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.llm.common import cut_words, joined
from factloom.operators.lookup import lookup_join
from factloom.staging import stage

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Parts that the rows of one text are spread over.
COPIES = 8


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))


def normalised(line: Column) -> Column:
    """Lower case, digits alike, single blanks, none at the ends."""
    # Most lines have neither digits nor odd blanks, and a test is cheaper than a change.
    alike = F.when(F.rlike(line, F.lit("[0-9]")), F.regexp_replace(line, "[0-9]", "0")).otherwise(line)
    odd = F.rlike(line, F.lit(r"[\x09-\x0D]|\x20\x20"))
    return F.lower(F.trim(F.when(odd, F.regexp_replace(alike, r"[\x20\x09-\x0D]+", " ")).otherwise(alike)))


def word_count(text: Column) -> Column:
    return F.size(cut_words(text)).cast("long")


def repeated_words(held: Column) -> Column:
    """Of an array of words, the number in five-word windows that occur twice or more."""

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
            let(F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k")))), of_sorted)
        )

    def of_sorted(pairs: Column) -> Column:
        def twice(pair: Column, k: Column) -> Column:
            return (pair["h"] == F.get(pairs, k - 1)["h"]) | (pair["h"] == F.get(pairs, k + 1)["h"])

        starts = F.transform(F.filter(pairs, twice), lambda pair: pair["k"])
        return let(F.array_sort(starts), covered)

    def covered(starts: Column) -> Column:
        # From each start up to the next one, a whole window at most.
        step = F.transform(
            starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)))
        )
        return F.aggregate(step, F.lit(0), lambda total, n: total + n)

    hashed = F.transform(
        F.sequence(F.lit(0), F.size(held) - WINDOW),
        lambda k: F.xxhash64(*[F.get(held, k + j) for j in range(WINDOW)]),
    )
    return F.when(F.size(held) < WINDOW, 0).otherwise(let(hashed, of_windows))


def measured(text: Column) -> Column:
    """Struct of the counts of a text that the rules look at, as long."""
    symbols = F.when(
        F.rlike(text, F.lit(f"[{SYMBOLS}]")), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    ).otherwise(0)
    repeated_lines = let(lines(text), lambda held: F.size(held) - F.size(F.array_distinct(held)))

    def counts(words: Column) -> Column:
        columns = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": symbols,
            "n_dup_lines": repeated_lines,
            "n_repeat_words": repeated_words(words),
        }
        return F.struct(*[value.cast("long").alias(name) for name, value in columns.items()])

    return let(cut_words(text), counts)


def host(source: Column) -> Column:
    """A host's hash; 0 for documents without one, which count as one host."""
    return F.when(source.isNull(), F.lit(0)).otherwise(F.xxhash64(source))


def text_key(source: Column, text: Column) -> Column:
    """A key of a text within its host."""
    return F.unhex(F.md5(F.concat(host(source).cast("string"), F.lit("\n"), text)))


def line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda line: F.xxhash64(normalised(line)))


def frequent_lines(docs: DataFrame, limit: int) -> DataFrame:
    """``(_key, _frequent)``: of each text that has any, the hashes of the lines that more
    than ``limit`` different documents of its host have.

    Documents are counted by their text: copies of one text are one document, so that
    copying alone makes no line frequent. The limit is the same for hosts of any size,
    so a host may have any number of such lines: they meet the lines of the texts in a
    join, and only those of one text are ever gathered.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select(
        host(F.col("source")).alias("_host"),
        text_key(F.col("source"), text).alias("_key"),
        F.explode(F.array_distinct(line_hashes(text))).alias("_line"),
    ).filter(F.col("_line") != F.xxhash64(F.lit("")))
    found = stage(found.distinct(), "lines")
    counts = found.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs"))
    over = stage(counts.filter(F.col("_docs") > limit).drop("_docs"), "frequent")
    held = joined(found, over, ["_host", "_line"])
    return held.groupBy("_key").agg(F.sort_array(F.collect_list("_line")).alias("_frequent"))


def apply_rules(
    docs: DataFrame,
    limit: int = 20,
    min_words: int = 10,
    min_left: float = 0.3,
) -> DataFrame:
    """``docs`` with the counts of the rules, ``base_failed``, ``n_words_left``,
    ``kept`` and ``cleaned`` (the text without its host's frequent lines).

    A line is frequent if more than ``limit`` different documents of its host have it.
    A document is kept if it passes the base rules and at least ``min_words`` words and
    the share ``min_left`` of its words are left. Null texts count as empty, and fail;
    documents without a source are one host; repeated rows are judged alike; other
    columns are passed on, whatever their names (the operator's own names above replace
    equal ones); an empty table gives an empty result.
    """
    limits = stage(frequent_lines(docs.select("source", "text"), limit), "limits")
    # The caller's columns travel in one, so that no name of theirs meets one of these.
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"))
    rows = rows.withColumn("_key", text_key(F.col("_row.source"), text))
    # The same way at every size; copies of one text are spread by their id.
    rows = rows.withColumn("_id", F.xxhash64("_row.doc_id"))
    rows = lookup_join(rows, limits, ["_key"], "left", broadcast=False, spread_by=["_id"], salts=COPIES)
    kept_lines = F.filter(
        F.split(text, "\n", -1), lambda x: ~F.array_contains("_frequent", F.xxhash64(normalised(x)))
    )
    cleaned = F.when(F.col("_frequent").isNull(), text).otherwise(F.array_join(kept_lines, "\n"))
    rows = rows.select(
        "_row", measured(text).alias("_m"), F.when(F.col("_row.text").isNotNull(), cleaned).alias("cleaned")
    )
    n_words = F.col("_m.n_words")
    same = F.length(F.coalesce("cleaned", F.lit(""))) == F.length(text)
    left = F.when(same, n_words).otherwise(word_count(F.coalesce("cleaned", F.lit(""))))
    rows = rows.withColumn("_left", left).withColumn(
        "_failed", (n_words < 10) | (100 * F.col("_m.n_repeat_words") > 20 * n_words)
    )
    depleted = (F.col("_left") < min_words) | (F.col("_left") < min_left * n_words)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    made = {name: F.col("_m")[name] for name in names} | {
        "cleaned": F.col("cleaned"),
        "n_words_left": F.col("_left"),
        "base_failed": F.col("_failed"),
        "kept": ~F.col("_failed") & ~depleted,
    }
    passed = [F.col("_row")[name].alias(name) for name in docs.columns if name not in made]
    return rows.select(*passed, *[value.alias(name) for name, value in made.items()])
