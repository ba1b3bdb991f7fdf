"""Names given as regular expressions: found in the text, labelled on the words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.binding import let

Patterns = Sequence[tuple[str, str]]


def find_phrases(text: Column, patterns: Patterns) -> Column:
    """``array<struct<phrase, tag>>``: the distinct matches of each pattern.

    ``patterns`` are (regular expression, tag) pairs. A match is always the whole
    match, also if the expression has groups. Matches come in the order of the
    patterns, and in text order within one.
    """

    def matches(pattern: str, tag: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        return F.transform(
            F.filter(found, lambda m: m != ""),
            lambda m: F.struct(m.alias("phrase"), F.lit(tag).alias("tag")),
        )

    return F.concat(*[matches(pattern, tag) for pattern, tag in patterns])


def phrase_iob(
    words: Column,
    phrases: Column,
    longest_first: bool = False,
    join_adjacent: bool = False,
) -> Column:
    """IOB labels of ``words``, from left to right.

    At each word the phrases that begin there are tried by number of words, from
    one to the longest of the sentence; a hit labels its words, which are then
    skipped. If two patterns gave the same phrase, the first one's tag counts. Two
    hits side by side are two chunks, unless ``join_adjacent``, where the second
    carries on the first.
    """
    listed = F.transform(
        phrases, lambda p, k: F.struct(p["phrase"].alias("phrase"), k.alias("k"), p["tag"].alias("tag"))
    )
    # A short list is looked through from its first pattern on, so it need not be sorted.
    ordered = F.when(F.size(phrases) <= _LOOKED_THROUGH, listed).otherwise(F.sort_array(listed))
    return let(
        F.struct(
            words.alias("words"),
            # Taken out once: each look at a field of an array of structs would copy it.
            ordered.alias("phrases"),
            ordered["phrase"].alias("texts"),
            # Null if they are many.
            F.when(F.size(phrases) <= _LOOKED_THROUGH, _beginnings(phrases["phrase"])).alias("begin"),
            # How many words the longest phrase has.
            (
                F.coalesce(
                    F.array_max(
                        F.transform(
                            phrases["phrase"],
                            lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))),
                        )
                    ),
                    F.lit(0),
                )
                + 1
            ).alias("longest"),
        ),
        lambda s: F.when(
            F.size(s["phrases"]) == 0, F.transform(s["words"], lambda w: F.lit("O"))
        ).otherwise(span_iob(s["words"], _candidates(s, longest_first), join_adjacent)),
    )


def span_iob(words: Column, candidates: Column, join_adjacent: bool = False) -> Column:
    """IOB labels of ``words`` from ``candidates``, from left to right.

    ``candidates`` has an element for each word: null, or the span that begins there,
    ``struct<at, until, tag>``. A span is taken unless one taken before it reaches
    into it. The cost is that of sorting the words, however many spans overlap.
    """
    return let(
        F.struct(words.alias("words"), candidates.alias("candidates")),
        lambda s: let(
            _chosen(s["candidates"]), lambda spans: _labels(s["words"], spans, join_adjacent)
        ),
    )


# Up to so many phrases a sentence's list of them is looked through, beyond it is bisected.
_LOOKED_THROUGH = 24


def _beginnings(texts: Column) -> Column:
    """The first 1, 2, … blank-separated words of each text, up to the whole of it."""

    def of(text: Column) -> Column:
        words = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
        return F.transform(
            F.sequence(F.lit(1), words), lambda n: F.call_function("substring_index", text, F.lit(" "), n)
        )

    return F.array_distinct(F.flatten(F.transform(texts, of)))


def _candidates(s: Column, longest_first: bool) -> Column:
    """``array<struct<at, until, tag>>``: for each word, the span tried first that hits, or null."""
    phrases, texts = s["phrases"], s["texts"]

    def bisected(gram: Column) -> Column:
        """The place of the first phrase that is not below ``gram``, from 0."""
        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(phrases) + 1)).cast("int"))

        def halve(state: Column, _: Column) -> Column:
            middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
            below = F.get(texts, middle) < gram
            return F.struct(
                F.when(below, middle + 1).otherwise(state["low"]).alias("low"),
                F.when(below, state["high"]).otherwise(middle).alias("high"),
            )

        start = F.struct(F.lit(0).alias("low"), F.size(phrases).alias("high"))
        return F.aggregate(
            steps,
            start,
            lambda state, step: F.when(state["low"] < state["high"], halve(state, step)).otherwise(state),
            lambda state: state["low"],
        )

    def place(gram: Column) -> Column:
        return F.when(
            F.size(phrases) <= _LOOKED_THROUGH, F.array_position(texts, gram).cast("int") - 1
        ).otherwise(let(gram, bisected))

    def span(word: Column, i: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.least(s["longest"], F.size(s["words"]) - i))
        if longest_first:
            lengths = F.reverse(lengths)

        def tried(n: Column) -> Column:
            gram = F.array_join(F.slice(s["words"], i + 1, n), " ")
            return let(
                gram,
                lambda g: let(
                    F.get(phrases, place(g)),
                    lambda found: F.when(
                        found["phrase"] == g,
                        F.struct(i.alias("at"), (i + n).alias("until"), found["tag"].alias("tag")),
                    ),
                ),
            )

        hits = F.filter(F.transform(lengths, tried), lambda h: h.isNotNull())
        # Most words begin no phrase, and need not be joined to those after them.
        return F.when(F.coalesce(F.exists(s["begin"], lambda b: b == word), F.lit(True)), F.get(hits, F.lit(0)))

    return F.transform(s["words"], span)


def _chosen(candidates: Column) -> Column:
    """Of each word's span or null, the spans met on the way from the first word.

    The way goes from a word to the end of its span, or to the next word. Jumps of 2, 4,
    8, … steps are made of jumps of half the length; from the longest jump down, the
    words half-way between those known to be on the way are put between them. (A fold
    that keeps a list of spans copies the list at each of them.)
    """

    def walked(spans: Column) -> Column:
        end = F.size(spans)
        step = F.transform(spans, lambda c, i: F.coalesce(c["until"], i + 1))
        levels = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(end + 1)).cast("int"), F.lit(1)))
        jumps = F.aggregate(
            levels,
            F.array(step),
            lambda held, level: F.concat(held, F.array(let(F.get(held, level - 1), twice))),
        )

        def between(way: Column, jump: Column) -> Column:
            both = F.flatten(F.transform(way, lambda at: F.array(at, F.get(jump, at))))
            return F.filter(both, lambda at: at < end)

        way = F.aggregate(F.reverse(jumps), F.array(F.lit(0)), between)
        return F.filter(F.transform(way, lambda at: F.get(spans, at)), lambda c: c.isNotNull())

    def twice(jump: Column) -> Column:
        return F.transform(jump, lambda to: F.coalesce(F.get(jump, to), to))

    def apart(spans: Column) -> Column:
        """Whether no span reaches into the next."""
        return F.forall(
            F.transform(spans, lambda c, k: F.coalesce(F.get(spans, k + 1)["at"] >= c["until"], F.lit(True))),
            lambda free: free,
        )

    return let(
        F.struct(candidates.alias("all"), F.filter(candidates, lambda c: c.isNotNull()).alias("some")),
        lambda s: F.when(apart(s["some"]), s["some"]).otherwise(walked(s["all"])),
    )


def _labels(words: Column, spans: Column, join_adjacent: bool) -> Column:
    """Spell the spans out as one label per word."""

    def span_labels(span: Column, k: Column) -> Column:
        until_before = F.coalesce(F.get(spans, k - 1)["until"], F.lit(0))
        outside = F.array_repeat(F.lit("O"), span["at"] - until_before)
        opening = F.lit("B-")
        if join_adjacent:
            touches = (k > 0) & (until_before == span["at"])
            opening = F.when(touches, F.lit("I-")).otherwise(opening)
        return F.concat(
            outside,
            F.array(F.concat(opening, span["tag"])),
            F.array_repeat(F.concat(F.lit("I-"), span["tag"]), span["until"] - span["at"] - 1),
        )

    last = F.coalesce(F.get(spans, F.size(spans) - 1)["until"], F.lit(0))
    return F.concat(
        F.flatten(F.transform(spans, span_labels)),
        F.array_repeat(F.lit("O"), F.size(words) - last),
    )
