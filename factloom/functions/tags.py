"""Word classes from a word's form, for use where no tagged corpus is at hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.binding import let

DETERMINERS = "the le la les der die das el los las un une a".split()
PREPOSITIONS = "of in de to for by with on at mit von".split()
VERB_ENDINGS = "ing ed er en re ar".split()


def rule_tag(word: Column) -> Column:
    """``DT``, ``IN``, ``SYM`` (no letter), ``VB`` (by ending), else ``NN``."""
    return _lowered_tag(F.lower(word))


def _lowered_tag(lowered: Column) -> Column:
    """The tag of a word in lower case; of most words no pattern has to be searched for."""
    verb = F.lit(False)
    for ending in VERB_ENDINGS:
        verb = verb | lowered.endswith(ending)
    begins_with_letter = (lowered >= "a") & (lowered < "{")
    listed = F.when(lowered.isin(DETERMINERS), "DT").otherwise("IN")
    return (
        F.when(lowered.isin(DETERMINERS + PREPOSITIONS), listed)
        .when(~(begins_with_letter | lowered.rlike(r"\p{L}")), "SYM")
        .when(verb, "VB")
        .otherwise("NN")
    )


def rule_tags(words: Column) -> Column:
    """The rule's tag of each word of a list."""
    # In a list's lambda a column used twice is evaluated twice, so words are lowered first.
    return F.transform(F.transform(words, F.lower), _lowered_tag)


def context_tags(words: Column) -> Column:
    """The rule's tags, mended by their neighbours.

    A verb right after a determiner is a noun; a noun between a noun and a determiner is
    a verb. Neighbours are taken as the rule tags them.
    """

    def mended(tags: Column) -> Column:
        def one(tag: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(tags, i - 1))
            noun = (tag == "VB") & (before == "DT")
            verb = (tag == "NN") & (before == "NN") & (F.get(tags, i + 1) == "DT")
            return F.when(noun, "NN").when(verb, "VB").otherwise(tag)

        return F.transform(tags, one)

    return let(rule_tags(words), mended)


def verb_phrase_iob(tags: Column) -> Column:
    """IOB labels that make each run of ``VB`` one ``VP`` chunk."""
    return let(
        tags,
        lambda all_tags: F.transform(
            all_tags,
            lambda tag, i: F.when(tag != "VB", "O")
            .when((i > 0) & (F.get(all_tags, i - 1) == "VB"), "I-VP")
            .otherwise("B-VP"),
        ),
    )
