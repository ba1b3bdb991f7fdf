"""What surrounds each tag of a sentence: neighbours, and tags since a determiner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.binding import let

START, END = "<START>", "<END>"


def previous(tags: Column, start: str = START) -> Column:
    """The tag before each tag."""
    return F.slice(F.concat(F.array(F.lit(start)), tags), 1, F.size(tags))


def following(tags: Column, end: str = END) -> Column:
    """The tag after each tag."""
    return F.slice(F.concat(tags, F.array(F.lit(end))), 2, F.size(tags))


def tags_since(tags: Column, mark: str = "DT") -> Column:
    """For each word, the sorted set of tags after the last ``mark`` before it, joined by ``+``.

    The sentence is cut into stretches that end with a ``mark``. Within one, the set
    grows only at the first occurrence of a tag, so each set is made once and
    repeated up to the word where the next tag comes in. Costs the sentence's length
    times the number of different tags.
    """

    def stretch_sets(stretch: Column) -> Column:
        # Different tags in the order of their first occurrence.
        return let(
            F.array_distinct(stretch),
            lambda tags_in: let(
                F.transform(tags_in, lambda tag: first_place(stretch, tag)),
                lambda places: sets_of(stretch, tags_in, places),
            ),
        )

    def first_place(stretch: Column, tag: Column) -> Column:
        # array_position leaves its loop by an exception, which costs more than going on.
        return F.array_min(F.transform(stretch, lambda other, i: F.when(other == tag, i)))

    def sets_of(stretch: Column, tags_in: Column, places: Column) -> Column:
        def repeated(place: Column, j: Column) -> Column:
            until = F.coalesce(F.get(places, j + 1), F.size(stretch) - 1)
            return F.array_repeat(
                F.array_join(F.sort_array(F.slice(tags_in, 1, j + 1)), "+"), until - place
            )

        return F.when(F.size(stretch) == 0, F.array().cast("array<string>")).otherwise(
            F.concat(F.array(F.lit("")), F.flatten(F.transform(places, repeated)))
        )

    def in_sentence(all_tags: Column) -> Column:
        after_marks = F.filter(
            F.transform(all_tags, lambda tag, i: F.when(tag == mark, i + 1)),
            lambda i: i.isNotNull(),
        )
        return let(
            F.concat(F.array(F.lit(0)), after_marks),
            lambda starts: F.flatten(
                F.transform(
                    starts,
                    lambda at, k: let(
                        F.slice(
                            all_tags, at + 1, F.coalesce(F.get(starts, k + 1), F.size(all_tags)) - at
                        ),
                        stretch_sets,
                    ),
                )
            ),
        )

    return let(tags, in_sentence)


# What is put before and after each tag before tags are replaced by one letter each.
_OPEN, _CLOSE = "\x01", "\x02"
_FIRST_LETTER, _LETTERS = ord("!"), 94
# Letters are looked for from the start of a sentence, which a very long one has done in lists.
LONGEST_CODE = 1_000


def code_letters(known: Sequence[str]) -> dict[str, str]:
    """A letter for each of the tags ``known``, in their order; none if they are too many."""
    tags = sorted(known)
    if len(tags) > _LETTERS or any(tag == "" or min(tag) < " " for tag in tags):
        return {}
    return {tag: chr(_FIRST_LETTER + k) for k, tag in enumerate(tags)}


def tag_code(tags: Column, known: Sequence[str]) -> Column:
    """The tags as one string with a letter each, if they are all ``known`` (see :func:`is_code`)."""
    letters = code_letters(known)
    if not letters:
        return F.lit(None).cast("string")
    code = F.concat(F.lit(_OPEN), F.array_join(tags, _CLOSE + _OPEN), F.lit(_CLOSE))
    for tag, letter in letters.items():
        code = F.replace(code, F.lit(f"{_OPEN}{tag}{_CLOSE}"), F.lit(letter))
    return F.when(F.size(tags) <= LONGEST_CODE, code)


def is_code(code: Column, tags: Column) -> Column:
    """Whether a string of :func:`tag_code` has a letter for each tag.

    A tag that is not known, or null, leaves a string of another length.
    """
    return F.coalesce(F.length(code) == F.size(tags), F.lit(False))


def tags_ahead(code: Column, at: Column, known: Sequence[str], mark: str = "DT") -> Column:
    """The letters of the tags before the word at ``at`` (from 0) and after the last ``mark``."""
    ahead, letter = F.substr(code, F.lit(1), at), code_letters(known).get(mark)
    return F.substring_index(ahead, letter, -1) if letter else ahead


# For so many tags, or fewer, all their sets are listed.
_LISTED = 8


def set_ahead(ahead: Column, known: Sequence[str], mark: str = "DT") -> Column:
    """The set that :func:`tags_since` has, of the letters of :func:`tags_ahead`."""
    letters = [(tag, letter) for tag, letter in code_letters(known).items() if tag != mark]
    if not letters or len(letters) > _LISTED:
        found = [F.when(F.contains(ahead, F.lit(letter)), F.lit(tag)) for tag, letter in letters]
        return F.concat_ws("+", *found)
    sets = [
        F.lit("+".join(tag for k, (tag, _) in enumerate(letters) if n >> k & 1)) for n in range(1 << len(letters))
    ]
    number = F.lit(0)
    for k, (_, letter) in enumerate(letters):
        number = number + F.when(F.contains(ahead, F.lit(letter)), 1 << k).otherwise(0)
    return F.get(F.array(*sets), number)
