"""Sentences, tokens, n-grams and per-row term counts as native expressions.

Every function takes and returns a Column, so a whole text chain is one
projection: no shuffle, no Python worker. Work per row is linear in the text, or
n log n where terms are counted, so that one very long unpunctuated text costs
what its length says and no more.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.functions.stopwords import ENGLISH

# Abbreviations whose period does not end a sentence.
ABBREVIATIONS = (
    "Dr Mr Mrs Ms Prof St Fig Figs Eq Eqs Ref Refs Tab Vol Vols Sect Chap "
    "ca cf vs etc al approx resp sp spp subsp var e.g i.e"
).split()

# White space as Java's patterns know it, and all white space of publishers' texts.
_BLANKS = " \t\n\x0b\f\r"
_ANY_BLANKS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
_ANY_BLANK = f"[{_ANY_BLANKS}]"
_CLOSER = "[\"'”’)\\]]"
_OPENER = "[\"'“‘(\\[]"


def sentence_break(
    abbreviations: Iterable[str] = ABBREVIATIONS, learned: Iterable[str] = ()
) -> str:
    """The (Java) pattern of the white space between two sentences.

    It follows ``.``, ``!`` or ``?`` with up to two closing marks, comes before a
    capital letter with up to two opening marks, and does not follow a known
    abbreviation or a single capital (an initial). Abbreviations that were ``learned``
    are known whatever their case.
    """
    known = "|".join(a.replace(".", r"\.") for a in abbreviations)
    if learned := "|".join(a.replace(".", r"\.") for a in learned):
        known = f"{known}|(?iu:{learned})" if known else f"(?iu:{learned})"
    # The blank comes first so that the look-behinds run at blanks only.
    return (
        rf"{_ANY_BLANK}(?<=[.!?]{_CLOSER}{{0,2}}{_ANY_BLANK})"
        rf"(?<!(?<![\p{{L}}\p{{N}}_])(?:{known}|\p{{Lu}})\.{_ANY_BLANK})"
        rf"{_ANY_BLANK}*(?={_OPENER}{{0,2}}\p{{Lu}})"
    )


def split_sentences(
    text: Column, abbreviations: Iterable[str] = ABBREVIATIONS, learned: Iterable[str] = ()
) -> Column:
    """Sentences of ``text`` in order; blank pieces are left out, null gives ``[]``."""
    pieces = F.split(text, sentence_break(abbreviations, learned))
    kept = F.filter(pieces, lambda s: F.rlike(s, F.lit(f"[^{_ANY_BLANKS}]")))
    return F.coalesce(kept, F.array().cast("array<string>"))


def tokenize_ws(sentence: Column) -> Column:
    """Lowercase, then cut at each single white-space character.

    Two blanks in a row leave an empty token, blanks at the end leave none, and a
    text of blanks alone has no tokens at all.
    """


    def cut(blanked: Column) -> Column:
        # Cutting at one character takes no pattern to be compiled for each sentence.
        return F.split(F.lower(F.rtrim(blanked)), " ")

    other = F.lit(False)
    for blank in _BLANKS[1:]:
        other = other | sentence.contains(blank)
    # Only a sentence that begins with a blank can be one of blanks alone.
    blanked = F.translate(sentence, _BLANKS[1:], " " * 5)
    only_blanks = (F.length(blanked) > 0) & (F.length(F.rtrim(blanked)) == 0)
    odd = F.when(only_blanks, F.array().cast("array<string>")).otherwise(cut(blanked))
    return F.when(~(sentence.startswith(" ") | other), cut(sentence)).otherwise(odd)


def tokenize_wordpunct(sentence: Column, stopwords: Iterable[str] = ()) -> Column:
    """Runs of letters, digits and ``_``, and runs of anything else but blanks.

    Stop words are compared in lower case; what is kept keeps its case.
    """
    tokens = F.regexp_extract_all(
        sentence, F.lit(rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_ANY_BLANKS}]+"), F.lit(0)
    )
    return remove_stopwords(tokens, stopwords)


def remove_stopwords(
    words: Column, stopwords: Iterable[str] = ENGLISH, lowercased: bool = False
) -> Column:
    """Drop stop words, whatever their case; ``lowercased`` words are taken as they are."""
    stopwords = list(stopwords)
    if not stopwords:
        return words
    return F.filter(words, lambda w: ~(w if lowercased else F.lower(w)).isin(stopwords))


def ngrams(words: Column, n: int = 2) -> Column:
    """Runs of ``n`` neighbouring words joined by a blank; ``[]`` if there are fewer."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return let(words, lambda w: _joined_runs(w, n))


def _joined_runs(words: Column, n: int) -> Column:
    grams = F.greatest(F.size(words) - (n - 1), F.lit(0))
    runs = F.slice(words, 1, grams)
    for k in range(1, n):
        runs = F.zip_with(
            runs, F.slice(words, k + 1, grams), lambda run, word: F.concat(run, F.lit(" "), word)
        )
    return runs


def concat_lists(*lists: Column) -> Column:
    """All lists in one, in order; a null list counts as empty."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(c, empty) for c in lists])


def raw_features(filtered: Column, grams: Sequence[int] = (1, 2)) -> Column:
    """Grams of each size in ``grams`` over the filtered words, duplicates kept."""
    return let(
        filtered,
        lambda w: F.concat(*[w if n == 1 else _joined_runs(w, n) for n in grams]),
    )


def sentence_features(
    sentence: Column,
    grams: Sequence[int] = (1, 2),
    stopwords: Iterable[str] = ENGLISH,
) -> Column:
    """The feature list of a raw sentence: tokenize, drop stop words, form grams."""
    words = remove_stopwords(tokenize_ws(sentence), stopwords, lowercased=True)
    return raw_features(words, grams)


def repeats_last(terms: Column) -> Column:
    """``struct<n, terms>``: the ``n`` different terms first, then every repeat.

    Listing terms this way lets one explode count both the rows a term is in and
    its occurrences. Most sentences repeat few terms, many none.
    """

    def repeats(ordered: Column) -> Column:
        return F.filter(ordered, lambda t, i: (i > 0) & (t == F.get(ordered, i - 1)))

    return let(
        terms,
        lambda listed: let(
            F.array_distinct(listed),
            lambda different: F.struct(
                F.size(different).alias("n"),
                F.when(F.size(different) == F.size(listed), different)
                .otherwise(F.concat(different, let(F.sort_array(listed), repeats)))
                .alias("terms"),
            ),
        ),
    )


def count_terms(terms: Column) -> Column:
    """``array<struct<term, n>>`` of one row's terms, ordered by term.

    Sorting brings equal terms together, so a count is the distance between two
    run starts. Counting inside the row keeps the corpus-wide
    ``(document, sentence, term)`` shuffle out of the plan.
    """
    return let(F.sort_array(terms), _count_runs)


def _count_runs(ordered: Column) -> Column:
    size = F.size(ordered)
    run_starts = F.filter(
        F.transform(
            ordered,
            lambda t, i: F.when((i == 0) | (t != F.get(ordered, i - 1)), i),
        ),
        lambda i: i.isNotNull(),
    )
    return let(
        run_starts,
        lambda starts: F.transform(
            starts,
            lambda p, k: F.struct(
                F.get(ordered, p).alias("term"),
                (F.coalesce(F.get(starts, k + 1), size) - p).cast("long").alias("n"),
            ),
        ),
    )
