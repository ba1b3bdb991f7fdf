"""Token counts by rank-synchronous merging of byte-pair symbols.

Texts are cut into pre-tokens. The pre-tokens of a batch that were not met before
lie behind each other in one array of symbols. In each round every pre-token finds
its lowest-ranked adjacent pair, and all of them merge all places of that pair at
the same time; a pre-token without a known pair leaves the array. What is left of a
pre-token is its number of tokens.

Merging all places of the lowest pair at once equals merging one after the other
because a merge never makes a pair of a lower rank: each merge makes a symbol of its
own, and all pairs with that symbol have later ranks. ``Merges.load`` checks this.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space, and the pattern of pre-tokens, of byte-level vocabularies.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def pretokens(letter: str, number: str) -> str:
    """The pattern of pre-tokens, given what stands for letters and numbers in a class."""
    return (
        rf"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+"
        rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


def first_plane(kind: str) -> str:
    """The characters up to U+FFFF whose category begins with ``kind``, as ranges of a class."""
    member = np.array([unicodedata.category(chr(c))[0] == kind for c in range(0x10000)])
    edges = np.flatnonzero(np.diff(np.r_[False, member, False].astype(np.int8)))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in edges.reshape(-1, 2).tolist())


# Pre-tokens held at once: found in a text at a time, merged at a time, remembered.
AT_ONCE = 200_000
REMEMBERED = 300_000

_NO_PAIR = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Visible bytes stand for themselves, the others follow after 255 in order.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def refuse_unknown(content: dict) -> None:
    """Raise for a vocabulary with a setting that would be counted wrongly here."""
    model, before = content["model"], content.get("pre_tokenizer") or {}
    faults = [name for name in ("normalizer", "truncation", "padding") if content.get(name)]
    unused = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
    faults += [name for name in unused if model.get(name)]
    if model.get("type", "BPE") != "BPE":
        faults.append("model")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        faults.append("pre_tokenizer")
    # Without a normalizer, the flag "normalized" changes nothing.
    flags = ("single_word", "lstrip", "rstrip")
    faults += [
        f"{flag} of {token['content']!r}"
        for token in content.get("added_tokens") or []
        for flag in flags
        if token.get(flag)
    ]
    if faults:
        raise ValueError(f"settings that are not handled: {', '.join(faults)}")


@dataclass
class Merges:
    """A vocabulary's merges as arrays: sorted pair keys, their ranks, what each rank makes."""

    first: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    special: list[str]

    @classmethod
    def load(cls, path: str) -> Merges:
        """Read a byte-level BPE vocabulary in the JSON form of the tokenizers library."""
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        refuse_unknown(content)
        model = content["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        born = {int(symbol): rank for rank, symbol in enumerate(made)}
        late = np.array([[born.get(int(s), -1) for s in side] for side in (left, right)])
        if len(born) != len(made) or (late >= np.arange(len(made))).any():
            raise ValueError("merges that use a symbol before it is made can't be run in rounds")
        keys = left << 32 | right
        order = np.argsort(keys)
        first = np.array([ids[c] for c in byte_letters()], dtype=np.int32)
        special = [t["content"] for t in content.get("added_tokens") or []]
        return cls(first, keys[order], order.astype(np.int32), made, special)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the largest number where the vocabulary has no such pair."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_PAIR)


def merged_lengths(words: list[bytes], merges: Merges) -> np.ndarray:
    """The number of symbols left of each word (none of them empty)."""
    left_over = np.array([len(w) for w in words], dtype=np.int64)
    if not len(words):
        return left_over
    word = np.repeat(np.arange(len(words)), left_over)
    symbol = merges.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
    rank = np.full(len(symbol), _NO_PAIR)
    inner = np.flatnonzero(word[:-1] == word[1:])
    rank[inner] = merges.rank(symbol[inner], symbol[inner + 1])
    while len(symbol):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lengths = np.diff(np.r_[starts, len(word)])
        lowest = np.minimum.reduceat(rank, starts)
        left_over[word[starts]] = lengths
        goes_on = np.repeat(lowest != _NO_PAIR, lengths)
        lowest = np.repeat(lowest, lengths)[goes_on]
        word, symbol, rank = word[goes_on], symbol[goes_on], rank[goes_on]
        if not len(symbol):
            break
        at = np.flatnonzero(rank == lowest)
        # Places side by side are a run of one symbol: every second one merges.
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        in_run = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        at = at[in_run % 2 == 0]
        symbol[at] = merges.made[rank[at]]
        keep = np.ones(len(symbol), dtype=bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        word, symbol, rank = word[keep], symbol[keep], rank[keep]
        touched = np.zeros(len(word), dtype=bool)
        touched[place[at]] = touched[np.maximum(place[at] - 1, 0)] = True
        changed = np.flatnonzero(touched)
        follows = np.minimum(changed + 1, len(word) - 1)
        pairs = (word[changed] == word[follows]) & (changed != follows)
        rank[changed] = _NO_PAIR
        rank[changed[pairs]] = merges.rank(symbol[changed[pairs]], symbol[follows[pairs]])
    return left_over


class Counter:
    """Counts tokens of texts; remembers the counts of a bounded number of pre-tokens."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.known: dict[str, int] = {}
        # The standard library's pattern is twice as fast, but knows no categories: it
        # gets them spelt out for the first plane, and takes the texts within it.
        self.near = re.compile(pretokens(first_plane("L"), first_plane("N")))
        self.far = regex.compile(pretokens(r"\p{L}", r"\p{N}"))
        special = sorted(merges.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _pieces(self, text: str) -> Iterator[list[str]]:
        within = len(text.encode("utf-16-le")) == 2 * len(text)
        pattern = self.near if within else self.far
        if len(text) < AT_ONCE:
            yield pattern.findall(text)
        else:
            found = (m.group() for m in pattern.finditer(text))
            while piece := list(islice(found, AT_ONCE)):
                yield piece

    def _learn(self, pieces: Iterable[str]) -> None:
        new = list(set(pieces).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set(pieces))
        self.known.update(
            zip(new, merged_lengths([p.encode() for p in new], self.merges).tolist(), strict=True)
        )

    def count(self, texts: Iterable[str | None]) -> list[int]:
        """One count per text; a special token's string is one token."""
        totals: list[int] = []
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def settle() -> None:
            self._learn([p for _, piece in waiting for p in piece])
            for row, piece in waiting:
                totals[row] += sum(map(self.known.__getitem__, piece))
            waiting.clear()

        for row, text in enumerate(texts):
            totals.append(0)
            parts = [text or ""]
            if self.special and text:
                parts = self.special.split(text)
                totals[row] += len(parts) - 1
            for part in parts:
                for piece in self._pieces(part):
                    waiting.append((row, piece))
                    held += len(piece)
                    if held >= AT_ONCE:
                        settle()
                        held = 0
        settle()
        return totals


def token_count(text: Column, merges: Merges) -> Column:
    """Number of tokens of a text; 0 for null.

    ``merges`` goes to the executors with the function: its size is that of the
    vocabulary, whatever the data.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(merges)
        for texts in batches:
            yield pd.Series(counter.count(None if pd.isna(t) else t for t in texts), dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``.

    ``vocabulary`` is the path of the vocabulary file on the driver. Null and empty
    texts have 0 bytes and 0 tokens; repeated rows are counted each; other columns
    are not looked at; an empty table gives an empty result. Texts of any length are
    worked off in pieces of bounded size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = docs.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(text, Merges.load(vocabulary)).alias("n_tokens"),
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
