"""Language identification with bit-sliced Bloom filters of character n-grams.

Learning counts the n-grams of all labelled training texts per language and keeps
those that make up at least ``min_share`` of their language. A slot of the filter
holds one bit per language; the bitwise AND of an n-gram's slots tells at once every
language that has the n-gram. A text's hits per language are corrected by the share
of hits that the language's filter would give by chance; the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.staging import stage

# Characters of a text that are worked on at once.
PIECE = 1_000_000
MASK_BITS = 63
UNDECIDED = "und"

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def mixed(value: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number of each number."""
    value = value ^ (value >> np.uint64(33))
    value = value * _MIX[0]
    value = value ^ (value >> np.uint64(29))
    value = value * _MIX[1]
    return value ^ (value >> np.uint64(32))


def gram_hashes(text: str, letter: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the lower-cased text's n-grams; what is no letter counts as one blank."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(letter[code], code, 0)
    code = np.r_[np.uint32(0), code, np.uint32(0)]
    code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]].astype(np.uint64)
    if len(code) < n:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(code) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(0x10FFFF + 2) + code[k : k + len(total)]
    return mixed(total)


def pieces(text: str) -> Iterator[str]:
    """The text, or its parts if it is very long (each part is padded like a text)."""
    for start in range(0, max(len(text), 1), PIECE):
        yield text[start : start + PIECE]


def count_grams(labelled: DataFrame, n: int) -> DataFrame:
    """``(lang, gram, n)``: how often each n-gram is in the texts of each language."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letter = letter_table()
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                held: list[np.ndarray] = []
                size = 0
                for k, text in enumerate(texts):
                    for piece in pieces(text):
                        held.append(gram_hashes(piece, letter, n))
                        size += len(held[-1])
                    if size >= PIECE or k == len(texts) - 1:
                        gram, times = np.unique(np.concatenate(held), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": times})
                        held, size = [], 0

    partial = labelled.select("lang", "text").mapInPandas(counted, "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filter:
    """Languages in order of their name; ``slots`` has one row of masks per slot."""

    langs: list[str]
    slots: np.ndarray
    chance: np.ndarray
    n: int
    hashes: int

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the masks of all languages that have it."""
        step = mixed(grams ^ _MIX[0]) | np.uint64(1)
        size = np.uint64(len(self.slots))
        found = self.slots[(grams % size).astype(np.int64)]
        for k in range(1, self.hashes):
            found = found & self.slots[((grams + np.uint64(k) * step) % size).astype(np.int64)]
        return found

    def shares(self, grams: np.ndarray) -> np.ndarray:
        """For each language the share of n-grams it has, less those it has by chance."""
        found = self.masks(grams)
        hits = [
            np.count_nonzero(found[:, k // MASK_BITS] >> np.uint64(k % MASK_BITS) & np.uint64(1))
            for k in range(len(self.langs))
        ]
        share = np.array(hits) / max(len(grams), 1)
        return np.clip((share - self.chance) / (1 - self.chance), 0, 1)


def learn(
    labelled: DataFrame,
    n: int = 4,
    min_share: float = 1e-5,
    hashes: int = 4,
    slots_per_gram: int = 16,
    max_langs: int = 1000,
) -> Filter:
    """Learn from every row of ``labelled`` with a ``text`` and a ``lang``.

    What comes to the driver is bounded whatever the data: at most ``1 / min_share``
    n-grams per language stay, so the filter has at most ``slots_per_gram / min_share``
    slots of one bit per language, and ``max_langs`` languages are allowed (more are an
    error). Repeated rows count each; no labelled row gives a filter without languages.
    """
    labelled = labelled.filter("lang is not null and text is not null")
    counts = stage(count_grams(labelled, n), "grams")
    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(sizes)
    width = max(1, -(-len(langs) // MASK_BITS))
    if not langs:
        return Filter([], np.zeros((1, width), np.uint64), np.zeros(0), n, hashes)
    total = F.create_map(*[F.lit(x) for lang in langs for x in (lang, sizes[lang])])
    place = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])
    frequent = counts.filter(F.col("n") >= min_share * total[F.col("lang")]).select(
        "gram", place[F.col("lang")].alias("k")
    )
    kept = frequent.toPandas()
    most = max(kept.groupby("k").size())
    slots = np.zeros((1 << int(np.ceil(np.log2(most * slots_per_gram))), width), np.uint64)
    grams = kept["gram"].to_numpy().astype(np.int64).view(np.uint64)
    step = mixed(grams ^ _MIX[0]) | np.uint64(1)
    k = kept["k"].to_numpy()
    for j in range(hashes):
        at = ((grams + np.uint64(j) * step) % np.uint64(len(slots))).astype(np.int64)
        bit = np.uint64(1) << (k % MASK_BITS).astype(np.uint64)
        np.bitwise_or.at(slots, (at, k // MASK_BITS), bit)
    filled = [
        np.count_nonzero(slots[:, k // MASK_BITS] >> np.uint64(k % MASK_BITS) & np.uint64(1))
        for k in range(len(langs))
    ]
    return Filter(langs, slots, (np.array(filled) / len(slots)) ** hashes, n, hashes)


def language(text: Column, learned: Filter) -> Column:
    """Struct of ``lang_pred`` and ``score`` of a text.

    ``und`` and 0 for null, a text without a letter, or a filter without languages;
    of languages with equal shares the first by name. A text shorter than an n-gram is
    compared as what it is padded to, with share 0 of every language if that is too
    short as well.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letter = letter_table()
        for texts in batches:
            rows = []
            for text in texts:
                whole = "" if pd.isna(text) else text
                if not learned.langs or not any(c.isalpha() for c in whole):
                    rows.append((UNDECIDED, 0.0))
                    continue
                grams = [gram_hashes(piece, letter, learned.n) for piece in pieces(whole)]
                share = learned.shares(np.concatenate(grams))
                best = int(np.argmax(share))
                rows.append((learned.langs[best], float(share[best])))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predicted(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``docs``.

    Learns from the rows that have a language and are not held out. A null doc_id is
    not held out. Repeated rows are learned from and predicted each; an empty table
    gives an empty result.
    """
    docs = docs.select("doc_id", "text", "lang")
    learned = learn(docs.filter(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", language(F.col("text"), learned).alias("_found"))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_found.lang_pred").alias("lang_pred"),
        F.col("_found.score").alias("score"),
    )
