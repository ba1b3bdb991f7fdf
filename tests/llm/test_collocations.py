"""Best-first growth of phrases, against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import collocations as C

COLUMNS = "doc_id long, text string, lang string, n long, a string, w1 string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    counts, total = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        held = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            held.update(tuple(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    out = []
    for lang, held in counts.items():
        taken = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in taken.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside.get(p[i : i + n], 0), a)
        found = []
        for p, a in taken.items():
            cuts = [(2_000_000 * a // (held[p[:k]] + held[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if 100 * inside.get(p, 0) < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def some_rows(seed):
    drawn = random.Random(seed)
    vocabulary = [*"abcdefghijkl", "É", "é", "Straße", "B", "naïve"]
    fixed = ["new york city hall", "a b c d e", "x y z", "kind of"]
    rows = []
    for k in range(160):
        parts = []
        for _ in range(drawn.randint(0, 25)):
            parts.append(drawn.choice(fixed) if drawn.random() < 0.3 else drawn.choice(vocabulary))
            parts.append(drawn.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x01"]))
        rows.append((k, "".join(parts), drawn.choice(["en", "en", "en", "de", None, "und", ""]), 1, "x", "y"))
    rows += [rows[3], rows[3], (None, None, None, None, None, None), (1, "", "fr", 0, "", "")]
    rows.append((2, "the very same words " * 3000, "en", 0, "", ""))
    return rows


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed, least, top, best, deeper", [(1, 2, 2000, 4000, 8), (2, 2, 12, 6, 2), (3, 3, 5, 1, 3), (4, 2, 3, 3, 100)])
def test_growth_gives_what_counting_everything_gives(spark, seed, least, top, best, deeper):
    rows = some_rows(seed)
    docs = spark.createDataFrame(rows, COLUMNS)
    got = C.collocations(docs, least=least, top=top, best=best, deeper=deeper)
    assert found(got) == brute(rows, least, top)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, " .\n", None)], "doc_id long, text string, lang string")
    assert C.collocations(docs).collect() == C.collocations(docs.limit(0)).collect() == []


def test_counts_of_a_task_are_given_up_and_added(spark, monkeypatch):
    rng = np.random.default_rng(0)
    parts = []
    for _ in range(5):
        words = [rng.integers(0, 4, 50).astype(np.uint64) for _ in range(2)]
        parts.append(C.tallied([(words, np.ones(50, dtype=np.int64))]))
    words, counts = C.tallied(parts)
    assert counts.sum() == 250 and len(set(zip(*[w.tolist() for w in words], strict=True))) == len(counts) == 16


def test_phrases_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(C, "combined", lambda words: np.zeros(len(words[0]), dtype=np.uint64))
    words = [np.array([1, 1, 2, 2], dtype=np.uint64), np.array([1, 2, 1, 1], dtype=np.uint64)]
    held, counts = C.tallied([(words, np.ones(4, dtype=np.int64))])
    assert sorted(zip(*[w.tolist() for w in held], counts.tolist(), strict=True)) == [(1, 1, 1), (1, 2, 1), (2, 1, 2)]


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**17, 10**18, 9 * 10**17)], "a long, l long, r long")
    got = df.select(C.score(df.a, df.l, df.r)).first()[0]
    assert got == 2_000_000 * 9 * 10**17 // (19 * 10**17)
