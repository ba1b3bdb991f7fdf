import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions.text import split_sentences
from factloom.operators.abbreviations import learned_abbreviations, score_abbreviations

TEXTS = [
    "The bee (Appl. Ent. Zool. 3) eats. Exp. Appl. Acarol. Mites eat bees.",
    "See Appl. Ent. Here bees eat mites and mites eat the bee.",
    "Appl. Ent. Long words end here. Mites e.g. ticks end. i.e. none",
    "Ent. Appl. Ent. Exp. eats and eats and mites",
    None,
    "",
    "12. 3.5 …",
]


def scored(texts):
    """The scores by plain counting."""
    counts = Counter()
    for text in texts:
        for word in re.findall(r"[^\W\d_]+(?:\.[^\W\d_]+)*\.?", text or ""):
            counts[word.lower().rstrip("."), word.endswith(".")] += 1
    share = sum(n for (_, p), n in counts.items() if p) / sum(counts.values())

    def likelihood(n, m, p):
        return n * math.log(p) + m * math.log(1 - p)

    found = {}
    for word in {w for (w, p) in counts if p}:
        n, m = counts[word, True], counts[word, False]
        size = len(word.replace(".", ""))
        ratio = -2 * (likelihood(n, m, share) - likelihood(n, m, 0.99))
        found[word] = (n, m, ratio * math.exp(-size) * (word.count(".") + 1) / size**m)
    return found


def table(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "fulltext string")


def test_scores_against_plain_counts(spark):
    got = {r["word"]: (r["n_period"], r["n_plain"], r["score"]) for r in score_abbreviations(table(spark, TEXTS)).collect()}
    expected = scored(TEXTS)
    assert set(got) == set(expected) and "e.g" in got
    for word, row in expected.items():
        assert got[word] == pytest.approx(row)


def test_learned_words_keep_sentences_whole(spark):
    texts = table(spark, TEXTS)
    # Seen more often, the words are surer.
    learned = learned_abbreviations(score_abbreviations(table(spark, TEXTS * 3)), 0.3)
    assert {"ent", "appl"} <= set(learned) and "eats" not in learned
    plain, known = (
        [r[0] for r in texts.select(split_sentences(F.col("fulltext"), learned=words)).collect()]
        for words in ((), learned)
    )
    assert len(plain[1]) == 3 and len(known[1]) == 1
    assert known[0][-1].endswith("Mites eat bees.") and known[0][0].endswith("3) eats.")


def test_all_words_abbreviated_none_and_too_many(spark):
    rows = score_abbreviations(table(spark, ["Appl. Ent. Zool."])).collect()
    assert {r["score"] for r in rows} == {0.0} and len(rows) == 3
    assert score_abbreviations(table(spark, [None, ""])).count() == 0
    with pytest.raises(ValueError):
        learned_abbreviations(score_abbreviations(table(spark, TEXTS)), -1e9, most=2)
