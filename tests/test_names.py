import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import names as N

SENTENCES = "doc_id long, sent_no int, sentence string"


def plain(words, names):
    """All occurrences of names on a list of words."""
    return {
        (at, n, " ".join(words[at : at + n]), names[tuple(words[at : at + n])])
        for at in range(len(words))
        for n in range(1, len(words) - at + 1)
        if tuple(words[at : at + n]) in names
    }


def plain_iob(words, names, longest_first, join_adjacent):
    out, at, touching = [], 0, False
    while at < len(words):
        sizes = [n for n in range(1, len(words) - at + 1) if tuple(words[at : at + n]) in names]
        if not sizes:
            out.append("O")
            at, touching = at + 1, False
            continue
        n = max(sizes) if longest_first else min(sizes)
        tag = names[tuple(words[at : at + n])]
        out += [("I-" if touching and join_adjacent else "B-") + tag, *["I-" + tag] * (n - 1)]
        at, touching = at + n, True
    return out


def some(spark):
    drawn = random.Random(12)
    vocabulary = ["a", "b", "c", "the", "É", "Straße", "12", "!?"]
    listed = {tuple(drawn.choices(vocabulary, k=drawn.randint(1, 4))): drawn.choice("XYZ") for _ in range(60)}
    rows = [(" ".join(words), tag) for words, tag in listed.items()]
    first = next(iter(listed))
    rows += [("  ".join(first), "ZZ"), (None, "X"), ("", "X"), rows[0]]
    names = N.build_names(spark.createDataFrame(rows, "name string, tag string"))
    texts = [" ".join(drawn.choices(vocabulary, k=drawn.randint(0, 15))) for _ in range(120)]
    sentences = [(k // 7, k % 7, t) for k, t in enumerate([*texts, None, "", "nothing listed"])]
    return listed, names, spark.createDataFrame(sentences, SENTENCES)


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 0}])
def test_every_occurrence(spark, bounds):
    listed, names, sentences = some(spark)
    found = {}
    for r in N.match_names(sentences, names, **bounds).collect():
        found.setdefault((r.doc_id, r.sent_no), []).append((r.at, r.n, r.phrase, r.tag))
    for r in sentences.collect():
        got = found.get((r.doc_id, r.sent_no), [])
        assert len(got) == len(set(got))
        assert set(got) == plain((r.sentence or "").split(), listed)


@pytest.mark.parametrize("longest_first", [False, True])
@pytest.mark.parametrize("join_adjacent", [False, True])
def test_labels(spark, longest_first, join_adjacent):
    listed, names, sentences = some(spark)
    rows = N.label_names(sentences, names, longest_first, join_adjacent).collect()
    assert len(rows) == sentences.count()
    for r in rows:
        if r.sentence is None:
            assert r.iob is None
            continue
        assert r.iob == plain_iob(r.sentence.split(), listed, longest_first, join_adjacent), r.sentence


def test_words_that_begin_no_name_are_followed_no_further(spark):
    _, names, sentences = some(spark)
    index = {r["first"]: r["lengths"] for r in N.name_index(names).collect()}
    assert all(lengths == sorted(set(lengths)) for lengths in index.values())
    shuffled = N.match_names(sentences, names, max_rows=0)
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_names(spark):
    _, names, sentences = some(spark)
    none = names.limit(0)
    assert N.match_names(sentences, none).collect() == []
    labelled = N.label_names(sentences, none).filter("sentence is not null").collect()
    assert all(set(r.iob) <= {"O"} for r in labelled)
    assert N.match_names(sentences.filter(F.lit(False)), names).collect() == []
