import random
import re
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import gazetteer as G
from factloom.functions.text import tokenize_wordpunct
from factloom.operators.relations import gazetteer_sentences, gazetteer_triples


def labels(spark, text, patterns, **options):
    df = spark.createDataFrame([(1, 0, text)], "doc_id long, sent_no int, sentence string")
    return gazetteer_sentences(df, patterns, **options).first()["iob"]


def test_words_of_other_scripts_and_forms(spark):
    patterns = [("рек[аеи]", "WATER"), ("[Бб]ольш(ой|ая) камень", "ROCK")]
    text = "У реки лежит большой камень"
    assert labels(spark, text, patterns) == ["O", "B-WATER", "O", "B-ROCK", "I-ROCK"]


def test_shortest_first(spark):
    patterns = [("new york", "CITY"), ("new", "ADJ")]
    assert labels(spark, "in new york", patterns) == ["O", "B-ADJ", "O"]
    assert labels(spark, "in new york", patterns, longest_first=True) == ["O", "B-CITY", "I-CITY"]


def test_neighbouring_hits(spark):
    assert labels(spark, "ant ant", [("ant", "A")]) == ["B-A", "B-A"]
    assert labels(spark, "ant ant", [("ant", "A")], join_adjacent=True) == ["B-A", "I-A"]


def test_overlap_goes_to_the_first(spark):
    patterns = [("a b", "X"), ("b c", "Y")]
    assert labels(spark, "a b c", patterns) == ["B-X", "I-X", "O"]


def test_first_pattern_names_the_tag(spark):
    assert labels(spark, "ant", [("an.", "A"), ("ant", "B")]) == ["B-A"]


def test_groups_do_not_change_the_match(spark):
    df = spark.createDataFrame([("foo x bar x",)], "s string")
    found = df.select(G.find_phrases(F.col("s"), [("(foo|bar) x", "T")]).alias("p")).first()["p"]
    assert [(p["phrase"], p["tag"]) for p in found] == [("foo x", "T"), ("bar x", "T")]


def test_no_hit_and_nothing_left_over_from_other_sentences(spark):
    rows = [(1, 0, "ant"), (1, 1, "bee ant2"), (1, 2, "bee")]
    df = spark.createDataFrame(rows, "doc_id long, sent_no int, sentence string")
    found = {r["sent_no"]: r["iob"] for r in gazetteer_sentences(df, [("^ant$|^bee$", "A")]).collect()}
    assert found == {0: ["B-A"], 1: ["O", "O"], 2: ["B-A"]}


def plain_labels(words, phrases, longest_first, join_adjacent):
    tag_of = {}
    for phrase, tag in phrases:
        tag_of.setdefault(phrase, tag)
    longest = max((p.count(" ") for p in tag_of), default=0) + 1
    out, i, touching = [], 0, False
    while i < len(words):
        sizes = range(1, min(longest, len(words) - i) + 1)
        sizes = reversed(sizes) if longest_first else sizes
        n = next((n for n in sizes if " ".join(words[i : i + n]) in tag_of), None)
        if n is None:
            out.append("O")
            i, touching = i + 1, False
            continue
        tag = tag_of[" ".join(words[i : i + n])]
        out.append(("I-" if touching and join_adjacent else "B-") + tag)
        out.extend(["I-" + tag] * (n - 1))
        i, touching = i + n, True
    return out


@pytest.mark.parametrize("longest_first", [False, True])
@pytest.mark.parametrize("join_adjacent", [False, True])
def test_labels_against_a_plain_walk(spark, longest_first, join_adjacent):
    random.seed(41)
    patterns = [("a b c", "P"), ("b( c)?", "Q"), ("c d", "R"), ("d", "S"), ("[ae] a", "T")]
    texts = [" ".join(random.choices("abcdef", k=random.randint(1, 20))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    words = tokenize_wordpunct(F.col("s"))
    phrases = G.find_phrases(F.col("s"), patterns)
    options = {"longest_first": longest_first, "join_adjacent": join_adjacent}
    for r in df.select("s", G.phrase_iob(words, phrases, **options).alias("iob")).collect():
        found = [(m.group(0), tag) for p, tag in patterns for m in re.finditer(p, r["s"])]
        assert r["iob"] == plain_labels(r["s"].split(), found, **options), r["s"]


def test_triples(spark):
    df = spark.createDataFrame([(1, 0, "ant eats bee and cat")], "doc_id long, sent_no int, sentence string")
    row = gazetteer_triples(df, [("ant|bee|cat", "T")]).first()
    assert [tuple(t) for t in row["triples"]] == [("ant/NN", "eats/NN", "bee/NN")]


def test_sentences_with_too_few_names_are_not_tagged(spark):
    def failing(words):
        return F.transform(words, lambda w: F.raise_error(F.lit("tagged")).cast("string"))

    texts = ["nothing here at all", "ant eats bee", "ants and bees and cats", "", None]
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, sent_no int, sentence string")
    found = gazetteer_triples(df, [("ant|bee|cat", "T")], tagger=failing).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["triples"]) for r in found] == [(k, []) for k in range(5)]


def test_phrases_that_begin_alike(spark):
    words = "of the sea of a sea of".split()
    listed = [("of the sea of b", "P"), ("of a", "Q"), ("the", "R"), ("sea of", "S")]
    df = spark.createDataFrame([(words, listed)], "words array<string>, phrases array<struct<phrase string, tag string>>")
    got = df.select(G.phrase_iob(F.col("words"), F.col("phrases")).alias("iob")).first()["iob"]
    assert got == ["O", "B-R", "B-S", "I-S", "O", "B-S", "I-S"]


def test_very_many_hits_and_phrases_take_no_square(spark):
    drawn = random.Random(4)
    words = [f"w{drawn.randint(0, 9_000)}" for _ in range(20_000)]
    listed = [(f"w{k} w{drawn.randint(0, 9_000)}", f"T{k % 3}") for k in range(0, 9_000, 2)]
    listed += [(f"{words[k]} {words[k + 1]} {words[k + 2]}", "L") for k in range(0, 10_000, 2)]
    listed += [(f"w{k}", "S") for k in range(0, 9_000, 3)]
    df = spark.createDataFrame([(words, listed)], "words array<string>, phrases array<struct<phrase string, tag string>>").cache()
    small = df.select(F.slice("words", 1, 50).alias("words"), "phrases")

    def found(of):
        return of.select(G.phrase_iob(F.col("words"), F.col("phrases"), longest_first=True).alias("iob")).first()["iob"]

    found(small)
    began = time.monotonic()
    got = found(df)
    assert time.monotonic() - began < 20
    assert got == plain_labels(words, listed, True, False)
    assert sum(label.startswith("B-") for label in got) > 6_000
