import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.functions import chunks as C
from factloom.functions import context
from factloom.functions.tags import rule_tags, verb_phrase_iob
from factloom.operators import chunking
from factloom.operators.relations import (
    chunk_rows,
    model_triples,
    named_triples,
    relation_rows,
    with_chunks,
)
from factloom.operators.tagging import (
    gather_tokens,
    learn_lexicon,
    tag_sentences,
    tag_tokens,
    token_rows,
)

TAGGED = "doc_id long, sent_no int, words array<string>, tags array<string>, iob array<string>"
TAGS = ["DT", "NN", "VB", "IN", "SYM"]
LABELS = ["B-X", "I-X", "B-Y", "I-Y", "O"]


def random_sentences(seed, n=150, longest=25):
    random.seed(seed)
    rows = []
    for i in range(n):
        size = random.randint(1, longest)
        rows.append(
            (
                i // 4,
                i % 4,
                [random.choice("abcdef") for _ in range(size)],
                random.choices(TAGS, k=size),
                random.choices(LABELS, k=size),
            )
        )
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(random_sentences(23), TAGGED).cache()


def plain_chunks(texts, iob):
    """[label, texts, gap texts] by walking along the sentence."""
    out = []
    open_label = None
    for text, label in zip(texts, iob):
        if label == "O":
            if out:
                out[-1][2].append(text)
            open_label = None
        elif label.startswith("I-") and open_label == label[2:]:
            out[-1][1].append(text)
        else:
            out.append([label[2:], [text], []])
            open_label = label[2:]
    return [(k, c[0], " ".join(c[1]), " ".join(c[2])) for k, c in enumerate(out)]


def test_chunks_against_a_plain_walk(labelled):
    rows = labelled.select("words", "iob", C.chunks(F.col("words"), F.col("iob")).alias("c")).collect()
    for r in rows:
        assert [tuple(c) for c in r["c"]] == plain_chunks(r["words"], r["iob"])


def test_relations_against_a_plain_walk(labelled):
    chunked = with_chunks(labelled, show_tags=False)
    got = {tuple(r) for r in relation_rows(labelled, show_tags=False).collect()}
    expected = set()
    for r in labelled.collect():
        found = plain_chunks(r["words"], r["iob"])
        for k in range(len(found) - 2):
            expected.add((r["doc_id"], r["sent_no"], k, found[k][2], found[k][3], found[k + 1][2]))
    assert got == expected
    more = relation_rows(labelled, require_following=False).count()
    assert more == sum(max(len(plain_chunks(r["words"], r["iob"])) - 1, 0) for r in labelled.collect())
    assert chunk_rows(chunked).count() == sum(
        len(plain_chunks(r["words"], r["iob"])) for r in labelled.collect()
    )


@pytest.mark.parametrize("chunks, relations", [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2)])
def test_n_chunks_give_n_minus_2_relations(spark, chunks, relations):
    words = ["w"] * (2 * chunks + 1)
    iob = ["O"] + ["B-X", "O"] * chunks
    df = spark.createDataFrame([(1, 0, words, ["NN"] * len(words), iob)], TAGGED)
    assert relation_rows(df).count() == relations


@pytest.mark.parametrize(
    "filler, hit",
    [
        ("eats/VB", False),  # no blank before the first word
        ("often/RB eats/VB", True),
        ("often/RB EATS/VB", False),
        ("pollinates/VB", True),
        ("parasitizes/VB", True),
        ("parasitises/VB", True),
        ("", False),
    ],
)
def test_pattern(spark, filler, hit):
    df = spark.createDataFrame([(filler,)], "filler string")
    relation = F.array(F.struct(F.col("filler")))
    assert (df.select(F.size(C.matching(relation))).first()[0] == 1) == hit


def test_hint_covers_the_pattern(spark):
    # Whatever filler matches, its sentence matches the hint.
    random.seed(31)
    parts = ["interact", "eat", "prey", "parasitis", "pollinat", "infect", "spread", "kill", "a", "x", "Eat"]
    rows = [(" ".join(random.choice(["", "un"]) + random.choice(parts) for _ in range(5)),) for _ in range(300)]
    df = spark.createDataFrame(rows, "s string").withColumn(
        "filler", F.regexp_replace("s", r"(\S+)", "$1/NN")
    )
    matching = df.filter(F.col("filler").rlike(C.INTERACTION_PATTERN))
    assert matching.count() > 0
    assert matching.filter(~F.col("s").rlike(C.INTERACTION_HINT)).count() == 0


def plain_since(tags):
    out, seen = [], set()
    for tag in tags:
        out.append("+".join(sorted(seen)))
        seen = set() if tag == "DT" else seen | {tag}
    return out


def test_tags_since_determiner(spark, labelled):
    for r in labelled.select("tags", context.tags_since(F.col("tags")).alias("t")).collect():
        assert r["t"] == plain_since(r["tags"])
    edge = spark.createDataFrame([([],), (["DT"],), (["DT", "DT", "NN"],)], "tags array<string>")
    for r in edge.select("tags", context.tags_since(F.col("tags")).alias("t")).collect():
        assert r["t"] == plain_since(r["tags"])


def plain_features(words, tags):
    out = []
    for i, (word, pos) in enumerate(zip(words, tags)):
        before = tags[i - 1] if i else "<START>"
        after = tags[i + 1] if i + 1 < len(tags) else "<END>"
        out.append(
            {
                "pos": pos,
                "word": word,
                "prevpos": before,
                "nextpos": after,
                "prevpos+pos": f"{before}+{pos}",
                "pos+nextpos": f"{pos}+{after}",
                "tags-since-dt": plain_since(tags)[i],
            }
        )
    return out


def test_features(labelled):
    got = {
        (r["doc_id"], r["sent_no"], r["tok_no"]): {n: r[c] for n, c in chunking.FEATURES.items()}
        for r in chunking.chunk_features(labelled).collect()
    }
    expected = {
        (r["doc_id"], r["sent_no"], i): f
        for r in labelled.collect()
        for i, f in enumerate(plain_features(r["words"], r["tags"]))
    }
    assert got == expected


def test_training_counts(labelled):
    expected = Counter(
        (name, value, label)
        for r in labelled.collect()
        for f, label in zip(plain_features(r["words"], r["tags"]), r["iob"])
        for name, value in f.items()
    )
    model = chunking.train_chunker(chunking.chunk_features(labelled)).collect()
    assert {(r["fname"], r["fval"], r["label"]): r["n"] for r in model} == expected


def plain_bayes(train):
    """A classifier from the textbook formula, with 0.5 added to each count."""
    labels, counts, values = Counter(), defaultdict(Counter), defaultdict(set)
    for features, label in train:
        labels[label] += 1
        for name, value in features.items():
            counts[label, name][value] += 1
            values[name].add(value)

    def classify(features):
        scores = {}
        for label, n in labels.items():
            score = math.log((n + 0.5) / (len(train) + 0.5 * len(labels)))
            for name, value in features.items():
                score += math.log((counts[label, name][value] + 0.5) / (n + 0.5 * len(values[name])))
            scores[label] = round(score, 9)
        return max(scores, key=lambda label: (scores[label], label))

    return classify


@pytest.mark.parametrize("contexts", [True, False])
@pytest.mark.parametrize("broadcast", [True, False])
def test_tagging_against_a_plain_classifier(spark, labelled, broadcast, contexts):
    train = [
        (f, label)
        for r in labelled.collect()
        for f, label in zip(plain_features(r["words"], r["tags"]), r["iob"])
    ]
    classify = plain_bayes(train)
    rows = [(d, s, ["zz" if w == "a" else w for w in ws], t, i) for d, s, ws, t, i in random_sentences(29, 60)]
    unseen = spark.createDataFrame(rows, TAGGED).drop("iob")
    model = chunking.load_chunker(chunking.train_chunker(chunking.chunk_features(labelled)))
    assert model.labels == sorted(LABELS) and all(model.broadcast[f] for f in chunking.FEATURES)
    model.broadcast = {f: broadcast for f in chunking.FEATURES}
    if not contexts:
        model.contexts = None
    tagged = chunking.tag_chunks(chunking.chunk_features(unseen), model)
    got = gather_tokens(tagged, ["word", "iob"]).collect()
    expected = {(d, s): [classify(f) for f in plain_features(ws, t)] for d, s, ws, t, _ in rows}
    assert {(r["doc_id"], r["sent_no"]): r["iob"] for r in got} == expected


def test_a_large_table_of_words_is_the_only_one_that_is_shuffled(spark, labelled):
    features = chunking.chunk_features(labelled)
    model = chunking.load_chunker(chunking.train_chunker(features))
    model.broadcast["word"] = False
    plan = chunking.tag_chunks(features, model)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 3
    assert sum("_salt" in line for line in joins) == 1
    assert sum("strategy=broadcast" in line for line in joins) == 2


def test_tags_the_model_has_not_seen(spark, labelled):
    features = chunking.chunk_features(labelled)
    train, rest = features.filter("pos not in ('DT')"), features
    model = chunking.load_chunker(chunking.train_chunker(train))
    together = {tuple(r) for r in chunking.tag_chunks(rest, model).collect()}
    model.contexts = None
    assert together == {tuple(r) for r in chunking.tag_chunks(rest, model).collect()}


def test_log_probabilities_sum_to_one(labelled):
    model = chunking.train_chunker(chunking.chunk_features(labelled))
    priors = chunking.log_probabilities(model).filter("fname is null").collect()
    assert sum(math.exp(r["logp"]) for r in priors) == pytest.approx(1)
    assert sum(r["n"] for r in priors) == sum(len(r["words"]) for r in labelled.collect())


def test_lexicon(spark):
    rows = [
        (1, 0, ["The", "run", "the"], ["DT", "NN", "DT"], []),
        (1, 1, ["Run", "RUN", "tie", "tie"], ["VB", "VB", "NN", "VB"], []),
    ]
    tokens = token_rows(spark.createDataFrame(rows, TAGGED))
    lexicon = learn_lexicon(tokens)
    assert {(r["word"], r["pos"]) for r in lexicon.collect()} == {
        ("the", "DT"),
        ("run", "VB"),
        ("tie", "VB"),
    }
    fresh = token_rows(spark.createDataFrame([(2, 0, ["RUN", "walking", "..."], ["", "", ""], [])], TAGGED))
    row = gather_tokens(tag_tokens(fresh, lexicon)).first()
    assert row["tags"] == ["VB", "VB", "SYM"]
    assert row["words"] == ["RUN", "walking", "..."]


def test_rule_tags(spark):
    df = spark.createDataFrame([(["The", "of", "!?", "12", "walked", "cat"],)], "w array<string>")
    tags = df.select(rule_tags(F.col("w")).alias("t")).first()["t"]
    assert tags == ["DT", "IN", "SYM", "SYM", "VB", "NN"]
    labels = df.select(verb_phrase_iob(F.array(*map(F.lit, ["VB", "VB", "NN", "VB"]))).alias("i"))
    assert labels.first()["i"] == ["B-VP", "I-VP", "O", "B-VP"]


def test_triples_keep_other_columns_and_every_sentence(spark):
    texts = ["Ants walked past ants eating and killed spreaded bugs then", "No.", "x"]
    df = spark.createDataFrame(
        [(1, i, t, f"note {i}") for i, t in enumerate(texts)],
        "doc_id long, sent_no int, sentence string, note string",
    )
    tagged = tag_sentences(df)
    learned = tagged.withColumn("iob", verb_phrase_iob(F.col("tags")))
    model = chunking.load_chunker(chunking.train_chunker(chunking.chunk_features(learned)))
    rows = model_triples(tagged, model, pattern=None, keep=["note"], placed=False).collect()
    assert {(r["sent_no"], r["note"]) for r in rows} == {(0, "note 0"), (1, "note 1"), (2, "note 2")}


def test_named_triples(spark):
    text = "Apis mellifera visits Trifolium repens near Graz"
    df = spark.createDataFrame([(1, 0, text)], "doc_id long, sent_no int, sentence string")
    triples = named_triples(df).first()["triples"]
    assert [tuple(t) for t in triples] == [("Apis/NN", "mellifera/NN visits/NN", "Trifolium/NN")]


def test_long_sentence(spark):
    size = 60_000
    words, tags = ["w"] * size, (["NN", "VB", "IN"] * size)[:size]
    df = spark.createDataFrame([(1, 0, words, tags, ["B-X", "O"] * (size // 2))], TAGGED)
    assert chunking.chunk_features(df).count() == size
    assert relation_rows(df).count() == size // 2 - 2


def test_places_of_tags_are_not_looked_up(spark):
    tags = ["NN", "VB", "DT", "DT", "IN", "NN", "IN", "VB"]
    since = context.tags_since(F.col("tags"))
    assert "array_position" not in str(since)
    df = spark.createDataFrame([(tags,), ([],), (None,)], "tags array<string>")
    got = [r["s"] for r in df.select(since.alias("s")).collect()]
    assert got == [["", "NN", "NN+VB", "", "", "IN", "IN+NN", "IN+NN"], [], None]
