"""Chunk tagging without placing sentences: coded tags, packed labels, rare words apart."""

import random

from pyspark.sql import functions as F

from factloom.functions.tags import rule_tags, verb_phrase_iob
from factloom.operators import chunking
from factloom.operators.tagging import gather_labels, gather_tokens

KEYED = "doc_id long, sent_no int, tok_no int, word string, iob string"


def test_labels_gathered_as_numbers_are_those_of_tokens(spark):
    rng = random.Random(5)
    labels = ["B-VP", "I-VP", "O"]
    rows = [(d, s, k, f"w{rng.randrange(9)}", rng.choice(labels)) for d in range(4) for s in range(5) for k in range(rng.choice([1, 30, 31, 32, 70]))]
    # Keys that come twice, null keys, a missing token, a label that is not known.
    rows += [(0, 0, k, f"x{k}", "O") for k in range(33)] + [(None, 1, k, "n", "O") for k in range(2)] * 2
    rows += [(9, 0, k, "m", "I-VP") for k in (0, 1, 3)] + [(9, 1, k, "m", label) for k, label in enumerate(["O", "new"])]
    tokens = spark.createDataFrame(rows, KEYED).repartition(7)
    got = {(r.doc_id, r.sent_no, tuple(r.iob)) for r in gather_labels(tokens, labels).collect()}
    plain = gather_tokens(tokens, ["word", "iob"])
    assert got == {(r.doc_id, r.sent_no, tuple(r.iob)) for r in plain.collect()} and len(got) == 23
    once = tokens.filter("doc_id in (1, 2, 3)")
    assert "SortAggregate" not in gather_labels(once, labels)._jdf.queryExecution().executedPlan().toString()


def test_tags_since_from_letters(spark):
    rng = random.Random(3)
    known = ["DT", "!", "NN", "N", "VB", '"']
    lists = [[rng.choice(known) for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    lists += [["DT"] * 4, ["NN"], ["NN", None, "VB"], ["XX", "DT", "XX"], [rng.choice(known) for _ in range(1200)]]
    rows = [(n, 0, [f"w{k}" for k in range(len(tags))], tags) for n, tags in enumerate(lists)]
    df = spark.createDataFrame(rows, "doc_id long, sent_no int, words array<string>, tags array<string>")
    columns = ["doc_id", "tok_no", "pos", "prevpos", "nextpos", "tags_since_dt"]
    plain = sorted(map(str, chunking.chunk_features(df).select(columns).collect()))
    many = [*known, *[f"T{n}" for n in range(10)]]
    for tags in (known, many, ["NN", "VB"], [f"T{n}" for n in range(200)]):
        assert sorted(map(str, chunking.chunk_features(df, tags=tags).select(columns).collect())) == plain
    assert chunking.seen_tags(df) == sorted([*known, "XX"]) and chunking.seen_tags(df, most=3) is None
    for r in chunking.chunk_features(df.filter("doc_id < 5"), tags=known).collect():
        tags = lists[r.doc_id]
        start = max((k + 1 for k in range(r.tok_no) if tags[k] == "DT"), default=0)
        assert r.tags_since_dt == "+".join(sorted(set(tags[start : r.tok_no])))


def test_rounding_decides_only_near_scores(spark):
    rows = [(1.0, 2.0, 3.0), (3.0, 3.0 + 4e-10, 1.0), (3.0 + 4e-10, 3.0, 3.0), (-1.0, -2.0, -1.0 - 2.5e-9), (5.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [r.l for r in df.select(chunking.best_label(["a", "b", "c"], ["A", "B", "C"]).alias("l")).collect()]
    assert got == ["C", "B", "C", "A", "C"]


def test_rare_words_stay_where_they_are_looked_up(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{n}" for n in range(40)] + ["the", "of", "ing"]
    rows = [(d, s, [rng.choice(words) for _ in range(rng.randrange(1, 50))]) for d in range(6) for s in range(4)]
    rows += [(0, 0, ["again", "the", None])]
    df = spark.createDataFrame(rows, "doc_id long, sent_no int, words array<string>")
    df = df.withColumn("tags", rule_tags(F.col("words")))
    learned = df.filter("doc_id < 4").withColumn("iob", verb_phrase_iob(F.col("tags")))
    counts = chunking.train_chunker(chunking.chunk_features(learned))
    plain = chunking.tag_chunks(chunking.chunk_features(df), chunking.load_chunker(counts))
    expected = sorted(map(str, plain.collect()))
    monkeypatch.setattr(chunking, "MAX_BROADCAST_ROWS", 30)
    monkeypatch.setattr(chunking, "most_frequent", lambda counted: counted.orderBy(F.desc("n"), "fval").limit(8))
    model = chunking.load_chunker(counts)
    assert model.frequent.count() == 8 and not model.broadcast["word"]
    rare = chunking.chunk_features(df, without=model.frequent_words())
    apart = chunking.tag_chunks(chunking.chunk_features(df), model, rare=rare)
    assert sorted(map(str, apart.collect())) == expected
    plan = apart._jdf.queryExecution().executedPlan().toString()
    # No token goes back to its sentence, for which two lists would be joined.
    assert "hashpartitioning(doc_id" not in plan and "collect_list" not in plan


def test_repeated_documents_meet_all_their_languages(spark, tmp_path):
    from factloom.catalog.queries import english_documents

    rows = [(1, "A b.", "en", "s"), (2, "C d.", "de", "s"), (2, "E f.", "en", "t"), (3, "G.", None, "s"), (None, "H.", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for n, some in enumerate((docs, docs.filter("text <> 'E f.'"))):
        some.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got = english_documents(spark, f"{tmp_path}/{n}").select("doc_id", "fulltext", "english")
        left = some.select("doc_id", F.col("text").alias("fulltext"))
        plain = left.join(some.select("doc_id", (F.col("lang") == "en").alias("english")), "doc_id")
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
