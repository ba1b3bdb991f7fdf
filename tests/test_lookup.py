"""Lookups too large to be broadcast: nothing is copied that need not be."""

import pyarrow as pa
from pyspark.sql import functions as F

from factloom.functions.tags import rule_tags
from factloom.functions.xml import batch_pieces
from factloom.operators import names as N
from factloom.operators.lookup import lookup_join, lookup_tokens, most_frequent
from factloom.sources.tagged import scan_tagged


def test_only_hot_keys_are_copied(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    right = spark.range(-1, 1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = spark.createDataFrame([(-1,)], "k long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = lookup_join(left, right, ["k"], how, broadcast=False, spread_by=["id"], hot=hot)
        plain = left.join(right, ["k"], how)
        assert got.exceptAll(plain.select(got.columns)).count() == 0 and got.count() == plain.count()
    plan = lookup_join(left, right, ["k"], broadcast=False, hot=hot)._jdf.queryExecution().optimizedPlan().toString()
    assert "WHEN" in plan and "_salt" in plan


def test_most_frequent_rows(spark):
    lookup = spark.createDataFrame([(f"w{n}", n) for n in range(1, 101)], "word string, n long")
    assert sorted(r.n for r in most_frequent(lookup, max_rows=40).collect()) == list(range(64, 101))
    assert most_frequent(lookup, max_rows=1000).count() == 100 and most_frequent(lookup, max_rows=3).count() == 0


def test_tokens_meet_rare_words_too(spark):
    # One sentence of many stretches, a sentence key that comes twice, null and unknown words.
    words = [f"w{k * k % 97}" if k % 5 else None for k in range(400)]
    rows = [(1, 0, k, w) for k, w in enumerate(words)] + [(2, s % 3, s, f"w{s}") for s in range(120)]
    rows += [(2, s % 3, s, f"w{s + 1}") for s in range(120)]
    tokens = spark.createDataFrame(rows, "doc_id long, sent_no int, tok_no int, word string")
    lookup = spark.createDataFrame([(f"w{n}", n, f"v{n}") for n in range(1, 90)], "word string, n long, v string")
    frequent = most_frequent(lookup, max_rows=30).select("word", "v")
    table = lookup.select("word", "v")
    for given in (None, tokens.select("doc_id", "sent_no", "tok_no", "word")):
        got = lookup_tokens(tokens, table, frequent, "word", given)
        plain = tokens.join(table, "word", "left").select(got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_placed_tokens_are_not_shuffled(spark):
    tokens = spark.range(100).select(
        F.col("id").alias("doc_id"), (F.col("id") % 3).alias("sent_no"), F.lit(0).alias("tok_no"),
        F.concat(F.lit("w"), F.col("id")).alias("word"), F.lit("wide").alias("feature"),
    )
    lookup = spark.createDataFrame([("w1", 9, 1.0), ("w2", 1, 2.0)], "word string, n long, v double")
    frequent = most_frequent(lookup, max_rows=1).select("word", "v")
    placed = tokens.repartition("doc_id", "sent_no")
    found = lookup_tokens(placed, lookup.select("word", "v"), frequent, "word", tokens)
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert len([line for line in plan.splitlines() if "ShuffledHashJoin" in line]) == 1
    assert len(shuffles) == 2  # the placing, and the lists of rare words


def test_names_shuffled_with_common_phrases(spark):
    sentences = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("sent_no"), F.lit("of the Aa bb").alias("sentence")
    )
    names = N.build_names(spark.createDataFrame([("of the", "X"), ("Aa bb", "Y"), ("cc", "Z")], "name string, tag string"))
    found = N.match_names(sentences, names, max_rows=0)
    assert {(r.at, r.phrase, r["count"]) for r in found.groupBy("at", "phrase").count().collect()} == {
        (0, "of the", 3000), (2, "Aa bb", 3000)
    }


def test_batches_are_parsed_in_pieces():
    texts = ["x" * 10, None, "y" * 50, *["z"] * 20]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(23)), "xml": texts})
    pieces = list(batch_pieces(batch, "xml", max_rows=8, max_bytes=40))
    assert [r for p in pieces for r in p.column("xml").to_pylist()] == texts
    assert [p.num_rows for p in pieces] == [2, 1, 8, 8, 4]
    assert [p.num_rows for p in batch_pieces(batch.slice(0, 0), "xml")] == [0]


def test_tagged_lines_are_cut_once(spark, tmp_path):
    (tmp_path / "t.txt").write_text("A\tNN\r\n \t\nb  VB B-VP x\n\n \t \n\n\nc\n\n")
    found = scan_tagged(spark, str(tmp_path))
    got = {(tuple(r.words), tuple(r.tags), tuple(r.iob)) for r in found.collect()}
    assert got == {(("A", "b"), ("NN", "VB"), ("O", "B-VP")), (("c",), ("",), ("O",))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_remove") == 1


def test_tags_lower_each_word_once(spark):
    words = spark.createDataFrame([(["Of", "THE", "ING", "Éed", "é", "12", "--", "Ⅷ", None, "Zed"],)], "w array<string>")
    tagged = words.select(rule_tags(F.col("w")).alias("t"))
    assert tagged.first().t == ["IN", "DT", "VB", "VB", "NN", "SYM", "SYM", "SYM", "NN", "VB"]
    assert tagged._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
