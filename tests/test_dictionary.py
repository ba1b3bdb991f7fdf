import random

import pytest
from pyspark.sql import functions as F

from factloom.catalog.queries import QUERIES
from factloom.functions.text import sentence_features
from factloom.operators import lookup
from factloom.operators.dictionary import (
    build_dictionary,
    dictionary_vocabulary,
    entity_hits,
    entity_map,
    match_dictionary,
    matched_entities,
)
from factloom.operators.lookup import fits_broadcast, lookup_join
from factloom.operators.sentences import marked_terms
from factloom.operators.vocabulary import fit_vocabulary
from factloom.schema import DICTIONARY
from factloom.sources.dictionary import scan_dictionary


def built(spark, rows, **options):
    out = build_dictionary(spark.createDataFrame(rows, DICTIONARY), **options).collect()
    return {(r["entity"], r["alias"]) for r in out}


def test_example_line(spark):
    rows = [("aacanthocnema luehmannii", "aacanthocnema luehmannii")]
    assert {a for _, a in built(spark, rows)} == {"aacanthocnema luehmannii", "luehmannii"}


def test_only_two_word_entities(spark):
    rows = [("one", "one x"), ("a b c", "a b c"), ("a b", "a b")]
    assert {e for e, _ in built(spark, rows)} == {"a b"}
    assert {e for e, _ in built(spark, rows, min_words=1, max_words=3)} == {"one", "a b c", "a b"}


def test_epithet_of_the_first_alias_only(spark):
    assert built(spark, [("a b", "bee,c d")]) == {("a b", "bee"), ("a b", "c d")}
    assert built(spark, [("a b", "c d,bee")]) == {("a b", "c d"), ("a b", "bee"), ("a b", "d")}
    assert built(spark, [("a b", "c d")], add_epithet=False) == {("a b", "c d")}


def test_aliases_are_trimmed_lowercased_and_united(spark):
    rows = [("a b", "A b, Foo"), ("a b", "Bar, ")]
    assert built(spark, rows) == {("a b", "a b"), ("a b", "b"), ("a b", "foo"), ("a b", "bar")}


def test_scan(spark, tmp_path):
    (tmp_path / "taxa.csv").write_text('a b;a b,c\n"d;e f";"g, h"\n')
    rows = scan_dictionary(spark, str(tmp_path / "taxa.csv")).collect()
    assert [tuple(r) for r in rows] == [("a b", "a b,c"), ("d;e f", "g, h")]


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(17)
    words = "ant bee cat dog eel fox gnu hen the of".split()
    rows = [
        (d, s, " ".join(random.choices(words, k=random.randint(1, 15))))
        for d in range(40)
        for s in range(5)
    ]
    return spark.createDataFrame(rows, "doc_id long, sent_no int, sentence string").cache()


@pytest.fixture(scope="module")
def taxa(spark):
    rows = [("x ant", "ant"), ("x bee", "bee,bee cat"), ("y bee", "bee"), ("x gnu", "none,dog eel")]
    return build_dictionary(spark.createDataFrame(rows, DICTIONARY)).cache()


def brute_force(corpus, taxa, min_tf, min_df):
    aliases = {r["alias"] for r in taxa.collect()}
    rows = corpus.withColumn("f", sentence_features(F.col("sentence"))).collect()
    df = {a: sum(a in r["f"] for r in rows) for a in aliases}
    found = {}
    for r in rows:
        need = min_tf * len(r["f"]) if min_tf < 1 else min_tf
        hits = {a: r["f"].count(a) for a in aliases if df[a] >= min_df and r["f"].count(a) >= max(need, 1)}
        if hits:
            found[r["doc_id"], r["sent_no"]] = (r["sentence"], hits)
    return found


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("min_tf, min_df", [(3, 3), (1, 3), (1, 60), (0.2, 1)])
def test_match_against_brute_force(corpus, taxa, broadcast, min_tf, min_df):
    matched = match_dictionary(corpus, taxa, min_tf=min_tf, min_df=min_df, broadcast=broadcast)
    got = {
        (r["doc_id"], r["sent_no"]): (r["sentence"], {m["term"]: m["n"] for m in r["matches"]})
        for r in matched.collect()
    }
    assert got == brute_force(corpus, taxa, min_tf, min_df)


def test_result_is_part_of_the_input(corpus, taxa):
    found = entity_map(match_dictionary(corpus, taxa, min_tf=1))
    keys = entity_hits(found)
    assert keys.exceptAll(corpus.select("doc_id", "sent_no")).count() == 0
    assert found.filter("entity_counts != size(entity_matches)").count() == 0


def test_counts_are_of_different_aliases(spark):
    df = spark.createDataFrame([(1, 0, "ant ant ant bee")], "doc_id long, sent_no int, sentence string")
    taxa = build_dictionary(spark.createDataFrame([("a b", "ant,bee")], DICTIONARY))
    row = entity_map(match_dictionary(df, taxa, min_tf=1, min_df=1)).first()
    assert row["entity_matches"] == {"ant": 3, "bee": 1}
    assert row["entity_counts"] == 2


def test_shared_alias_names_every_taxon(corpus, taxa):
    matched = match_dictionary(corpus, taxa, min_tf=3)
    entities = {r["entity"] for r in matched_entities(matched, taxa).filter("alias = 'bee'").collect()}
    assert entities == {"x bee", "y bee"}


def test_dictionary_vocabulary_of_a_fitted_one(corpus, taxa, monkeypatch):
    whole = {tuple(r) for r in dictionary_vocabulary(corpus, taxa).collect()}
    fitted = fit_vocabulary(marked_terms(corpus))
    assert whole
    assert {tuple(r) for r in dictionary_vocabulary(corpus, taxa, vocabulary=fitted).collect()} == whole
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 0)
    assert {tuple(r) for r in dictionary_vocabulary(corpus, taxa, vocabulary=fitted).collect()} == whole


def test_dictionary_vocabulary_both_ways(corpus, taxa, monkeypatch):
    small = {tuple(r) for r in dictionary_vocabulary(corpus, taxa).collect()}
    monkeypatch.setattr("factloom.operators.dictionary.fits_broadcast", lambda df: False)
    large = {tuple(r) for r in dictionary_vocabulary(corpus, taxa).collect()}
    assert small == large and small


def test_texts_are_split_once(spark, corpus, taxa, tmp_path):
    corpus.write.parquet(f"{tmp_path}/corpus")
    taxa.write.parquet(f"{tmp_path}/taxa")
    corpus, taxa = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("corpus", "taxa"))
    matched = match_dictionary(corpus, taxa, min_tf=1, broadcast=True)
    matched.collect()
    plan = matched._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def test_broadcast_is_measured(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"))
    assert fits_broadcast(df)
    assert not fits_broadcast(df, max_rows=99)
    assert not fits_broadcast(df, max_bytes=100)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_keeps_all_rows(spark, how):
    # Two thirds of the rows have one key.
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")
    )
    right = spark.createDataFrame([("hot", 1), ("9", 2), ("absent", 3)], "k string, v int")
    salted = lookup_join(left, right, ["k"], how, broadcast=False, spread_by=["id"])
    plain = left.join(right, ["k"], how)
    assert salted.exceptAll(plain.select(salted.columns)).count() == 0
    assert salted.count() == plain.count()


def test_hot_key_is_spread(spark):
    left = spark.range(2000).select("id", F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(left, right, ["k"], broadcast=False, spread_by=["id"])
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 1
    assert lookup.SALTS > 1


def test_stage_counts_cut_texts_once(spark, tmp_path):
    text = "Der der der hund. " * 3 + "No taxon here! Der der der again."
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, None, "en", "a", 1), (4, "", "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    found = QUERIES["stage_counts"](spark, str(tmp_path))
    assert "fulltext" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["stage"]: r["n"] for r in found.collect()}
    assert (got["papers"], got["sentences"], got["sentences with matches"]) == (4, 10, 8)
