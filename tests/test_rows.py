import pytest
from pyspark.sql import functions as F

from factloom.operators.rows import at_least, dedup_by_key, sample_by_hash, sample_rows, select_columns


@pytest.fixture(scope="module")
def articles(spark):
    rows = [
        (1, ["a"], "first"),
        (2, ["a"], "second"),
        (3, [], "none 1"),
        (4, [], "none 2"),
        (5, None, "null 1"),
        (6, None, "null 2"),
        (7, ["b", "c"], "third"),
        (8, [], "none 1"),
    ]
    return spark.createDataFrame(rows, "id long, doi array<string>, text string")


def test_first_row_per_key_and_all_without_one(articles):
    kept = dedup_by_key(articles, F.col("doi"), ["id"])
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8]
    latest = dedup_by_key(articles, F.col("doi"), [-F.col("id")])
    assert sorted(r["id"] for r in latest.collect()) == [2, 3, 4, 5, 6, 7, 8]
    assert kept.columns == articles.columns


def test_one_row_for_all_without_a_key(articles):
    kept = dedup_by_key(articles, F.col("doi"), ["id"], keep_unkeyed=False)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 5, 7]


def test_same_survivors_however_the_rows_lie(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("k"), F.lit(1).alias("v"))
    a = dedup_by_key(df.repartition(1), F.col("k"), ["id"])
    b = dedup_by_key(df.repartition(9, "v"), F.col("k"), ["id"])
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect()) == list(range(7))


def test_copies_are_combined_before_the_shuffle(spark, tmp_path):
    # A third of the rows have one key; only one of them per task is shuffled.
    df = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")
    )
    plan = dedup_by_key(df, F.col("k"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_hash_sample(spark):
    df = spark.range(20_000).withColumnRenamed("id", "key")
    some = sample_by_hash(df, "key", 0.1)
    assert 1700 < some.count() < 2300
    again = sample_by_hash(df.repartition(7), "key", 0.1)
    assert some.exceptAll(again).count() == 0
    wider = sample_by_hash(df, "key", 0.2)
    assert some.exceptAll(wider).count() == 0


def test_small_hash_sample(spark):
    some = sample_by_hash(spark.range(400_000), "id", 0.0005)
    assert 130 < some.count() < 270


def test_no_threshold_keeps_null(spark):
    df = spark.createDataFrame([(None,), (1,)], "a int")
    assert at_least(df, a=None).count() == 2


def test_bernoulli_sample(spark):
    assert 800 < sample_rows(spark.range(10_000), 0.1).count() < 1200


def test_thresholds_are_inclusive(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 1)], "a int, b int")
    assert at_least(df, a=1, b=1).count() == 2
    assert at_least(df, a=None).count() == 3
    counts = [at_least(df, a=n).count() for n in range(4)]
    assert counts == sorted(counts, reverse=True)


def test_select_columns(articles):
    assert select_columns(articles, ["text", "id"]).columns == ["text", "id"]
