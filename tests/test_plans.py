import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from factloom.catalog.oracles import ORACLES
from factloom.catalog.queries import QUERIES
from factloom.functions.tags import verb_phrase_iob
from factloom.operators.chunking import chunk_features, load_chunker, train_chunker
from factloom.operators.dictionary import build_dictionary
from factloom.operators.sentences import sentences_of
from factloom.operators.tagging import tag_sentences
from factloom.operators.rows import with_doc_id
from factloom.plans.counts import StageCounts
from factloom.plans.interactions import RESULT, extract_interactions, result_records, run_interactions
from factloom.schema import DICTIONARY
from factloom.sources.articles import write_json

SF = "/root/testdata/sf0.001"
# A sample of a two-thousandth has no row of the smallest tables.
LARGER = {"sample_hash_small": "/root/testdata/sf0.01"}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def articles(spark):
    texts = [
        "Bees walked and the ants then killed beetles eating leaves. Nothing here.",
        "Bees slept. The bees walked near ants that spreaded and killed plants growing there.",
        "Foxes ran.",
        "",
    ]
    rows = [(i, [f"10/{i}"], "" if i else "Bees again.", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, doi array<string>, abstract string, fulltext string")


@pytest.fixture(scope="module")
def parts(spark, articles):
    rows = [("x bees", "bees"), ("x ants", "ants,old foxes")]
    dictionary = build_dictionary(spark.createDataFrame(rows, DICTIONARY))
    tagged = tag_sentences(sentences_of(articles))
    labelled = tagged.withColumn("iob", verb_phrase_iob(F.col("tags")))
    return dictionary, load_chunker(train_chunker(chunk_features(labelled)))


def run(articles, parts, **options):
    return extract_interactions(articles, *parts, min_tf=1, min_df=1, **options)


def test_label_bound_is_a_parameter(spark):
    model = spark.createDataFrame([], "fname string, fval string, label string, n long")
    rows = [("pos", "NN", f"B-{k}", 1) for k in range(3)]
    with pytest.raises(ValueError, match="more than 2 labels"):
        load_chunker(spark.createDataFrame(rows, model.schema), max_labels=2)


def test_all_hit_sentences_come_back(articles, parts):
    rows = {(r["doc_id"], r["sent_no"]): r for r in run(articles, parts).collect()}
    assert set(rows) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert rows[0, 0]["sentences"] == "Bees again."
    assert rows[1, 1]["entity_matches"] == {"bees": 1, "ants": 1}
    assert all(r["triples_counts"] == len(r["triples"]) for r in rows.values())
    assert all(r["entity_counts"] == len(r["entity_matches"]) for r in rows.values())
    assert rows[1, 0]["triples"] == []


def test_hint_and_placement_do_not_change_the_result(articles, parts):
    with_hint = {tuple(map(str, r)) for r in run(articles, parts).collect()}
    without = {tuple(map(str, r)) for r in run(articles, parts, hint=None).collect()}
    assert with_hint == without


def test_thresholds_only_take_away(articles, parts):
    everything = {(r["doc_id"], r["sent_no"]) for r in run(articles, parts).collect()}
    some = run(articles, parts, min_entities=2, min_triples=1).collect()
    assert {(r["doc_id"], r["sent_no"]) for r in some} <= everything
    assert all(r["entity_counts"] >= 2 and r["triples_counts"] >= 1 for r in some)


def test_own_pattern_is_not_cut_by_the_default_hint(articles, parts):
    rows = run(articles, parts, pattern=".*").collect()
    assert any(r["triples_counts"] for r in rows)


def test_document_ids(spark):
    rows = [(["a"], "x"), (["a"], "b"), (["a", "c"], "x"), ([], "u"), ([], "u"), (None, "u"), (None, None)]
    df = spark.createDataFrame(rows, "doi array<string>, abstract string")
    found = with_doc_id(df).collect()
    assert sorted((str(r["doi"]), str(r["abstract"])) for r in found) == sorted(
        (str(doi), str(text)) for doi, text in rows if (doi, text) != (["a"], "x")
    )
    assert len({r["doc_id"] for r in found}) == 6
    again = with_doc_id(df.repartition(3)).collect()
    assert {r["doc_id"] for r in again} == {r["doc_id"] for r in found}
    assert with_doc_id(df.limit(0)).count() == 0


def test_from_path_to_path(spark, articles, parts, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    # The first article comes twice; the last has no doi.
    doi = F.when(F.col("doc_id") < 3, F.col("doi")).otherwise(F.array().cast("array<string>"))
    write_json(articles.unionAll(articles.filter("doc_id = 0")).withColumn("doi", doi).drop("doc_id"), source)
    (tmp_path / "names.csv").write_text('x bees;bees\nx ants;"ants,old foxes"\n')
    run_interactions(spark, source, str(tmp_path / "names.csv"), output, parts[1], min_tf=1, min_df=1)
    back = spark.read.schema(result_records(run(articles, parts)).schema).json(output)
    expected = result_records(run(articles, parts))
    assert sorted(map(str, back.collect())) == sorted(map(str, expected.collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        run_interactions(spark, source, str(tmp_path / "names.csv"), output, parts[1])


def test_result_record(spark, articles, parts, tmp_path):
    records = result_records(run(articles, parts))
    assert tuple(records.columns) == RESULT
    assert dict(records.dtypes) == {
        "doi": "array<string>",
        "sentences": "string",
        "entity_matches": "map<string,int>",
        "entity_counts": "int",
        "triples": "array<array<string>>",
        "triples_counts": "int",
    }
    write_json(records, str(tmp_path / "out"))
    assert spark.read.schema(records.schema).json(str(tmp_path / "out")).count() == 4


def test_one_shuffle_of_sentences(spark, articles, parts, tmp_path):
    articles.write.parquet(f"{tmp_path}/articles")
    found = run(spark.read.parquet(f"{tmp_path}/articles"), parts, min_entities=1, min_triples=1)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_sentence = [
        line
        for line in plan.splitlines()
        if "Exchange hashpartitioning(doc_id" in line and "Reused" not in line
    ]
    assert len(by_sentence) == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_counts_of_a_run(spark, articles, parts, tmp_path):
    articles.write.parquet(f"{tmp_path}/articles")
    counts = StageCounts()
    found = run(
        spark.read.parquet(f"{tmp_path}/articles"), parts, min_entities=1, min_triples=1, counts=counts
    )
    rows = found.collect()
    held = counts.get()
    assert list(held) == [
        "articles", "sentences", "sentences with matches", "sentences with enough entities", "interactions"
    ]
    assert held["articles"] == articles.count()
    assert held["sentences"] == sentences_of(articles).count()
    assert held["sentences"] > held["sentences with matches"] >= held["interactions"] == len(rows)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("FileScan parquet" in line and "fulltext" in line for line in plan.splitlines()) == 1
    with pytest.raises(ValueError):
        counts.of("articles", articles)


def test_counts_where_sentences_without_the_hint_are_kept(spark, articles, parts):
    counts = StageCounts()
    rows = run(articles, parts, min_triples=0, counts=counts).collect()
    assert counts.get()["interactions"] == counts.get()["sentences with matches"] == len(rows)


def tables_in_duckdb(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    sf_dir = LARGER.get(name, SF)
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    relation = tables_in_duckdb(sf_dir).execute(ORACLES[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(row[i] for i in order) for row in relation.fetchall()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert got


def test_entry(spark):
    assert contract.entry(spark).count() > 0
