from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, NGram, StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from factloom.operators.sentences import sentences_of
from factloom.operators.transformers import (
    ColumnSelector,
    ListConcatenator,
    ListExploder,
    SentenceSplitter,
    TripleExtractor,
    WordPunctTokenizer,
)
from factloom.operators.vocabulary import term_counts


def articles(spark):
    rows = [
        (1, "Ants eat ants and ants.", "Bees see ants. Ants eat."),
        (2, "", "Ants ants ants. Bees bees bees."),
        (3, "Ants.", "Bees of ants. Bees."),
    ]
    return spark.createDataFrame(rows, "doc_id long, abstract string, fulltext string")


def test_feature_pipeline_saved_and_loaded(spark, tmp_path):
    df = articles(spark)
    stages = [
        SentenceSplitter(inputCol="abstract", outputCol="sentences_ab"),
        SentenceSplitter(inputCol="fulltext", outputCol="sentences_ft"),
        ListConcatenator(inputCols=["sentences_ab", "sentences_ft"], outputCol="sentence_list"),
        ListExploder(inputCol="sentence_list", outputCol="sentence"),
        Tokenizer(inputCol="sentence", outputCol="words"),
        StopWordsRemover(inputCol="words", outputCol="filtered"),
        NGram(inputCol="filtered", outputCol="bigrams", n=2),
        ListConcatenator(inputCols=["filtered", "bigrams"], outputCol="raw_features"),
        ColumnSelector(outputCols=["doc_id", "sentence", "raw_features"]),
        CountVectorizer(inputCol="raw_features", outputCol="features", minTF=2, minDF=1),
    ]
    model = Pipeline(stages=stages).fit(df)
    model.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    vocabulary = loaded.stages[-1].vocabulary
    got = {
        (r["doc_id"], r["sentence"], vocabulary[i], int(n))
        for r in loaded.transform(df).collect()
        for i, n in zip(r["features"].indices, r["features"].values)
    }
    sentences = sentences_of(df)
    ours = term_counts(sentences, min_tf=2, min_df=1).join(sentences, ["doc_id", "sent_no"])
    assert got == {(r["doc_id"], r["sentence"], r["term"], r["n"]) for r in ours.collect()}


def test_tokenizer_stop_words(spark):
    df = spark.createDataFrame([("The cat, the DOG",)], "s string")
    stage = WordPunctTokenizer(inputCol="s", outputCol="w")
    assert stage.transform(df).first()["w"] == ["The", "cat", ",", "the", "DOG"]
    assert stage.setStopwords(["the", "dog"]).transform(df).first()["w"] == ["cat", ","]
    assert stage.getStopwords() == ["the", "dog"]


def test_triples_with_and_without_patterns(spark, tmp_path):
    df = spark.createDataFrame([("Ant sees Bee and Cat, ant eats bee and cat",)], "s string")
    named = TripleExtractor(inputCol="s", outputCol="t").transform(df)
    assert named.first()["t"] == [["Ant/NN", "sees/NN", "Bee/NN"]]
    assert dict(named.dtypes)["t"] == "array<array<string>>"
    stage = TripleExtractor(inputCol="s", outputCol="t", patterns=[["ant|bee|cat", "T"]])
    stage.save(str(tmp_path / "stage"))
    loaded = TripleExtractor.load(str(tmp_path / "stage"))
    for extractor in (stage, loaded):
        assert extractor.transform(df).first()["t"] == [["ant/NN", "eats/NN", "bee/NN"]]


def test_stages_need_no_python_worker(spark):
    df = TripleExtractor(inputCol="fulltext", outputCol="t", patterns=[["ant", "T"]]).transform(
        WordPunctTokenizer(inputCol="fulltext", outputCol="w").transform(articles(spark))
    )
    assert "Python" not in df.select(F.size("t"), "w")._jdf.queryExecution().executedPlan().toString()
