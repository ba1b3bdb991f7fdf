import random

import pytest
from pyspark.ml.feature import CountVectorizer, NGram, StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.stopwords import ENGLISH
from factloom.operators.sentences import (
    counted_terms,
    explode_column,
    marked_terms,
    sentences_of,
    word_columns,
)
from factloom.operators.vocabulary import fit_vocabulary, rank_vocabulary, term_counts


def one(spark, text, expression):
    df = spark.createDataFrame([(text,)], "s string")
    return df.select(expression(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, sentences",
    [
        ("Ants eat. Bees fly! Who? Me", ["Ants eat.", "Bees fly!", "Who?", "Me"]),
        ("See Fig. 2 and Dr. Smith. Then go.", ["See Fig. 2 and Dr. Smith.", "Then go."]),
        ("By J. K. Rowling. Next.", ["By J. K. Rowling.", "Next."]),
        ('He said "no." Then (Yes) left.', ['He said "no."', "Then (Yes) left."]),
        ("One.  \n Two.", ["One.", "Two."]),
        ("no capital. after the stop", ["no capital. after the stop"]),
        ("Été. Élan.", ["Été.", "Élan."]),
        ("   ", []),
        ("", []),
        (None, []),
    ],
)
def test_split_sentences(spark, text, sentences):
    assert one(spark, text, X.split_sentences) == sentences


def test_empty_text_has_no_row(spark):
    df = spark.createDataFrame(
        [(1, "A b. C d.", "E f."), (2, "", ""), (3, None, "G.")],
        "doc_id long, abstract string, fulltext string",
    )
    rows = sentences_of(df).orderBy("doc_id", "sent_no").collect()
    assert [tuple(r) for r in rows] == [
        (1, 0, "A b."),
        (1, 1, "C d."),
        (1, 2, "E f."),
        (3, 0, "G."),
    ]


def test_explode_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "k long, items array<string>")
    out = explode_column(df, "items", "item")
    assert out.columns == ["k", "items", "item"]
    assert sorted(r["item"] for r in out.collect()) == ["a", "b"]


def test_tokenizer_cases(spark):
    df = spark.createDataFrame([("The  cat\tsat, a,B ",), ("x",), ("",)], "sentence string")
    rows = word_columns(df).collect()
    assert rows[0]["words"] == ["the", "", "cat", "sat,", "a,b"]
    assert rows[0]["filtered"] == ["", "cat", "sat,", "a,b"]
    assert rows[0]["bigrams"] == [" cat", "cat sat,", "sat, a,b"]
    assert rows[0]["raw_features"] == rows[0]["filtered"] + rows[0]["bigrams"]
    assert rows[1]["bigrams"] == []
    assert rows[2]["words"] == [""]


def test_punctuation_stays_on_white_space_tokens(spark):
    assert one(spark, "Luehmannii, luehmannii", X.tokenize_ws) == ["luehmannii,", "luehmannii"]


def test_same_as_spark_ml(spark):
    random.seed(3)
    alphabet = ["the", "Cat", "sat,", "on", " ", "\t", "mat", "Ünter", "AND", ""]
    texts = [" ".join(random.choices(alphabet, k=random.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "sentence string")
    ours = word_columns(df)
    ml = Tokenizer(inputCol="sentence", outputCol="w").transform(ours)
    ml = StopWordsRemover(inputCol="w", outputCol="f").transform(ml)
    ml = NGram(inputCol="f", outputCol="b", n=2).transform(ml)
    wrong = ml.filter("w != words or f != filtered or b != bigrams")
    assert wrong.count() == 0


def test_stop_words_are_the_default_list(spark):
    assert list(StopWordsRemover.loadDefaultStopWords("english")) == ENGLISH


def test_wordpunct(spark):
    assert one(spark, "It's α-helix, n=3!?", X.tokenize_wordpunct) == [
        "It", "'", "s", "α", "-", "helix", ",", "n", "=", "3", "!?",
    ]
    assert one(spark, "The cat AND the dog", lambda c: X.tokenize_wordpunct(c, ["the", "and"])) == [
        "cat",
        "dog",
    ]


def test_bigram_bridges_a_removed_stop_word(spark):
    assert "prey ant" in one(spark, "prey of the ant", X.sentence_features)


@pytest.mark.parametrize("n, grams", [(1, ["a", "b", "c"]), (3, ["a b c"]), (4, [])])
def test_gram_sizes(spark, n, grams):
    assert one(spark, "a b c", lambda c: X.ngrams(F.split(c, " "), n)) == grams


def test_concat_any_number_of_lists_with_nulls(spark):
    df = spark.createDataFrame([(["a"], None, ["b"], ["c"])], "p array<string>, q array<string>, r array<string>, s array<string>")
    assert df.select(X.concat_lists(*map(F.col, "pqrs"))).first()[0] == ["a", "b", "c"]
    assert df.select(X.concat_lists(F.col("q"))).first()[0] == []


def test_counts_against_a_plain_count(spark):
    random.seed(5)
    lists = [[random.choice("abcde") for _ in range(random.randint(0, 30))] for _ in range(100)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<string>")
    both = df.select("x", X.count_terms(F.col("x")).alias("c"), X.repeats_last(F.col("x")).alias("m"))
    for row in both.collect():
        assert [(c["term"], c["n"]) for c in row["c"]] == sorted(
            (t, row["x"].count(t)) for t in set(row["x"])
        )
        n, terms = row["m"]["n"], row["m"]["terms"]
        assert sorted(terms) == sorted(row["x"])
        assert sorted(terms[:n]) == sorted(set(row["x"]))


def test_long_sentence_costs_its_length(spark):
    # 200,000 words without a full stop: quadratic work would not come back.
    words = " ".join(f"w{i % 5000}" for i in range(200_000))
    df = spark.createDataFrame([(1, 0, words)], "doc_id long, sent_no int, sentence string")
    assert counted_terms(df).count() == 5000 + 5000


def sentence_rows(spark, texts):
    return spark.createDataFrame(
        [(1, i, t) for i, t in enumerate(texts)], "doc_id long, sent_no int, sentence string"
    )


def test_vocabulary_and_counts(spark):
    df = sentence_rows(spark, ["q q q w", "q w e e e", "q w w w"])
    vocabulary = fit_vocabulary(marked_terms(df))
    assert sorted(tuple(r) for r in vocabulary.collect()) == [("q", 3, 5), ("q w", 3, 3), ("w", 3, 5)]
    assert sorted(tuple(r) for r in term_counts(df).collect()) == [(1, 0, "q", 3), (1, 2, "w", 3)]
    at_one = term_counts(df, min_tf=1).collect()
    assert {r["term"] for r in at_one} == {"q", "w", "q w"}


def test_counts_same_as_count_vectorizer(spark):
    random.seed(11)
    texts = [" ".join(random.choices("kl mn op qr st uv".split(), k=random.randint(1, 25))) for _ in range(120)]
    df = sentence_rows(spark, texts)
    featured = df.withColumn("f", X.sentence_features(F.col("sentence")))
    model = CountVectorizer(inputCol="f", outputCol="v", minTF=3, minDF=3).fit(featured)
    names = model.vocabulary
    expected = set()
    for row in model.transform(featured).collect():
        for i, n in zip(row["v"].indices, row["v"].values):
            expected.add((1, row["sent_no"], names[i], int(n)))
    assert {tuple(r) for r in term_counts(df).collect()} == expected
    fitted = fit_vocabulary(marked_terms(df))
    assert {r["term"] for r in fitted.collect()} == set(names)
    other = fit_vocabulary(counted_terms(df))
    assert fitted.exceptAll(other).count() == 0 and other.exceptAll(fitted).count() == 0


def test_shares_instead_of_counts(spark):
    df = sentence_rows(spark, ["q q q", "q w", "e"])
    counts = term_counts(df, min_tf=0.5, min_df=0.5)
    # "q q q" has five features, three of them "q"; "q w" has three, one of them "q".
    assert {(r["sent_no"], r["term"]) for r in counts.collect()} == {(0, "q")}
    with pytest.raises(ValueError):
        fit_vocabulary(marked_terms(df), min_df=0.5)


def test_rank_and_cap(spark):
    df = sentence_rows(spark, ["b a c", "b a", "b d"])
    ranked = rank_vocabulary(fit_vocabulary(marked_terms(df), min_df=1)).orderBy("idx").collect()
    assert [r["idx"] for r in ranked] == list(range(len(ranked)))
    assert [(r["tf"], r["term"]) for r in ranked] == sorted(
        ((r["tf"], r["term"]) for r in ranked), key=lambda x: (-x[0], x[1])
    )
    capped = fit_vocabulary(marked_terms(df), min_df=1, vocab_size=2)
    assert {r["term"] for r in capped.collect()} == {r["term"] for r in ranked[:2]}


def test_blanks_of_publishers(spark):
    df = spark.createDataFrame([("c\u00a0d\u2009e\u202ff",)], "s string")
    assert df.select(X.tokenize_wordpunct(F.col("s"))).first()[0] == ["c", "d", "e", "f"]
    df = spark.createDataFrame([("One ended.\u00a0Two began.",)], "s string")
    assert df.select(X.split_sentences(F.col("s"))).first()[0] == ["One ended.", "Two began."]
    df = spark.createDataFrame([("A\x0bb",)], "s string")
    assert df.select(X.tokenize_ws(F.col("s"))).first()[0] == ["a", "b"]


def test_tokens_of_sentences_with_odd_blanks(spark):
    texts = ["a b", " a  b ", "a\tb\x0b", "\t a", "a\n", "   ", "\t\t", "", "ÄB c\u00a0d ", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    words = X.tokenize_ws(F.col("s"))
    assert "rlike" not in str(words).lower()
    got = [r["w"] for r in df.select(words.alias("w")).collect()]
    assert got == [
        ["a", "b"], ["", "a", "", "b"], ["a", "b"], ["", "", "a"], ["a"], [], [], [""], ["äb", "c\u00a0d"], None
    ]
