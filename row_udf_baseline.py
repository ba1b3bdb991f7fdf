"""The same steps with row-at-a-time Python functions, for comparison only.

This is how such a job looks when each step is a Python function over one row:
tokens and counts are made in Python workers, the vocabulary is collected by
``CountVectorizer``, and dictionary terms are looked up in a Python set.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.ml.feature import CountVectorizer, NGram, StopWordsRemover, Tokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.catalog.fixtures import TAXON_WORDS, taxa
from factloom.catalog.queries import QUERIES
from factloom.catalog.tables import documents
from factloom.functions.tags import DETERMINERS, PREPOSITIONS, VERB_ENDINGS
from factloom.functions.text import ABBREVIATIONS

STRINGS = T.ArrayType(T.StringType())
COUNTS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]))
BLANKS = " \t\n\f\r"
STOP = re.compile(r"([.!?][\"'”’)\]]{0,2})[ \t\n\f\r]+(?=[\"'“‘(\[]{0,2}[A-ZÀ-ÖØ-Þ])")
TOKEN = re.compile(r"\w+|[^\w\s]+")


def split(text: str) -> list[str]:
    out, start = [], 0
    for match in STOP.finditer(text):
        end = match.end(1)
        before = re.search(r"(?:^|[^\w])([\w.]+)\.$", text[max(0, end - 20) : end])
        if before and (
            before.group(1) in ABBREVIATIONS or (len(before.group(1)) == 1 and before.group(1).isupper())
        ):
            continue
        out.append(text[start:end])
        start = match.end()
    out.append(text[start:])
    return [s for s in out if s.strip(BLANKS)]


def tag(word: str) -> str:
    low = word.lower()
    if low in DETERMINERS:
        return "DT"
    if low in PREPOSITIONS:
        return "IN"
    if not any(c.isalpha() for c in word):
        return "SYM"
    return "VB" if low.endswith(tuple(VERB_ENDINGS)) else "NN"


def related(sentence: str) -> list[list[str]]:
    chunks: list[list[list[str]]] = []
    inside = False
    for word in TOKEN.findall(sentence):
        pos = tag(word)
        shown = f"{word}/{pos}"
        if pos == "VB":
            if inside:
                chunks[-1][0].append(shown)
            else:
                chunks.append([[shown], []])
            inside = True
        else:
            if chunks:
                chunks[-1][1].append(shown)
            inside = False
    texts = [(" ".join(c[0]), " ".join(c[1])) for c in chunks]
    return [[texts[k][0], texts[k][1], texts[k + 1][0]] for k in range(len(texts) - 2)]


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.udf(split, STRINGS)
    return documents(spark, sf_dir).select(
        "doc_id", F.posexplode(cut("fulltext")).alias("sent_no", "sentence")
    )


def entity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Tokenizer(inputCol="sentence", outputCol="words").transform(sentences(spark, sf_dir))
    df = StopWordsRemover(inputCol="words", outputCol="filtered").transform(df)
    df = NGram(inputCol="filtered", outputCol="bigrams", n=2).transform(df)
    df = df.withColumn("features", F.udf(lambda a, b: a + b, STRINGS)("filtered", "bigrams")).cache()
    model = CountVectorizer(inputCol="features", outputCol="v", minTF=3, minDF=3).fit(df)
    wanted = set(TAXON_WORDS) | {f"taxon {w}" for w in TAXON_WORDS}
    names = {i: t for i, t in enumerate(model.vocabulary) if t in wanted}
    known = spark.sparkContext.broadcast(names)

    def hits(vector):
        return sorted(
            (known.value[i], int(n)) for i, n in zip(vector.indices, vector.values) if i in known.value
        )

    found = model.transform(df).withColumn("matches", F.udf(hits, COUNTS)("v"))
    return found.filter(F.size("matches") > 0).select("doc_id", "sent_no", "sentence", "matches")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = F.udf(related, T.ArrayType(STRINGS))
    return sentences(spark, sf_dir).select("doc_id", "sent_no", F.explode(triples("sentence")).alias("r"))


def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.udf(split, STRINGS)("fulltext").alias("s"))


def raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.functions.stopwords import ENGLISH

    stop = set(ENGLISH)

    def features(sentence: str) -> list[str]:
        words = [w for w in re.split(r"[ \t\n\f\r]", sentence.rstrip(BLANKS).lower()) if w not in stop]
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    return sentences(spark, sf_dir).select(
        "doc_id", "sent_no", F.udf(features, STRINGS)("sentence").alias("features")
    )


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    def per_sentence(features: list[str]) -> list[tuple[str, int]]:
        return list(Counter(features).items())

    counted = raw_features(spark, sf_dir).select(
        F.explode(F.udf(per_sentence, COUNTS)("features")).alias("c")
    )
    fitted = counted.groupBy("c.term").agg(F.count("*").alias("df"), F.sum("c.n").alias("tf"))
    return fitted.filter("df >= 3").orderBy(F.desc("tf"), "term")


STEPS = {
    "split_sentences": split_sentences,
    "raw_features": raw_features,
    "vocabulary": vocabulary,
    "entity_matches": entity_matches,
    "relations": relations,
}


def times(spark: SparkSession, sf_dir: str, timed) -> dict[str, float]:
    """Seconds per step, after checking the number of rows against the native query."""
    taxa(spark)
    out = {}
    for name, make in STEPS.items():
        ours, theirs = QUERIES[name](spark, sf_dir).count(), make(spark, sf_dir).count()
        if ours != theirs:
            raise AssertionError(f"{name}: {ours} rows, {theirs} with row functions")
        out[name] = timed(make, spark, sf_dir)
    return out
