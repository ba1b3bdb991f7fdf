"""Labels of names without shuffling texts."""

from pyspark.sql import functions as F

from factloom.operators import names as N

SENTENCES = "doc_id long, sent_no int, sentence string, lang string"


def test_labels_without_words_are_the_same(spark):
    texts = ["Aa bb cc of the Aa bb", "none here", "of the", "", "Aa Aa bb of", None, "cc, of the (Aa)."]
    rows = [(d, s, text, "x") for d in range(3) for s, text in enumerate(texts)]
    # Keys that come twice, with texts of other lengths, and null keys.
    rows += [(0, 0, "of the", "y"), (1, 2, "cc of the Aa bb cc", "y"), (None, 0, "Aa bb", "x"), (None, 0, "cc", "x")]
    sentences = spark.createDataFrame(rows, SENTENCES)
    listed = [("of the", "X"), ("Aa bb", "Y"), ("Aa", "Z"), ("cc", "Z"), ("bb cc", "Y")]
    names = N.build_names(spark.createDataFrame(listed, "name string, tag string"))
    for options in ({}, {"longest_first": True}, {"join_adjacent": True, "max_rows": 0}):
        whole = N.label_names(sentences, names, **options).select("doc_id", "sent_no", "iob")
        short = N.label_names(sentences, names, with_words=False, **options)
        assert short.columns == whole.columns
        assert sorted(map(str, short.collect())) == sorted(map(str, whole.collect()))


def test_texts_are_not_shuffled(spark):
    sentences = spark.range(50).select(
        F.col("id").alias("doc_id"), (F.col("id") % 3).alias("sent_no"), F.concat(F.lit("of the "), F.col("id")).alias("sentence")
    )
    names = N.build_names(spark.createDataFrame([("of the", "X")], "name string, tag string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = N.label_names(sentences, names, with_words=False)
        plan = found._jdf.queryExecution().executedPlan()
        shuffles = [x for x in plan.toString().splitlines() if "Exchange hashpartitioning(doc_id" in x]
        wide = [x for x in str(plan.treeString()).splitlines() if "Exchange" in x and "sentence" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The numbers of words, and the hits, which are then gathered twice and joined in place.
    assert len(shuffles) == 2 and not wide
