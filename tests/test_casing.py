from factloom.operators import casing
from factloom.operators.casing import cased_triples, learn_casing
from factloom.operators.relations import named_triples

SENTENCES = [
    "When Apis met Bombus and Vespa ate.",
    "Apis ate Bombus near Vespa.",
    '"Eating Apis hurt Bombus, Vespa said.',
    "We saw Apis eating when it rained.",
    "1 2 3",
    "",
    None,
]


def rows(spark, listed=SENTENCES):
    return spark.createDataFrame(list(enumerate([[s] for s in listed])), "doc_id int, s array<string>").selectExpr(
        "doc_id", "0 as sent_no", "s[0] as sentence"
    )


def subjects(found):
    return {r["doc_id"]: [t["subj"] for t in r["triples"]] for r in found.collect()}


def test_counts_leave_first_words_out(spark):
    got = {r["word"]: (r["n_capital"], r["n_small"]) for r in learn_casing(rows(spark)).collect()}
    assert got["apis"] == (3, 0) and got["when"] == (0, 1) and got["eating"] == (0, 1)
    assert "we" not in got and "1" not in got


def test_first_words(spark, monkeypatch):
    sentences = rows(spark)
    table = learn_casing(sentences)
    found = subjects(cased_triples(sentences, table))
    # The first word of 0 and 2 is no name, that of 1 is.
    assert found[0] == ["Apis/NN"] and found[1] == ["Apis/NN"] and found[2] == ["Apis/NN"]
    assert found[4] == found[5] == []
    every = subjects(named_triples(sentences))
    assert len(every[0]) == 1 and every[0] != found[0]
    monkeypatch.setattr(casing, "fits_broadcast", lambda _: False)
    assert subjects(cased_triples(sentences, table)) == found


def test_empty_tables(spark):
    none = rows(spark).filter("false")
    assert learn_casing(none).count() == 0
    found = subjects(cased_triples(rows(spark), learn_casing(none)))
    assert found[1] == [] and found[0] == ["Apis/NN"]
