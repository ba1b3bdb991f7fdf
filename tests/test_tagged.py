import pytest
from pyspark.sql import functions as F

from factloom.operators.chunking import chunk_features, load_chunker, tag_chunks, train_chunker
from factloom.sources.tagged import scan_tagged, write_tagged

TEXT = """He PRP B-NP
eats VBZ B-VP
the DT B-NP extra
bee NN I-NP

 \t
of\tIN\tB-PP
it PRP


alone
end . O"""


def listed(df):
    return sorted((r["words"], r["tags"], r["iob"]) for r in df.collect())


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_sentences_of_lines(spark, tmp_path, line_end):
    (tmp_path / "a.txt").write_bytes(TEXT.replace("\n", line_end).encode())
    assert listed(scan_tagged(spark, str(tmp_path), line_end=line_end)) == [
        (["He", "eats", "the", "bee"], ["PRP", "VBZ", "DT", "NN"], ["B-NP", "B-VP", "B-NP", "I-NP"]),
        (["alone", "end"], ["", "."], ["O", "O"]),
        (["of", "it"], ["IN", "PRP"], ["B-PP", "O"]),
    ]


def test_chosen_types(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    found = scan_tagged(spark, str(tmp_path), ["NP", "PP"])
    assert listed(found)[0][2] == ["B-NP", "O", "B-NP", "I-NP"] and listed(found)[2][2] == ["B-PP", "O"]
    assert listed(scan_tagged(spark, str(tmp_path), []))[0][2] == ["O"] * 4


def test_round_trip_over_split_files(spark, tmp_path):
    rows = [(i, 0, [f"w{i}", "x"], ["NN", "VB"], ["B-NP", "O"]) for i in range(500)]
    rows.append((500, 0, [], [], []))
    schema = "doc_id long, sent_no int, words array<string>, tags array<string>, iob array<string>"
    tagged = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "out")
    write_tagged(tagged.coalesce(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = scan_tagged(spark, path)
        assert found.rdd.getNumPartitions() > 4
        assert listed(found) == sorted((r[2], r[3], r[4]) for r in rows[:-1])
        assert found.select("doc_id", "sent_no").distinct().count() == 500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_model_is_trained_from_it(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n\n".join(["a DT B-NP\nbee NN I-NP\neats VB O"] * 5) + "\n")
    sentences = scan_tagged(spark, str(tmp_path))
    model = load_chunker(train_chunker(chunk_features(sentences)))
    labels = tag_chunks(chunk_features(sentences.drop("iob")), model)
    assert {(r["word"], r["iob"]) for r in labels.select("word", "iob").collect()} == {
        ("a", "B-NP"), ("bee", "I-NP"), ("eats", "O"),
    }
    assert sentences.filter(F.col("sent_no").isNull()).count() == 0
