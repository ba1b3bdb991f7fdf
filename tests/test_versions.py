import gzip
import os

import pytest

from factloom.plans.ingest import ingest_articles, write_batch
from factloom.schema import ARTICLE
from factloom.sources.manifest import done_versions, fixed_root, list_files, literal_path
from factloom.streaming.ingest import stream_batches


def packed(*keys, end="</articles>"):
    listed = "".join(
        f"<article><front><article-meta><article-id pub-id-type='doi'>{k}</article-id></article-meta></front><body><p>{k}</p></body></article>"
        for k in keys
    )
    return gzip.compress(f"<articles>{listed}{end}".encode())


@pytest.fixture()
def folders(tmp_path):
    for name, keys in (("a", ["1", "2"]), ("b", ["3"])):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "X.xml.gz").write_bytes(packed(*keys))
    return tmp_path / "in"


def articles(spark, output):
    rows = spark.read.schema(ARTICLE).json(f"{output}/articles").select("doi", "batch").collect()
    return sorted((r["doi"][0], str(r["batch"])) for r in rows)


def rejects(df):
    return sorted((r["file"].split("/")[-1], r["reason"]) for r in df.collect())


@pytest.mark.parametrize(
    "path, root",
    [
        ("s3a://bucket/xml/*.gz", "bucket/xml"),
        ("/a/b/", "a/b"),
        ("file:///a/[x]/b", "a"),
        ("*", ""),
    ],
)
def test_fixed_root(path, root):
    assert fixed_root(path) == root


def test_names_below_the_root(spark, folders):
    found = list_files(spark, f"{folders}/*", "*.xml.gz")
    assert sorted(r["name"] for r in found.collect()) == ["a/X.xml.gz", "b/X.xml.gz"]
    assert sorted(r["name"] for r in list_files(spark, f"{folders}/a").collect()) == ["X.xml.gz"]


def test_one_base_name_in_two_folders(spark, folders, tmp_path):
    output, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    write_batch(ingest_articles(spark, f"{folders}/[a]"), output, ledger, "first")
    # The ledger knows the file of the other folder under another name.
    done = list_files(spark, f"{folders}/*").filter("name like 'a/%'")
    second = ingest_articles(spark, f"{folders}/*", done=done)
    write_batch(second, output, ledger, "second")
    assert articles(spark, output) == [("1", "first"), ("2", "first"), ("3", "second")]


def test_replaced_files_are_read_again_and_repeats_are_not(spark, folders, tmp_path):
    output, ledger, path = str(tmp_path / "out"), str(tmp_path / "ledger"), f"{folders}/*"
    first = ingest_articles(spark, path)
    for _ in range(2):
        write_batch(first, output, ledger, 0)
    assert articles(spark, output) == [("1", "0"), ("2", "0"), ("3", "0")]
    assert done_versions(spark, ledger).count() == 2
    assert ingest_articles(spark, path, done=done_versions(spark, ledger)).articles.count() == 0
    (folders / "b" / "X.xml.gz").write_bytes(packed("4", "5"))
    # The same bytes at another time count as another version as well.
    os.utime(folders / "a" / "X.xml.gz", (1_000_000_000, 1_000_000_000))
    second = ingest_articles(spark, path, done=done_versions(spark, ledger))
    assert sorted(r["doi"][0] for r in second.articles.collect()) == ["1", "2", "4", "5"]


def test_wildcards_in_names(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, name in enumerate(["[a].xml.gz", "{b,c}.xml.gz", "d 1%.xml.gz", "a.xml.gz"]):
        (source / name).write_bytes(packed(str(i)))
    listing = list_files(spark, str(source))
    done = listing.filter("name = 'a.xml.gz'")
    found = ingest_articles(spark, str(source), done=done)
    assert sorted(r["doi"][0] for r in found.articles.collect()) == ["0", "1", "2"]
    assert found.rejects.count() == 0
    output, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    write_batch(found, output, ledger, 1)
    assert done_versions(spark, ledger).count() == 3
    assert literal_path("/x/[a]") == "/x/\\[a\\]"


def test_stream_rejects_what_the_batch_job_does(spark, folders, tmp_path):
    output, ledger, state = (str(tmp_path / n) for n in ("out", "ledger", "state"))
    (folders / "a" / "plain.xml.gz").write_bytes(b"not gzip at all")
    (folders / "a" / "empty.xml.gz").write_bytes(gzip.compress(b""))
    (folders / "b" / "tail.xml.gz").write_bytes(packed("6", end=""))
    (folders / "b" / "bad.xml.gz").write_bytes(gzip.compress(b"<articles><article><p></article></articles>"))
    expected = rejects(ingest_articles(spark, f"{folders}/*").rejects)

    def run():
        stream_batches(spark, f"{folders}/*", output, ledger, state, max_files=2).awaitTermination(180)
        return [doi for doi, _ in articles(spark, output)]

    assert run() == ["1", "2", "3"]
    found = rejects(spark.read.parquet(f"{output}/rejects"))
    assert found == expected and len(found) == 4
    assert run() == ["1", "2", "3"]
    (folders / "b" / "Y.xml.gz").write_bytes(packed("7"))
    assert run() == ["1", "2", "3", "7"]
    # The batch job tries the broken files again, and only them.
    again = ingest_articles(spark, f"{folders}/*", done=done_versions(spark, ledger))
    assert again.articles.select("doi").collect() == [(["6"],)] and rejects(again.rejects) == expected


def test_nothing_to_do(spark, folders):
    done = list_files(spark, f"{folders}/*")
    found = ingest_articles(spark, f"{folders}/*", done=done)
    assert found.articles.count() == found.rejects.count() == found.files.count() == 0
