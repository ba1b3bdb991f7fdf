import gzip
import json

import pytest
from pyspark.sql import functions as F

from factloom.functions.xml import parse_articles
from factloom.plans.ingest import done_files, ingest_articles, write_ingested
from factloom.schema import ARTICLE, JATS_PATHS
from factloom.sources import articles as A
from factloom.sources.manifest import base_name, pending
from factloom.streaming.ingest import ingest_stream

FIRST = """<article><front><article-meta>
  <article-id pub-id-type="doi">10.1/a</article-id>
  <article-id pub-id-type="pmcid">PMC1</article-id>
  <article-title>On <italic>Apis mellifera</italic> prey</article-title>
  <kwd-group><kwd>bees <italic>Apis</italic></kwd><kwd>x</kwd></kwd-group>
  <abstract><p>Abs <b>one</b> tail.</p></abstract></article-meta></front>
 <body><p>P1 <i>in</i> t <list><p>nested</p></list> end.</p><p>P2</p></body>
 <back><ref><article-title>cited</article-title></ref></back></article>"""
SECOND = """<article><front><article-meta><article-title>NoDoi</article-title></article-meta></front>
 <body><p>Q</p></body></article>"""
FILE = f"""<?xml version="1.0"?>
<articles xmlns:xlink="http://www.w3.org/1999/xlink">
{FIRST}
{SECOND}
</articles>
"""


def parsed(spark, xml, **options):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "id int, xml string")
    return parse_articles(df, **options).orderBy("id").collect()


def test_spec_and_schema():
    assert len(JATS_PATHS) == 44
    assert len(ARTICLE.fields) == 47
    assert ARTICLE.fieldNames()[-3:] == ["cprojectID", "fulltext", "abstract"]


def test_fields(spark):
    first, second = parsed(spark, [FIRST, SECOND])
    assert first["doi"] == ["10.1/a"] and first["pmcid"] == ["PMC1"]
    assert first["article-title"] == ["On Apis mellifera prey"]
    assert first["keywords"] == ["bees Apis", "x"]
    assert first["keywordList"] == ["Apis"]
    assert first["citations-titles"] == ["cited"]
    assert first["body_paragraphs"] == ["P1 in t nested end.", "P2"]
    assert first["abstract_paragraphs"] == ["Abs one tail."]
    assert second["doi"] == [] and second["article-title"] == ["NoDoi"]
    assert first["ok"] and first["reason"] is None


def test_leading_text_only(spark):
    first = parsed(spark, [FIRST], leading_text_only=True)[0]
    assert first["article-title"] == ["On "]
    markup_first = parsed(spark, [SECOND.replace("NoDoi", "<i>No</i>Doi")], leading_text_only=True)
    assert markup_first[0]["article-title"] == [None]


def test_nested_twice(spark):
    first = parsed(spark, [FIRST], nested_twice=True)[0]
    assert " ".join(first["body_paragraphs"]) == "P1 in t nested end. nested P2"


def test_a_path_that_fails_gives_nothing(spark):
    first = parsed(spark, [FIRST], paths={"doi": JATS_PATHS["doi"], "odd": ".//["})[0]
    assert first["odd"] == [] and first["doi"] == ["10.1/a"]


def test_rejects(spark):
    bad, cut, empty, null, good = parsed(
        spark, ["<article><p></article>", FIRST[:50], "", None, SECOND]
    )
    for row in (bad, cut, empty, null):
        assert not row["ok"] and row["reason"] and row["doi"] is None
    assert good["ok"]


def test_prefixes_declared_on_the_root(spark):
    linked = SECOND.replace("<p>Q</p>", '<p>Q <ext xlink:href="u">r</ext><mml:math>z</mml:math></p>')
    row = parsed(spark, [linked])[0]
    assert row["ok"] and row["body_paragraphs"] == ["Q rz"]


def test_no_rows(spark):
    assert parsed(spark, [FIRST])[0]["ok"]
    df = spark.createDataFrame([], "id int, xml string")
    assert parse_articles(df).count() == 0


@pytest.fixture()
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "PMC1_2.xml.gz").write_bytes(gzip.compress(FILE.encode()))
    (source / "notes.txt").write_text("not XML")
    return source


def test_scan_xml(spark, folder):
    rows = A.scan_xml(spark, str(folder), file_names="*.xml.gz").collect()
    assert len(rows) == 2
    assert all(r["xml"].startswith("<article>") and r["xml"].endswith("</article>") for r in rows)
    assert all(r["file"].endswith("PMC1_2.xml.gz") for r in rows)


def test_article_meta_is_no_article(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><article-set/><article id='1'><body/></article></r>")
    assert [r["xml"] for r in A.scan_xml(spark, str(tmp_path)).collect()] == [
        "<article id='1'><body/></article>"
    ]


def test_scan_single(spark, tmp_path):
    (tmp_path / "one.xml").write_text(f'<?xml version="1.0"?>\n<!DOCTYPE article>\n{FIRST}\n')
    (tmp_path / "bad.xml").write_text("nothing here")
    out = {r["ok"]: r["doi"] for r in parse_articles(A.scan_xml_single(spark, str(tmp_path))).collect()}
    assert out == {True: ["10.1/a"], False: None}


def test_records_and_json_round_trip(spark, folder, tmp_path):
    articles = A.assemble_records(A.read_articles(spark, str(folder / "*.gz")))
    assert articles.schema.fieldNames() == ARTICLE.fieldNames()
    out = str(tmp_path / "out")
    A.write_json(articles, out, compression="gzip")
    back = A.scan_json(spark, out)
    assert back.schema == ARTICLE
    assert back.exceptAll(articles).count() == 0 and back.count() == 2
    row = back.filter(F.size("doi") > 0).first()
    assert row["cprojectID"] == ["PMC1"] and row["abstract"] == "Abs one tail."
    line = json.loads(spark.read.text(out).filter("value like '%NoDoi%'").first()["value"])
    assert line["fulltext"] == "Q" and line["doi"] == []
    with pytest.raises(Exception, match="(?i)exist"):
        A.write_json(articles, out)


def test_unknown_source(spark, folder):
    with pytest.raises(ValueError):
        A.read_articles(spark, str(folder), "OTHER")


@pytest.mark.parametrize(
    "path, base",
    [
        ("eupmc/PMC1_10.json.gz", "PMC1_10"),
        ("PMC1_10.xml.gz", "PMC1_10"),
        ("a.b/plain", "plain"),
        ("x.y.z.gz", "x.y"),
        (".hidden", ".hidden"),
    ],
)
def test_base_name(spark, path, base):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(base_name(F.col("p"))).first()[0] == base


def test_pending(spark):
    listing = spark.createDataFrame([("PMC1.xml.gz",), ("PMC2.xml.gz",), ("index.html",)], "name string")
    done = spark.createDataFrame([("eupmc/PMC1.json.gz",), ("eupmc/PMC1.json.gz",)], "key string")
    assert [r["name"] for r in pending(listing, done).collect()] == ["PMC2.xml.gz"]


def test_ingest_skips_what_is_done(spark, folder, tmp_path):
    output, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    (folder / "PMC3.xml.gz").write_bytes(gzip.compress(b"<articles><article><p></article></articles>"))
    first = ingest_articles(spark, str(folder))
    assert first.articles.count() == 2 and first.rejects.count() == 1
    write_ingested(first, output, ledger)
    done = done_files(spark, ledger)
    # The file that failed is tried again, the other one is not.
    second = ingest_articles(spark, str(folder), done=done)
    assert second.articles.count() == 0 and second.rejects.count() == 1
    (folder / "PMC4.xml.gz").write_bytes(gzip.compress(FILE.replace("10.1/a", "10.1/d").encode()))
    third = ingest_articles(spark, str(folder), done=done)
    assert third.articles.count() == 2
    write_ingested(third, output, ledger)
    assert A.scan_json(spark, f"{output}/articles").count() == 4


def test_broken_files_are_rejects(spark, folder, tmp_path):
    output, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    many = FILE.replace(SECOND, "".join(SECOND.replace("Q", f"{k * k}") for k in range(4000)))
    packed = gzip.compress(many.encode())
    (folder / "cut 1.xml.gz").write_bytes(packed[: len(packed) // 2])
    (folder / "plain.xml.gz").write_bytes(b"not gzip at all")
    (folder / "empty.xml.gz").write_bytes(gzip.compress(b""))
    (folder / "garbage.xml.gz").write_bytes(gzip.compress(b"<html>nothing</html>"))
    (folder / "tail.xml.gz").write_bytes(gzip.compress(FILE.replace("</articles>", "").encode()))
    found = ingest_articles(spark, str(folder))
    reasons = {r["file"].split("/")[-1]: r["reason"] for r in found.rejects.collect()}
    none, cut = "no article could be read", "the end of the file is missing"
    assert {k: v for k, v in reasons.items() if not k.startswith("cut")} == {
        "plain.xml.gz": none, "empty.xml.gz": none, "garbage.xml.gz": none, "tail.xml.gz": cut,
    }
    assert [v for k, v in reasons.items() if k.startswith("cut")] in ([none], [cut])
    write_ingested(found, output, ledger)
    assert A.scan_json(spark, f"{output}/articles").count() == 2
    # The whole file comes in its place, and all of it is read once.
    (folder / "cut 1.xml.gz").write_bytes(packed)
    again = ingest_articles(spark, str(folder), done=done_files(spark, ledger))
    write_ingested(again, output, ledger)
    assert A.scan_json(spark, f"{output}/articles").count() == 2 + 4001
    with pytest.raises(Exception):
        ingest_articles(spark, str(folder), skip_broken=False)


def test_nothing_left_to_ingest(spark, folder):
    done = spark.createDataFrame([("PMC1_2.json.gz",)], "key string")
    assert ingest_articles(spark, str(folder), done=done).articles.count() == 0


def test_stream_reads_each_file_once(spark, folder, tmp_path):
    output, state = str(tmp_path / "parsed"), str(tmp_path / "state")

    def run():
        ingest_stream(spark, str(folder), output, state).awaitTermination(120)
        return spark.read.parquet(output).count()

    assert run() == 2
    assert run() == 2
    (folder / "PMC9.xml.gz").write_bytes(gzip.compress(FILE.encode()))
    assert run() == 4


HIDDEN = """<article><front><article-meta><article-title>{0}</article-title></article-meta></front>
 <body><p>before <![CDATA[a </article> b <!-- {0} </article> c]]> after</p>
 <!-- <article> x </article> ]]> </article> --><p>last</p></body></article>"""


def test_closing_tags_in_comments_and_cdata(spark, tmp_path):
    articles = [FIRST, HIDDEN.format("h1"), SECOND, HIDDEN.format("h2")]
    held = "<articles>" + "<!-- <article>no</article> -->".join(articles) + "</articles>"
    (tmp_path / "in").mkdir()
    for name, text in [("odd [1] é.xml.gz", held), ("plain.xml.gz", FILE)]:
        (tmp_path / "in" / name).write_bytes(gzip.compress(text.encode()))
    open_end = f"<articles>{FIRST}<article><body><p><!-- never closed</p></body></article>{SECOND}</articles>"
    (tmp_path / "in" / "open.xml.gz").write_bytes(gzip.compress(open_end.encode()))
    found = ingest_articles(spark, str(tmp_path / "in"))
    rows = found.articles.withColumn("name", base_name(F.col("file"))).collect()
    texts = sorted((r["article-title"][0], r["fulltext"]) for r in rows if "odd" in r["name"])
    body = "before a </article> b <!-- {} </article> c after last"
    assert texts == sorted(
        [("h1", body.format("h1")), ("h2", body.format("h2"))]
        + [("NoDoi", "Q"), ("On Apis mellifera prey", "P1 in t nested end. P2")]
    )
    assert sum("plain" in r["name"] for r in rows) == 2
    # A comment without an end costs the article that it is in, and no other.
    assert sorted(r["article-title"][0] for r in rows if "open" in r["name"]) == ["NoDoi", "On Apis mellifera prey"]
    rejects = [r["file"] for r in found.rejects.collect()]
    assert len(rejects) >= 1 and all("open.xml" in f for f in rejects)


def test_spans_beyond_the_bound_are_given_as_they_came():
    state = A.Rejoined("article", 30)
    assert state.add("<article>a<![CDATA[b") == []
    assert state.add("]]>c") == ["<article>a<![CDATA[b</article>]]>c"]
    assert state.add("x<!-- y") == []
    assert state.add("z" * 30) == ["x<!-- y", "z" * 30]
    assert state.add("plain <!-- gone -->text") == ["plain text"]
    assert state.add("<!-- open") == [] and state.given_up() == ["<!-- open"]
