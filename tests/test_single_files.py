"""Files of one article each: neither a folder nor a task for every few of them."""

import glob

from factloom.catalog.queries import FOLDERS, QUERIES
from factloom.sources.articles import joined_tasks, scan_xml_single


def test_small_files_share_tasks(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"{n}.xml").write_text(f"<?xml version='1.0'?>\n<article><p>{n}</p></article>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
    try:
        found = scan_xml_single(spark, str(tmp_path))
        tasks = found.rdd.getNumPartitions()
        assert sorted(r.xml for r in found.collect()) == sorted(f"<article><p>{n}</p></article>" for n in range(40))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks == joined_tasks(40, 0, spark.sparkContext.defaultParallelism) == 16


def test_tasks_are_joined_by_number_and_bytes():
    assert joined_tasks(0, 0, 4) == 1 and joined_tasks(7, 1 << 40, 4) == 7
    assert joined_tasks(64_000, 0, 4) == 1000 and joined_tasks(64_000, 2000 << 25, 4) == 2000


def test_single_files_lie_in_few_folders(spark, tmp_path):
    rows = [(n, f"u{n}", f"<b>{n}</b> & more") for n in range(90)] + [(7, "again", "x"), (90, None, "y"), (91, "z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{root}/*/single"))
    got = sorted((r.doi or "", r.fulltext or "") for r in QUERIES["scan_xml_single"](spark, str(tmp_path)).collect())
    assert got == sorted((str(i), f"{u} {h}") if u and h else ("", "") for i, u, h in rows)
    (written,) = set(glob.glob(f"{root}/*/single")) - before
    assert len(glob.glob(f"{written}/*/*.txt")) == len(rows)
    assert len(glob.glob(f"{written}/folder=*")) <= FOLDERS
