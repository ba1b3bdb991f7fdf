"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) say
where and on how many cores. ``--row-udf`` also times the same steps written with
row-at-a-time Python functions (see ``row_udf_baseline.py``), checks that both
give the same rows, and adds the times as ``row_udf``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from factloom.catalog.queries import QUERIES  # noqa: E402

HEADLINE = [
    "split_sentences",
    "tokenize_ws",
    "tokenize_wordpunct",
    "raw_features",
    "vocabulary",
    "term_counts",
    "dictionary_vocab",
    "entity_matches",
    "dedup_by_key",
    "extract_metadata",
    "ingest_articles",
    "pos_tag",
    "chunk_features",
    "nb_train",
    "nb_tag",
    "relations",
    "triples",
    "gazetteer_iob",
    "triples_gazetteer",
    "interaction_workflow",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("factloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_all(df: DataFrame) -> None:
    """Compute every row and column of ``df`` without keeping any."""
    df.write.format("noop").mode("overwrite").save()


def timed(make, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    run_all(make(spark, sf_dir))
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    # One small query first, so that the JVM's start is not charged to the first one.
    run_all(QUERIES["relations"](spark, sf_dir))
    seconds = {name: timed(QUERIES[name], spark, sf_dir) for name in HEADLINE}
    result = {
        "metric": "headline queries, total time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    if "--row-udf" in sys.argv:
        import row_udf_baseline

        result["row_udf"] = row_udf_baseline.times(spark, sf_dir, timed)
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
