"""Ingest as a file stream: each new file is read once; the checkpoint is the ledger."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions.xml import parse_articles
from factloom.plans.ingest import file_names_of, ingest_listed, write_batch
from factloom.schema import JATS_PATHS
from factloom.sources.articles import xml_pieces
from factloom.sources.manifest import listed_files
from factloom.staging import stage


def stream_xml(
    spark: SparkSession,
    path: str,
    tag: str = "article",
    file_names: str = "*.xml.gz",
    max_files: int | None = None,
) -> DataFrame:
    """Streaming ``(file, xml)`` rows of the files that appear under ``path``."""
    reader = spark.readStream.format("text").option("lineSep", f"</{tag}>")
    reader = reader.option("pathGlobFilter", file_names)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(path).select("value", F.col("_metadata.file_path").alias("file"))
    return xml_pieces(lines, tag)


def ingest_stream(
    spark: SparkSession,
    path: str,
    output: str,
    checkpoint: str,
    *,
    paths: Mapping[str, str] = JATS_PATHS,
    file_names: str = "*.xml.gz",
    max_files: int | None = None,
    **options,
) -> StreamingQuery:
    """Parse every file not seen before into a Parquet table of parsed articles, then stop.

    Stateless, so a restart needs no more than the checkpoint. Articles that fail
    to parse are rows with ``ok`` false.
    """
    parsed = parse_articles(
        stream_xml(spark, path, file_names=file_names, max_files=max_files), paths=paths, **options
    )
    return (
        parsed.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_batches(
    spark: SparkSession,
    path: str,
    output: str,
    ledger: str,
    checkpoint: str,
    *,
    source: str = "EUPMC",
    file_names: str | None = None,
    max_files: int = 1_000,
    **options,
) -> StreamingQuery:
    """Ingest the files not seen before in batches of ``max_files``, then stop.

    The stream carries the listing alone. Each batch of it is read, checked and written as
    :func:`ingest_articles` and :func:`write_batch` do, so unreadable, empty and cut files end up
    among the rejects too. A batch that failed half-way is written anew by its number.
    Files the stream has seen are not tried again; a batch job with the same ledger does.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", file_names_of(source, file_names))
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )

    def ingest(listing: DataFrame, batch: int) -> None:
        staged = stage(listing, "listing")
        found = ingest_listed(
            listing.sparkSession, staged, source=source, file_names=file_names, **options
        )
        write_batch(found, output, ledger, batch)

    return (
        listed_files(files, path)
        .writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
