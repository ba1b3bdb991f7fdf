"""Ingest: files that are not done yet -> article records and rejects."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.xml import parse_articles
from factloom.schema import JATS_PATHS
from factloom.sources.articles import (
    assemble_records,
    cut_inside,
    rejoin_pieces,
    scan_xml_single,
    write_json,
    xml_lines,
    xml_parts,
)
from factloom.sources.manifest import (
    base_name,
    list_files,
    literal_path,
    pending,
    pending_versions,
    record_done,
    record_versions,
)
from factloom.staging import stage


@dataclass
class Ingested:
    """Article records (with their ``file``), what could not be read, and the files tried."""

    articles: DataFrame
    rejects: DataFrame
    files: DataFrame | None = None


def split_parsed(parsed: DataFrame, paths: Mapping[str, str] = JATS_PATHS) -> Ingested:
    """Records of the articles that parsed; file and reason of those that did not."""
    return Ingested(
        assemble_records(parsed.filter("ok"), paths, keep=["file"]),
        parsed.filter(~F.col("ok")).select("file", "reason"),
    )


# What the files of each source are called.
FILE_NAMES = {"EUPMC": "*.xml.gz", "PLOS": "*.xml"}


def ingest_articles(
    spark: SparkSession,
    path: str,
    *,
    done: DataFrame | None = None,
    source: str = "EUPMC",
    file_names: str | None = None,
    paths: Mapping[str, str] = JATS_PATHS,
    spread: int | None = None,
    skip_broken: bool = True,
    **options,
) -> Ingested:
    """Scan a folder, leave out files already ``done``, parse, split off rejects.

    The skip happens on the listing of files, ahead of reading any of them. ``done`` has
    the columns ``(name, length, modified)`` of a ledger by version, or ``key``: a ledger of
    names, in which files of one base name are one. See :func:`ingest_listed`.
    """
    names = file_names_of(source, file_names)
    listing = list_files(spark, path, names)
    if done is not None and "key" in done.columns:
        # The listing is filtered by name already.
        below = listing.withColumnRenamed("name", "_below").withColumn("name", F.col("path"))
        listing = pending(below, done, "").withColumn("name", F.col("_below")).drop("_below")
    elif done is not None:
        listing = pending_versions(listing, done)
    listing = stage(listing, "listing")
    inputs: str | list[str] | None = path
    if done is not None:
        inputs = None
    return ingest_listed(
        spark, listing, inputs, source=source, file_names=file_names, paths=paths,
        spread=spread, skip_broken=skip_broken, **options,
    )


def file_names_of(source: str, file_names: str | None) -> str:
    """The pattern of file names of a source, unless one is given."""
    if source not in FILE_NAMES:
        raise ValueError(f"unknown source {source!r}; known are {sorted(FILE_NAMES)}")
    return file_names or FILE_NAMES[source]


def ingest_listed(
    spark: SparkSession,
    listing: DataFrame,
    inputs: str | list[str] | None = None,
    *,
    source: str = "EUPMC",
    file_names: str | None = None,
    paths: Mapping[str, str] = JATS_PATHS,
    spread: int | None = None,
    skip_broken: bool = True,
    **options,
) -> Ingested:
    """Parse the files of ``listing``, a written table, and split off rejects.

    Parsed articles are written to a staged table once; records and rejects both
    read that. ``inputs`` may name a folder with just these files; if not, their names
    go to the reader (through the driver), with wildcards in them taken literally.

    Pieces that were cut at a closing tag inside a comment or CDATA are put together again.

    Beside articles that do not parse, rejects are files in which no article was found
    (unreadable ones among them), and files whose end is missing, which shows by an
    element that is not closed. A gzip file cut short that has no element around its
    articles cannot be told from a whole one; ``skip_broken=False`` ends the job at any
    file that cannot be unpacked.
    """
    file_names = file_names_of(source, file_names)
    if inputs is None:
        # File names only, and only those still to be read.
        inputs = [literal_path(r["path"]) for r in listing.select("path").toLocalIterator()]
    if not inputs:
        empty = spark.createDataFrame([], "file string, xml string")
        split = split_parsed(parse_articles(empty, paths=paths, **options), paths)
        return Ingested(split.articles, split.rejects, listing)
    if source == "PLOS":
        raw = scan_xml_single(spark, inputs, file_names=file_names)
        raw = raw.withColumn("unclosed", F.lit(0)).withColumn("found", F.lit(True))
    else:
        raw = found_parts(xml_lines(spark, inputs, file_names=file_names, skip_broken=skip_broken))
        raw = raw.repartition(spread) if spread else raw
    parsed = stage(parse_articles(raw, paths=paths, **options), "parsed")
    # Only files with an article cut inside a comment or CDATA are read once more.
    odd = parsed.filter("found and not ok").filter(cut_inside(F.col("reason"))).select("file").distinct()
    odd = stage(odd, "odd") if source != "PLOS" else odd.limit(0)
    names = listing.select("path", "file").join(odd, "file", "left_semi")
    again = [literal_path(row["path"]) for row in names.toLocalIterator()]
    if again:
        placed = xml_lines(spark, again, file_names=file_names, skip_broken=skip_broken, placed=True)
        whole = parse_articles(found_parts(rejoin_pieces(placed)), paths=paths, **options)
        parsed = parsed.join(odd, "file", "left_anti").unionByName(stage(whole, "rejoined"))
    split = split_parsed(parsed.filter("found"), paths)
    rejects = split.rejects.unionByName(broken_files(parsed, listing))
    return Ingested(split.articles, rejects, listing)


def found_parts(lines: DataFrame) -> DataFrame:
    """The parts of a text scan, with ``found``: whether an article is in the part."""
    return xml_parts(lines).withColumn("found", F.col("xml").isNotNull())


def broken_files(parsed: DataFrame, listing: DataFrame) -> DataFrame:
    """``(file, reason)`` of the files of ``listing`` without an article or an end."""
    files = parsed.groupBy("file").agg(
        F.sum("unclosed").alias("_unclosed"), F.max("found").alias("_found")
    )
    reason = F.when(~F.coalesce("_found", F.lit(False)), "no article could be read").when(
        F.col("_unclosed") > 0, "the end of the file is missing"
    )
    return (
        listing.select("file")
        .join(files, "file", "left")
        .select("file", reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def write_ingested(
    ingested: Ingested, output: str, ledger: str, compression: str | None = "gzip"
) -> None:
    """Append records as JSON, rejects as a table, and then note the files as done.

    A file counts as done if all of its articles were read. Of a file with a reject
    nothing is written but the reject, so that trying it again repeats no record.
    """
    broken = ingested.rejects.select("file").distinct()
    whole = ingested.articles.join(broken, "file", "left_anti")
    write_json(whole.drop("file"), f"{output}/articles", compression, "append")
    ingested.rejects.write.mode("append").parquet(f"{output}/rejects")
    # The reader gives paths with escapes, the listing plain ones.
    plain = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    record_done(whole.select(plain.alias("key")), ledger)


def write_batch(
    ingested: Ingested, output: str, ledger: str, batch: int | str, compression: str | None = "gzip"
) -> None:
    """Write what a batch ingested, then note the versions of its files as done.

    Records, rejects and ledger have a folder per batch, which is written anew: a batch
    that is written again, after a failure or by mistake, repeats nothing. As in
    :func:`write_ingested`, a file with a reject gives no records and is not done.
    """
    broken = ingested.rejects.select("file").distinct()
    whole = ingested.articles.join(broken, "file", "left_anti")
    write_json(whole.drop("file"), f"{output}/articles/batch={batch}", compression, "overwrite")
    ingested.rejects.write.mode("overwrite").parquet(f"{output}/rejects/batch={batch}")
    record_versions(ingested.files.join(broken, "file", "left_anti"), ledger, batch)


def done_files(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's ``key`` column."""
    return spark.read.schema("key string").parquet(ledger)


def file_base(file: str = "file"):
    """Base name of the file an article came from."""
    return base_name(F.col(file))
