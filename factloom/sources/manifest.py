"""The ingest ledger: which source files are still to be done."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """The file name without its folder and without two extensions."""
    tail = F.regexp_extract(path, r"([^/]*)$", 1)
    for _ in range(2):
        # A leading period belongs to the name; only what follows a later one is cut.
        tail = F.regexp_replace(tail, r"(?<=[^.])\.[^.]*$", "")
    return tail


def pending(listing: DataFrame, done: DataFrame, suffix: str = ".xml.gz") -> DataFrame:
    """The names of ``listing`` ending in ``suffix`` whose base name is not done.

    ``listing`` has a column ``name``, ``done`` a column ``key``.
    """
    finished = done.select(base_name(F.col("key")).alias("_base")).distinct()
    return (
        listing.filter(F.col("name").endswith(suffix))
        .withColumn("_base", base_name(F.col("name")))
        .join(finished, "_base", "left_anti")
        .drop("_base")
    )


def record_done(files: DataFrame, ledger: str) -> None:
    """Append the distinct ``key`` values of ``files`` to the ledger table."""
    files.select("key").distinct().write.mode("append").parquet(ledger)


# What tells one version of a file from another.
VERSION = ("name", "length", "modified")
VERSIONS = "name string, length long, modified timestamp"


def fixed_root(path: str) -> str:
    """The folders of ``path`` ahead of the first with a wildcard, without a scheme."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", path).strip("/")
    folders = []
    for folder in plain.split("/"):
        if re.search(r"[*?\[{]", folder):
            break
        folders.append(folder)
    return "/".join(folders)


def literal_path(path: str) -> str:
    """``path`` with what a reader takes for a wildcard made plain."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def list_files(spark: SparkSession, path: str, file_names: str = "*") -> DataFrame:
    """``(path, file, name, length, modified)`` of the files; none of them is opened.

    ``path`` is what a reader takes, ``file`` the same with escapes, as rows carry it, and
    ``name`` what comes below the folders that ``path`` names without a wildcard.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", file_names).load(path)
    return listed_files(files, path)


def listed_files(files: DataFrame, path: str) -> DataFrame:
    """:func:`list_files` of files that were found already."""
    root = fixed_root(path)
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    plain = F.ltrim(plain, F.lit("/"))
    below = F.when(plain.startswith(f"{root}/"), F.substr(plain, F.lit(len(root) + 2))).otherwise(plain)
    return files.select(
        "path",
        F.col("_metadata.file_path").alias("file"),
        below.alias("name"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def pending_versions(listing: DataFrame, done: DataFrame) -> DataFrame:
    """The files of ``listing`` whose name, length and time are not in ``done``."""
    return listing.join(done.select(*VERSION).distinct(), list(VERSION), "left_anti")


def record_versions(files: DataFrame, ledger: str, batch: int | str) -> None:
    """Note the files as done by ``batch``; noting a batch again replaces what it noted."""
    files.select(*VERSION).distinct().write.mode("overwrite").parquet(f"{ledger}/batch={batch}")


def done_versions(spark: SparkSession, ledger: str) -> DataFrame:
    """What all batches noted."""
    return spark.read.schema(VERSIONS).parquet(f"{ledger}/batch=*")
