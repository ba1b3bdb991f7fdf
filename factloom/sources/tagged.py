"""Tagged text: a word, its tag and its chunk label on a line, a blank line between sentences."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("words", "tags", "iob")


def chosen_labels(iob: Column, chunk_types: Collection[str] | None) -> Column:
    """Labels of the chosen chunk types; those of others become ``O``."""
    if chunk_types is None:
        return iob
    chosen = list(chunk_types)
    return F.transform(iob, lambda label: F.when(F.substr(label, F.lit(3)).isin(chosen), label).otherwise("O"))


def _fields(line: Column) -> Column:
    """The fields of a line; cut at one character, which takes no pattern to be compiled per line."""
    other = line.contains("\t") | line.contains("\r")
    plain = F.when(other, F.translate(line, "\t\r", "  ")).otherwise(line)
    return F.array_remove(F.split(plain, " "), "")


def scan_tagged(
    spark: SparkSession,
    path: str,
    chunk_types: Collection[str] | None = None,
    line_end: str = "\n",
) -> DataFrame:
    """``(doc_id, sent_no, words, tags, iob)``: one row per sentence.

    The text reader cuts files at blank lines, so plain files are split among tasks.
    ``doc_id`` is a number of the file, ``sent_no`` one of the sentence: different for all
    sentences, but with gaps and not the same for other splits of the files. Fields are cut
    at blanks. A line without a tag has the tag ``""``, one without a label ``O``; fields
    beyond the third and lines that are blank are left out.
    """
    records = spark.read.text(path, lineSep=line_end * 2).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"),
        F.monotonically_increasing_id().alias("sent_no"),
        "value",
    )
    # Whether there is a word is seen from the text: of the lists, a filter would make a second copy.
    records = records.filter(F.rlike(F.regexp_replace("value", line_end, ""), F.lit(r"[^ \t\r]")))
    lines = F.transform(F.split("value", line_end), _fields)
    rows = records.withColumn("_lines", F.filter(lines, lambda fields: F.size(fields) > 0))
    label = F.transform("_lines", lambda f: F.coalesce(F.get(f, F.lit(2)), F.lit("O")))
    return rows.select(
        "doc_id",
        "sent_no",
        F.transform("_lines", lambda f: F.get(f, F.lit(0))).alias("words"),
        F.transform("_lines", lambda f: F.coalesce(F.get(f, F.lit(1)), F.lit(""))).alias("tags"),
        chosen_labels(label, chunk_types).alias("iob"),
    )


def write_tagged(tagged: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sentences with ``words``, ``tags`` and ``iob`` as tagged text; empty ones are left out."""
    lines = F.transform(F.arrays_zip(*FIELDS), lambda t: F.concat_ws(" ", *[t[f] for f in FIELDS]))
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    tagged.filter(F.size("words") > 0).select(text.alias("value")).write.mode(mode).text(path)
