"""Articles in: multi-article XML, single-article XML, JSON. Articles out: JSON."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.xml import parse_articles
from factloom.schema import ARTICLE, JATS_PATHS


def scan_json(spark: SparkSession, path: str, schema: T.StructType = ARTICLE) -> DataFrame:
    """Article records, one JSON object per line; the schema is not inferred."""
    return spark.read.schema(schema).json(path)


def cut_article(text: Column, tag: str = "article") -> Column:
    """A piece of a file from the first opening ``tag`` on, closed again; null if none."""
    start = F.regexp_extract(text, rf"(?s)(<{tag}[\s>].*)", 1)
    return F.when(start != "", F.concat(start, F.lit(f"</{tag}>")))


def xml_pieces(lines: DataFrame, tag: str = "article") -> DataFrame:
    """``(file, xml)`` from a text scan cut at the closing ``tag``."""
    return lines.select(F.col("file"), cut_article(F.col("value"), tag).alias("xml")).filter(
        F.col("xml").isNotNull()
    )


def xml_parts(lines: DataFrame, tag: str = "article") -> DataFrame:
    """``(file, xml, unclosed)``: all pieces of a text scan, with a null ``xml`` where no
    article is in it, and how many more elements are opened than closed ahead of it.

    Over a whole file the sum of ``unclosed`` is 0; if its end is missing, it is not.
    """
    ahead = F.get(F.split("value", rf"<{tag}[\s>]", 2), F.lit(0))
    ahead = F.regexp_replace(ahead, r"(?s)<!--.*?-->", "")
    opened = F.regexp_count(ahead, F.lit(r"<[A-Za-z_][^<>]*(?<!/)>"))
    closed = F.regexp_count(ahead, F.lit(r"</[A-Za-z_]"))
    return lines.select(
        "file", cut_article(F.col("value"), tag).alias("xml"), (opened - closed).alias("unclosed")
    )


def xml_lines(
    spark: SparkSession,
    path: str | list[str],
    tag: str = "article",
    file_names: str = "*",
    skip_broken: bool = False,
    placed: bool = False,
) -> DataFrame:
    """``(value, file)``: files cut at the closing ``tag``.

    A file that cannot be unpacked ends the job, or with ``skip_broken`` gives the
    pieces ahead of the fault. ``placed`` adds ``block`` and ``place``, the order of the
    pieces within a file.
    """
    reader = spark.read.option("pathGlobFilter", file_names)
    if skip_broken:
        reader = reader.option("ignoreCorruptFiles", "true")
    order = [
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    ]
    return reader.text(path, lineSep=f"</{tag}>").select(
        "value", F.col("_metadata.file_path").alias("file"), *(order if placed else [])
    )


class Rejoined:
    """Pieces of a file put together again where they were cut inside a comment or CDATA.

    Comments are left out of what is put together, so that a tag in one is not taken
    for an element. A span that is still open after ``longest`` characters, or at the
    end of the file, is not closed at all: its pieces are given as they came.
    """

    opening = re.compile(r"<!--|<!\[CDATA\[")
    closing = {"<!--": "-->", "<![CDATA[": "]]>"}

    def __init__(self, tag: str, longest: int) -> None:
        self.close, self.longest = f"</{tag}>", longest
        self.start()

    def start(self) -> None:
        self.pieces: list[str] = []
        self.clean: list[str] = []
        self.end, self.size = "", 0

    def given_up(self) -> list[str]:
        pieces = self.pieces
        self.start()
        return pieces

    def add(self, piece: str) -> list[str]:
        """The texts that are settled with this piece."""
        text = self.close + piece if self.pieces else piece
        self.pieces.append(piece)
        self.size += len(text)
        at = 0
        while True:
            if self.end:
                found = text.find(self.end, at)
                stop = len(text) if found < 0 else found + len(self.end)
                if self.end == "]]>":
                    self.clean.append(text[at:stop])
                if found < 0:
                    return self.given_up() if self.size > self.longest else []
                at, self.end = stop, ""
            mark = self.opening.search(text, at)
            if mark is None:
                whole = "".join(self.clean) + text[at:]
                self.start()
                return [whole]
            self.end = self.closing[mark.group()]
            self.clean.append(text[at : mark.end() if self.end == "]]>" else mark.start()])
            at = mark.end()


def rejoin_pieces(placed: DataFrame, tag: str = "article", longest: int = 1 << 26) -> DataFrame:
    """``(value, file)`` of placed pieces, without cuts inside comments or CDATA.

    The pieces of a file meet in one task, in their order, and pass through it one by
    one; no more than one article, or ``longest`` characters, is held. Meant for the few
    files that need it (:func:`cut_inside`).
    """

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, file = Rejoined(tag, longest), None
        for batch in batches:
            values: list[str] = []
            files: list[str] = []
            for piece, name in zip(batch["value"], batch["file"], strict=True):
                left = state.given_up() if name != file else []
                files += [file] * len(left)
                done = state.add(piece)
                files += [name] * len(done)
                values += left + done
                file = name
            yield pd.DataFrame({"value": values, "file": files}, dtype=object)
        left = state.given_up()
        yield pd.DataFrame({"value": left, "file": [file] * len(left)}, dtype=object)

    ordered = placed.repartition("file").sortWithinPartitions("file", "block", "place")
    return ordered.select("value", "file").mapInPandas(joined, "value string, file string")


def cut_inside(reason: Column) -> Column:
    """Whether an article did not parse because a comment or CDATA is open at its end."""
    return reason.startswith("unclosed CDATA section") | reason.startswith("unclosed token")


def scan_xml(
    spark: SparkSession,
    path: str,
    tag: str = "article",
    file_names: str = "*",
    spread: int | None = None,
) -> DataFrame:
    """``(file, xml)``: one row per article of files that hold many.

    The text reader cuts the stream at each closing tag, so no task holds a file
    as a whole and plain files are split among tasks. A gzip file is one task's
    work; ``spread`` moves its articles on to that many tasks before parsing.
    """
    pieces = xml_pieces(xml_lines(spark, path, tag, file_names), tag)
    return pieces.repartition(spread) if spread else pieces


# So many of a scan's tasks become one, unless it then reads more than so many bytes.
JOINED_TASKS = 64
TASK_BYTES = 32 * 1024 * 1024


def joined_tasks(planned: int, size: int, cores: int) -> int:
    """How many tasks to read ``size`` bytes of small files with, of those Spark ``planned``."""
    return max(1, min(planned, max(4 * cores, planned // JOINED_TASKS, size // TASK_BYTES)))


def table_bytes(df: DataFrame) -> int:
    """The size of a scan's files, as the planner has it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scan_xml_single(
    spark: SparkSession, path: str, tag: str = "article", file_names: str = "*"
) -> DataFrame:
    """``(file, xml)``: one row per file that holds one article after a prolog.

    Spark counts a small file as several megabytes, so that a task would have only a few
    of them; tasks are put together until they have enough to do.
    """
    read = spark.read.option("pathGlobFilter", file_names).text(path, wholetext=True)
    files = read.select("value", F.col("_metadata.file_path").alias("file"))
    planned = files.rdd.getNumPartitions()
    files = files.coalesce(joined_tasks(planned, table_bytes(read), spark.sparkContext.defaultParallelism))
    return files.select("file", F.regexp_extract("value", rf"(?s)(<{tag}[\s>].*)", 1).alias("xml"))


def assemble_records(
    parsed: DataFrame, paths: Iterable[str] = JATS_PATHS, keep: Iterable[str] = ()
) -> DataFrame:
    """Article records from parsed articles: paragraphs joined, ``cprojectID`` set."""
    paths = list(paths)
    project = F.col("pmcid") if "pmcid" in paths else F.lit(None).cast("array<string>")
    return parsed.select(
        *keep,
        *[F.col(f"`{name}`") for name in paths],
        project.alias("cprojectID"),
        F.array_join("body_paragraphs", " ").alias("fulltext"),
        F.array_join("abstract_paragraphs", " ").alias("abstract"),
    )


def read_articles(
    spark: SparkSession,
    path: str,
    source: str = "EUPMC",
    paths: Mapping[str, str] = JATS_PATHS,
    **options,
) -> DataFrame:
    """Parsed articles of a folder; ``source`` names the kind of collection.

    ``CORE`` and ``EUPMC`` keep many articles in a file, ``PLOS`` one.
    """
    scans = {"CORE": scan_xml, "EUPMC": scan_xml, "PLOS": scan_xml_single}
    if source not in scans:
        raise ValueError(f"source must be one of {sorted(scans)}")
    return parse_articles(scans[source](spark, path), paths=paths, **options)


def write_json(
    df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists"
) -> None:
    """JSON lines; fails if the path exists unless another mode is asked for."""
    df.write.mode(mode).json(path, compression=compression)
