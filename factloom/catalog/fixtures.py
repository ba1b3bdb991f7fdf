"""Inputs the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.catalog.tables import documents, table
from factloom.functions.text import tokenize_wordpunct
from factloom.operators.dictionary import build_dictionary
from factloom.operators.sentences import sentences_of
from factloom.schema import DICTIONARY
from factloom.staging import fresh_path

# The prose of the documents is made up, so the dictionary lists syllables that
# occur in it. None of them is a stop word.
TAXON_WORDS = (
    "de der la die le und que des er ed ing ea nd ther ble th thwh en thes eath".split()
)

# Patterns for the gazetteer queries: one word, two words, and an overlap of both.
GAZETTEER_PATTERNS = [
    ("the [a-z]+", "DET"),
    ("[Tt]he", "ART"),
    ("of (the|a)", "PRE"),
    ("[Dd]e la", "FR"),
    ("la [a-zé]+", "FR"),
]


def taxa(spark: SparkSession) -> DataFrame:
    """The dictionary the documents are matched with."""
    rows = [(f"taxon {word}", f"taxon {word}") for word in TAXON_WORDS]
    return build_dictionary(spark.createDataFrame(rows, DICTIONARY))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences of the documents."""
    return sentences_of(documents(spark, sf_dir))


def dictionary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary rows made of the parts table.

    Two-word names come up many times with different aliases; one-word and
    three-word entities are to be dropped.
    """
    part = table(spark, sf_dir, "part")
    listed = part.select(
        F.col("p_name").alias("entity"),
        F.concat("p_name", F.lit(", "), F.upper("p_brand"), F.lit(","), "p_type").alias("aliases"),
    )
    one_word = part.select(F.col("p_type"), F.col("p_name"))
    three_words = part.select(F.concat_ws(" ", "p_name", "p_type"), F.col("p_name"))
    return listed.union(one_word).union(three_words)


def dictionary_file(spark: SparkSession, sf_dir: str) -> str:
    """The entries written as a ``;``-separated file; returns its path."""
    path = fresh_path(spark, "dictionary")
    dictionary_entries(spark, sf_dir).write.csv(path, sep=";", quote='"', escape='"')
    return path


def escaped(text: Column) -> Column:
    """Text with the three characters replaced that XML does not allow in it."""
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def article_xml() -> Column:
    """An article made of a document: one paragraph per line, the language as title."""
    paragraphs = F.replace(escaped(F.col("fulltext")), F.lit("\n"), F.lit("</p><p>"))
    return F.concat(
        F.lit('<article><front><journal-meta><journal-id journal-id-type="nlm-ta">'),
        F.col("source"),
        F.lit('</journal-id></journal-meta><article-meta><article-id pub-id-type="doi">'),
        F.col("doc_id").cast("string"),
        F.lit('</article-id><article-id pub-id-type="pmcid">PMC'),
        F.col("doc_id").cast("string"),
        F.lit("</article-id><title-group><article-title>On <italic>"),
        F.col("lang"),
        F.lit("</italic> prose</article-title></title-group><kwd-group><kwd>"),
        F.col("lang"),
        F.lit("</kwd><kwd>"),
        F.col("source"),
        F.lit("</kwd></kwd-group><abstract><p>Abstract of "),
        F.col("source"),
        F.lit("</p></abstract></article-meta></front><body><p>"),
        paragraphs,
        F.lit("</p></body></article>"),
    )


def xml_files(spark: SparkSession, sf_dir: str) -> str:
    """All documents written as files of many articles, gzipped; returns the folder."""
    path = fresh_path(spark, "xml")
    documents(spark, sf_dir).select(article_xml().alias("value")).write.text(
        path, compression="gzip"
    )
    return path


def xml_folders(spark: SparkSession, sf_dir: str, path: str, english: bool) -> None:
    """The documents in English, or all others, as XML files in a folder of ``path``."""
    is_english = F.coalesce(F.col("lang") == "en", F.lit(False))
    documents(spark, sf_dir).filter(is_english if english else ~is_english).select(
        article_xml().alias("value")
    ).write.text(f"{path}/{'english' if english else 'other'}", compression="gzip")


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article records, with the fields that documents can fill."""
    return documents(spark, sf_dir).select(
        F.array(F.col("doc_id").cast("string")).alias("doi"),
        F.array("source", "lang").alias("keywords"),
        "fulltext",
        "abstract",
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of how the sentences begin: their first two and first three words."""
    words = sentences(spark, sf_dir).select(tokenize_wordpunct(F.col("sentence")).alias("_words"))
    both = words.select(
        F.explode(
            F.array(
                F.struct(F.array_join(F.slice("_words", 1, 2), " ").alias("name"), F.lit("TWO").alias("tag")),
                F.struct(F.array_join(F.slice("_words", 1, 3), " ").alias("name"), F.lit("WIDE").alias("tag")),
            )
        ).alias("_name")
    )
    return both.select("_name.*").distinct()
