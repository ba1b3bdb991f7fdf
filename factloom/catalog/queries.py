"""The registered queries: ``name -> f(spark, sf_dir)``.

Lists are returned joined by ``|``, so that each column has a plain type.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.catalog import fixtures as D
from factloom.catalog.tables import documents, table
from factloom.functions import chunks as C
from factloom.functions import gazetteer as G
from factloom.functions import text as X
from factloom.functions.tags import context_tags, rule_tags, verb_phrase_iob
from factloom.functions.xml import parse_articles
from factloom.operators import (
    abbreviations,
    casing,
    chunking,
    coverage,
    dictionary,
    names,
    path_tagging,
    relations,
    rows,
    tagging,
    vocabulary,
)
from factloom.operators.sentences import (
    SENTENCE_KEY,
    explode_column,
    explode_rows,
    marked_terms,
    sentences_of,
    word_columns,
)
from factloom.plans.counts import StageCounts
from factloom.plans.ingest import ingest_articles, write_batch
from factloom.plans.interactions import extract_interactions
from factloom.sources import articles as A
from factloom.sources import manifest
from factloom.sources.dictionary import scan_dictionary
from factloom.sources.tagged import scan_tagged, write_tagged
from factloom.staging import fresh_path, stage
from factloom.streaming.ingest import ingest_stream, stream_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def key() -> list[Column]:
    return [F.col("doc_id"), F.col("sent_no").cast("long").alias("sent_no")]


def query(f: Query) -> Query:
    """Register ``f``; a ``_`` at the end keeps its name apart from a module's."""
    QUERIES[f.__name__.rstrip("_")] = f
    return f


def joined(words: Column | str) -> Column:
    return F.array_join(words, "|")


def counted(matches: str) -> Column:
    """``term=n`` pairs in order of the terms."""
    return joined(
        F.transform(matches, lambda m: F.concat(m["term"], F.lit("="), m["n"].cast("string")))
    )


def spelled(triples: str) -> Column:
    """Triples as ``[subj > filler > obj]``."""
    return joined(
        F.transform(triples, lambda t: F.concat_ws(" > ", t["subj"], t["filler"], t["obj"]))
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-tagged sentences with verb-phrase labels."""
    sentences = tagging.tag_sentences(D.sentences(spark, sf_dir))
    return sentences.withColumn("iob", verb_phrase_iob(F.col("tags")))


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk model learned from all rule-tagged sentences, saved."""
    features = chunking.chunk_features(tagged(spark, sf_dir))
    return stage(chunking.train_chunker(features), "model")


def chunker_of(sentences: DataFrame, tags: list[str] | None) -> chunking.ChunkModel:
    """The chunk model learned from written sentences with verb-phrase labels."""
    features = chunking.chunk_features(sentences.withColumn("iob", verb_phrase_iob(F.col("tags"))), tags=tags)
    return chunking.load_chunker(stage(chunking.train_chunker(features), "model"))


def chunk_labels(sentences: DataFrame, model: chunking.ChunkModel, tags: list[str] | None) -> DataFrame:
    """The labels the model gives to written sentences."""
    features, known = chunking.chunk_features(sentences, tags=tags), model.frequent_words()
    rare = None if known is None else chunking.chunk_features(sentences, tags=tags, without=known)
    found = tagging.gather_labels(chunking.tag_chunks(features, model, rare=rare), model.labels)
    return found.select(*key(), joined("iob").alias("iob"))


# --- text ---------------------------------------------------------------------


@query
def split_sentences(spark, sf_dir):
    found = X.split_sentences(F.col("fulltext"))
    return documents(spark, sf_dir).select(
        "doc_id", F.size(found).cast("long").alias("n_sentences"), joined(found).alias("sentences")
    )


@query
def abbreviations_(spark, sf_dir):
    scores = abbreviations.score_abbreviations(documents(spark, sf_dir))
    return scores.withColumn("score", F.round("score", 6))


@query
def split_sentences_learned(spark, sf_dir):
    docs = documents(spark, sf_dir)
    learned = abbreviations.learned_abbreviations(abbreviations.score_abbreviations(docs))
    found = X.split_sentences(F.col("fulltext"), learned=learned)
    return docs.select(
        "doc_id", F.size(found).cast("long").alias("n_sentences"), joined(found).alias("sentences")
    )


@query
def explode_sentences(spark, sf_dir):
    listed = documents(spark, sf_dir).select(
        "doc_id", X.split_sentences(F.col("fulltext")).alias("sentence_list")
    )
    return explode_column(listed, "sentence_list", "sentence", "sent_no").select(*key(), "sentence")


@query
def concat_arrays(spark, sf_dir):
    two = documents(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("lang") != "en", F.array("lang", "source")).alias("a"),
        F.array("source").alias("b"),
        X.split_sentences(F.col("fulltext")).alias("c"),
    )
    return two.select("doc_id", joined(X.concat_lists(F.col("a"), F.col("b"), F.col("c"))).alias("all_items"))


@query
def tokenize_ws(spark, sf_dir):
    words = X.tokenize_ws(F.col("sentence"))
    return D.sentences(spark, sf_dir).select(
        *key(), F.size(words).cast("long").alias("n_words"), joined(words).alias("words")
    )


@query
def tokenize_wordpunct(spark, sf_dir):
    words = X.tokenize_wordpunct(F.col("sentence"), X.ENGLISH)
    return D.sentences(spark, sf_dir).select(*key(), joined(words).alias("words"))


@query
def remove_stopwords(spark, sf_dir):
    words = X.remove_stopwords(X.tokenize_ws(F.col("sentence")))
    return D.sentences(spark, sf_dir).select(*key(), joined(words).alias("filtered"))


@query
def ngrams(spark, sf_dir):
    with_words = word_columns(D.sentences(spark, sf_dir))
    return with_words.select(
        *key(),
        joined("bigrams").alias("bigrams"),
        joined(X.ngrams(F.col("filtered"), 3)).alias("trigrams"),
    )


@query
def raw_features(spark, sf_dir):
    features = X.sentence_features(F.col("sentence"))
    return D.sentences(spark, sf_dir).select(*key(), joined(features).alias("raw_features"))


# --- features -----------------------------------------------------------------


@query
def vocabulary_(spark, sf_dir):
    fitted = vocabulary.fit_vocabulary(marked_terms(D.sentences(spark, sf_dir)))
    return vocabulary.rank_vocabulary(fitted).select("term", "df", "tf", "idx")


@query
def vocabulary_capped(spark, sf_dir):
    return vocabulary.fit_vocabulary(marked_terms(D.sentences(spark, sf_dir)), vocab_size=1000)


@query
def term_counts(spark, sf_dir):
    return vocabulary.term_counts(D.sentences(spark, sf_dir)).select(*key(), "term", "n")


@query
def feature_stages(spark, sf_dir):
    with_words = D.sentences(spark, sf_dir).transform(word_columns)
    return with_words.select(
        *key(),
        *[F.size(c).cast("long").alias(f"n_{c}") for c in ("words", "filtered", "bigrams")],
        joined(F.array_sort(F.array_distinct("raw_features"))).alias("features"),
    )


# --- dictionary ---------------------------------------------------------------


@query
def scan_dictionary_(spark, sf_dir):
    return scan_dictionary(spark, D.dictionary_file(spark, sf_dir))


@query
def dictionary_build(spark, sf_dir):
    return dictionary.build_dictionary(D.dictionary_entries(spark, sf_dir))


@query
def dictionary_vocab(spark, sf_dir):
    return dictionary.dictionary_vocabulary(D.sentences(spark, sf_dir), D.taxa(spark))


@query
def entity_hits(spark, sf_dir):
    matched = dictionary.match_dictionary(D.sentences(spark, sf_dir), D.taxa(spark))
    return dictionary.entity_hits(matched).select(*key())


@query
def entity_matches(spark, sf_dir):
    matched = dictionary.match_dictionary(D.sentences(spark, sf_dir), D.taxa(spark))
    return matched.select(*key(), "sentence", counted("matches").alias("entity_matches"))


@query
def entity_counts(spark, sf_dir):
    matched = dictionary.match_dictionary(D.sentences(spark, sf_dir), D.taxa(spark), min_tf=1)
    found = dictionary.entity_map(matched)
    return found.select(
        *key(),
        F.col("entity_counts").cast("long").alias("entity_counts"),
        F.aggregate(F.map_values("entity_matches"), F.lit(0), lambda a, n: a + n)
        .cast("long")
        .alias("n_terms"),
    )


@query
def entity_taxa(spark, sf_dir):
    taxa = D.taxa(spark)
    matched = dictionary.match_dictionary(D.sentences(spark, sf_dir), taxa)
    return dictionary.matched_entities(matched, taxa).select(*key(), "alias", "n", "entity")


# --- row sets -----------------------------------------------------------------


@query
def select_columns(spark, sf_dir):
    return rows.select_columns(documents(spark, sf_dir), ["doc_id", "lang", "source"])


@query
def dedup_by_key(spark, sf_dir):
    # Texts of no more than 100 characters count as having no key.
    key = F.when(F.length("fulltext") > 100, F.md5("fulltext"))
    return rows.dedup_by_key(documents(spark, sf_dir), key, ["doc_id"]).select(
        "doc_id", F.md5("fulltext").alias("text_md5"), "lang"
    )


@query
def sample_hash(spark, sf_dir):
    return rows.sample_by_hash(documents(spark, sf_dir), "doc_id", 0.1).select("doc_id", "source")


@query
def sample_hash_small(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return rows.sample_by_hash(orders, "l_orderkey", 0.0005)


@query
def threshold_filter(spark, sf_dir):
    found = dictionary.entity_map(
        dictionary.match_dictionary(D.sentences(spark, sf_dir), D.taxa(spark), min_tf=1)
    )
    return rows.at_least(found, entity_counts=2).select(
        *key(), F.col("entity_counts").cast("long").alias("entity_counts")
    )


@query
def stage_counts(spark, sf_dir):
    # Texts are cut into sentences once, and the vocabulary is fitted once.
    sentences = stage(D.sentences(spark, sf_dir), "sentences")
    taxa = D.taxa(spark)
    fitted = stage(vocabulary.fit_vocabulary(marked_terms(sentences)), "vocabulary")
    # Written whole, the sentences with matches are found in one pass for both their readers.
    matched = stage(dictionary.match_dictionary(sentences, taxa), "matched")
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        for name, df in (
            ("papers", documents(spark, sf_dir)),
            ("sentences", sentences),
            ("entity terms", dictionary.dictionary_terms(taxa)),
            ("vocabulary", fitted),
            ("entity matches", dictionary.dictionary_vocabulary(sentences, taxa, vocabulary=fitted)),
            ("sentences with matches", matched),
        )
    ]
    return reduce(DataFrame.union, counts)


# --- ingest -------------------------------------------------------------------


@query
def scan_json(spark, sf_dir):
    path = fresh_path(spark, "json")
    A.write_json(D.json_records(spark, sf_dir), path)
    return A.scan_json(spark, path).select(
        joined("doi").alias("doi"), joined("keywords").alias("keywords"), "fulltext"
    )


@query
def sink_json(spark, sf_dir):
    path = fresh_path(spark, "json")
    A.write_json(D.json_records(spark, sf_dir), path, compression="gzip")
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.doi[0]").alias("doi"),
        F.get_json_object("value", "$.fulltext").alias("fulltext"),
    )


@query
def scan_xml(spark, sf_dir):
    pieces = A.scan_xml(spark, D.xml_files(spark, sf_dir), file_names="*.gz")
    return pieces.select(
        F.regexp_extract("xml", '"doi">([0-9]+)<', 1).alias("doi"), F.md5("xml").alias("xml_md5")
    )


# Over so many folders the files of single articles are spread.
FOLDERS = 64
PLAIN_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


@query
def scan_xml_single(spark, sf_dir):
    # One file per article, which is how such collections come.
    path = fresh_path(spark, "single")
    article = F.concat(
        F.lit('<?xml version="1.0"?>\n<!DOCTYPE article>\n<article><front><article-meta>'),
        F.lit('<article-id pub-id-type="doi">'),
        F.col("page_id").cast("string"),
        F.lit("</article-id></article-meta></front><body><p>"),
        D.escaped(F.col("url")),
        F.lit("</p><p>"),
        D.escaped(F.col("html")),
        F.lit("</p></body></article>"),
    )
    # The files lie in a few folders, as a folder for each is listed and committed by itself.
    folder = F.pmod(F.xxhash64("page_id"), F.lit(FOLDERS)).alias("folder")
    pages = table(spark, sf_dir, "pages").select(folder, article.alias("value"))
    # Each task moves its own files into place; by default the driver moves all of them, one by one.
    in_place = pages.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    # On a local disk a checksum beside each file would take as long again as the file.
    for option, value in PLAIN_FILES.items():
        in_place = in_place.option(option, value)
    in_place.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
    parsed = parse_articles(A.scan_xml_single(spark, path))
    return A.assemble_records(parsed).select(joined("doi").alias("doi"), "fulltext")


def parsed_documents(spark, sf_dir, **options):
    raw = documents(spark, sf_dir).select("doc_id", D.article_xml().alias("xml"))
    return parse_articles(raw, **options)


@query
def extract_metadata(spark, sf_dir):
    fields = ["doi", "pmcid", "nlm-ta", "article-title", "keywords", "keywordList", "volume"]
    full = parsed_documents(spark, sf_dir)
    return full.select(
        "doc_id",
        *[joined(F.col(f"`{f}`")).alias(f.replace("-", "_").lower()) for f in fields],
    )


@query
def field_coverage(spark, sf_dir):
    return coverage.field_coverage(parsed_documents(spark, sf_dir))


@query
def extract_metadata_leading(spark, sf_dir):
    found = parsed_documents(spark, sf_dir, leading_text_only=True)
    return found.select("doc_id", F.col("article-title")[0].alias("title"))


@query
def extract_texts(spark, sf_dir):
    found = parsed_documents(spark, sf_dir)
    return found.select(
        "doc_id",
        F.size("body_paragraphs").cast("long").alias("n_paragraphs"),
        F.array_join("body_paragraphs", " ").alias("fulltext"),
        F.array_join("abstract_paragraphs", " ").alias("abstract"),
    )


@query
def assemble_record(spark, sf_dir):
    records = A.assemble_records(parsed_documents(spark, sf_dir))
    return records.select(
        joined("doi").alias("doi"),
        joined("cprojectID").alias("cproject_id"),
        F.size("ack").cast("long").alias("n_ack"),
        F.length("fulltext").cast("long").alias("n_chars"),
        "abstract",
    )


@query
def xml_rejects(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("origin"),
        F.col("html").alias("xml"),
    )
    texts = documents(spark, sf_dir).select(
        F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("origin"),
        D.article_xml().alias("xml"),
    )
    parsed = parse_articles(pages.unionByName(texts))
    return parsed.filter(~F.col("ok")).select("origin", F.col("reason").isNotNull().alias("has_reason"))


def listing(spark, sf_dir):
    """File names as a listing has them, and the keys of what is done."""
    texts = documents(spark, sf_dir)
    names = texts.select(
        F.concat(
            F.lit("PMC"),
            F.col("doc_id").cast("string"),
            F.when(F.col("lang") == "de", ".html").otherwise(".xml.gz"),
        ).alias("name")
    )
    done = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("eupmc/PMC"), F.col("doc_id").cast("string"), F.lit(".json.gz")).alias("key")
    )
    return names, done


@query
def manifest_pending(spark, sf_dir):
    return manifest.pending(*listing(spark, sf_dir))


@query
def ingest_articles_(spark, sf_dir):
    path = D.xml_files(spark, sf_dir)
    found = ingest_articles(spark, path, file_names="*.gz", spread=spark.sparkContext.defaultParallelism)
    return found.articles.select(
        joined("doi").alias("doi"), joined("cprojectID").alias("cproject_id"), "fulltext", "abstract"
    )


@query
def ingest_stream_(spark, sf_dir):
    path = D.xml_files(spark, sf_dir)
    output = fresh_path(spark, "stream")
    running = ingest_stream(spark, path, output, f"{output}-state", file_names="*.gz")
    running.awaitTermination()
    parsed = spark.read.parquet(output)
    return A.assemble_records(parsed.filter("ok")).select(joined("doi").alias("doi"), "fulltext")


def batches(spark: SparkSession, output: str) -> DataFrame:
    """The articles of all batches, with their batch."""
    found = spark.read.schema(A.ARTICLE).json(f"{output}/articles")
    return found.select(joined("doi").alias("doi"), "fulltext", F.col("batch").cast("long").alias("batch"))


@query
def ingest_pending(spark, sf_dir):
    path, output = fresh_path(spark, "xml"), fresh_path(spark, "out")
    ledger = f"{output}/ledger"
    for batch, english in enumerate((True, False)):
        D.xml_folders(spark, sf_dir, path, english)
        done = manifest.done_versions(spark, ledger) if batch else None
        found = ingest_articles(spark, f"{path}/*", done=done, file_names="*.gz")
        write_batch(found, output, ledger, batch)
    # A batch written twice repeats nothing.
    write_batch(found, output, ledger, batch)
    return batches(spark, output)


@query
def ingest_batches(spark, sf_dir):
    path, output = fresh_path(spark, "xml"), fresh_path(spark, "out")
    for english in (True, False):
        D.xml_folders(spark, sf_dir, path, english)
        running = stream_batches(
            spark, f"{path}/*", output, f"{output}/ledger", f"{output}/state", file_names="*.gz"
        )
        running.awaitTermination()
    return batches(spark, output)


# --- tags and chunks ----------------------------------------------------------


@query
def pos_lexicon(spark, sf_dir):
    tokens = tagging.token_rows(tagging.tag_sentences(D.sentences(spark, sf_dir), context_tags))
    return tagging.learn_lexicon(tokens).select("word", "pos", "n")


@query
def pos_tag(spark, sf_dir):
    # The lexicon holds the words seen 3 times or more; others fall back to the rule.
    sentences = tagging.tag_sentences(D.sentences(spark, sf_dir), context_tags)
    learned = tagging.learn_lexicon(tagging.token_rows(sentences), min_count=3)
    lexicon = stage(learned, "lexicon")
    tokens = tagging.token_rows(sentences, ["words"], placed=False)
    found = tagging.gather_tokens(tagging.tag_tokens(tokens, lexicon))
    return found.select(*key(), joined(C.tagged_words(F.col("words"), F.col("tags"))).alias("tagged"))


@query
def pos_tag_path(spark, sf_dir):
    sentences = tagging.tag_sentences(D.sentences(spark, sf_dir), context_tags)
    model = path_tagging.load_paths(stage(path_tagging.learn_paths(sentences), "paths"))
    found = path_tagging.tag_paths(sentences.drop("tags"), model)
    return found.select(*key(), joined(C.tagged_words(F.col("words"), F.col("tags"))).alias("tagged"))


@query
def pos_tag_counts(spark, sf_dir):
    sentences = tagging.tag_sentences(D.sentences(spark, sf_dir), context_tags)
    return path_tagging.learn_paths(sentences)


@query
def chunk_features(spark, sf_dir):
    found = chunking.chunk_features(tagged(spark, sf_dir))
    return found.select(
        *key(),
        F.col("tok_no").cast("long").alias("tok_no"),
        *chunking.FEATURES.values(),
    )


def tagged_text(spark: SparkSession, sf_dir: str) -> str:
    """All sentences as tagged text, with names labelled where verbs are not; the path."""
    path = fresh_path(spark, "tagged")
    both = F.zip_with(
        F.col("iob"),
        relations.capitalised_iob(F.col("words")),
        lambda verb, name: F.when(verb == "O", name).otherwise(verb),
    )
    write_tagged(tagged(spark, sf_dir).withColumn("iob", both), path)
    return path


@query
def scan_tagged_(spark, sf_dir):
    found = scan_tagged(spark, tagged_text(spark, sf_dir), ["VP"])
    return found.groupBy(
        joined("words").alias("words"), joined("tags").alias("tags"), joined("iob").alias("iob")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def nb_train_tagged(spark, sf_dir):
    sentences = scan_tagged(spark, tagged_text(spark, sf_dir), ["VP"])
    return rounded(stage(chunking.train_chunker(chunking.chunk_features(sentences)), "model"))


@query
def nb_train(spark, sf_dir):
    return rounded(trained(spark, sf_dir))


def rounded(model: DataFrame) -> DataFrame:
    """A chunk model as logarithms."""
    model = chunking.log_probabilities(model)
    return model.select(
        F.coalesce("fname", F.lit("")).alias("fname"),
        F.coalesce("fval", F.lit("")).alias("fval"),
        "label",
        "n",
        F.round("logp", 6).alias("logp"),
    )


@query
def nb_tag(spark, sf_dir):
    # Texts are cut into words once for learning and for both ways of looking words up.
    sentences = stage(tagged(spark, sf_dir).select(*SENTENCE_KEY, "words", "tags"), "tagged")
    tags = chunking.seen_tags(sentences)
    return chunk_labels(sentences, chunker_of(sentences, tags), tags)


@query
def nb_tag_unseen(spark, sf_dir):
    """The model is learned from the English documents, so the others have values it lacks."""
    flagged = tagging.tag_sentences(sentences_of(english_documents(spark, sf_dir), keep=["doc_id", "english"]))
    sentences = stage(flagged.select(*SENTENCE_KEY, "words", "tags", "english"), "tagged")
    tags = chunking.seen_tags(sentences)
    model = chunker_of(sentences.filter("english").drop("english"), tags)
    return chunk_labels(sentences.filter("not english").drop("english"), model, tags)


def english_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``english``, as if joined by ``doc_id`` to a table of their languages.

    Only documents whose ``doc_id`` comes more than once have to be joined for that.
    """
    texts = documents(spark, sf_dir).filter("doc_id is not null")
    flag = (F.col("lang") == "en").alias("english")
    counted = texts.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = stage(counted, "repeated")
    if repeated.isEmpty():
        return texts.select("*", flag)
    once = texts.join(repeated, "doc_id", "left_anti").select("*", flag)
    more = texts.join(repeated, "doc_id", "left_semi")
    return once.unionByName(more.join(more.select("doc_id", flag), "doc_id"))


@query
def chunk_iob(spark, sf_dir):
    found = relations.chunk_rows(relations.with_chunks(tagged(spark, sf_dir)))
    return found.select(
        *key(), F.col("chunk_no").cast("long").alias("chunk_no"), "label", "text", "gap_after"
    )


# --- relations ----------------------------------------------------------------


@query
def relations_(spark, sf_dir):
    found = relations.relation_rows(tagged(spark, sf_dir))
    return found.select(
        *key(), F.col("chunk_no").cast("long").alias("chunk_no"), "subj", "filler", "obj"
    )


@query
def filler_pattern(spark, sf_dir):
    found = relations.relation_rows(tagged(spark, sf_dir))
    return found.filter(F.col("filler").rlike(C.INTERACTION_PATTERN)).select(*key(), "subj", "filler", "obj")


@query
def triples(spark, sf_dir):
    found = relations.sentence_triples(tagged(spark, sf_dir))
    return found.select(
        *key(),
        F.size("triples").cast("long").alias("triples_counts"),
        spelled("triples").alias("triples"),
    )


@query
def triples_all(spark, sf_dir):
    found = relations.named_triples(D.sentences(spark, sf_dir))
    return found.select(
        *key(), F.size("triples").cast("long").alias("n"), spelled("triples").alias("triples")
    )


@query
def casing_(spark, sf_dir):
    return casing.learn_casing(D.sentences(spark, sf_dir))


@query
def triples_cased(spark, sf_dir):
    sentences = D.sentences(spark, sf_dir)
    table = stage(casing.learn_casing(sentences), "casing")
    return casing.cased_triples(sentences, table).select(
        *key(), F.size("triples").cast("long").alias("n"), spelled("triples").alias("triples")
    )


# --- gazetteer ----------------------------------------------------------------


@query
def gazetteer_phrases(spark, sf_dir):
    phrases = G.find_phrases(F.col("sentence"), D.GAZETTEER_PATTERNS)
    found = explode_rows(D.sentences(spark, sf_dir), ["doc_id", "sent_no"], phrases, "_p")
    return found.select(*key(), "_p.phrase", "_p.tag")


@query
def gazetteer_iob(spark, sf_dir):
    found = relations.gazetteer_sentences(D.sentences(spark, sf_dir), D.GAZETTEER_PATTERNS)
    return found.select(*key(), joined("iob").alias("iob"))


@query
def triples_gazetteer(spark, sf_dir):
    found = relations.gazetteer_triples(D.sentences(spark, sf_dir), D.GAZETTEER_PATTERNS)
    return found.select(
        *key(), F.size("triples").cast("long").alias("n"), spelled("triples").alias("triples")
    )


@query
def gazetteer_names(spark, sf_dir):
    listed = names.build_names(D.names(spark, sf_dir))
    found = names.match_names(D.sentences(spark, sf_dir), listed)
    return found.select(
        *key(), F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"), "phrase", "tag"
    )


@query
def gazetteer_names_iob(spark, sf_dir):
    listed = names.build_names(D.names(spark, sf_dir))
    found = names.label_names(D.sentences(spark, sf_dir), listed, with_words=False)
    return found.select(*key(), joined("iob").alias("iob"))


# --- whole --------------------------------------------------------------------


def whole_workflow(spark, sf_dir, counts: StageCounts | None = None) -> DataFrame:
    texts = documents(spark, sf_dir).withColumn("doi", F.array(F.col("doc_id").cast("string")))
    unique = rows.dedup_by_key(texts, F.md5("fulltext"), ["doc_id"])
    model = chunking.load_chunker(trained(spark, sf_dir))
    return extract_interactions(
        unique, D.taxa(spark), model, min_tf=1, min_entities=1, min_triples=1, counts=counts
    )


@query
def workflow_counts(spark, sf_dir):
    counts = StageCounts()
    stage(whole_workflow(spark, sf_dir, counts), "interactions")
    return counts.table(spark)


@query
def interaction_workflow(spark, sf_dir):
    found = whole_workflow(spark, sf_dir)
    return found.select(
        *key(),
        joined("doi").alias("doi"),
        "sentences",
        joined(
            F.transform(
                F.array_sort(F.map_entries("entity_matches")),
                lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
            )
        ).alias("entity_matches"),
        F.col("entity_counts").cast("long").alias("entity_counts"),
        joined(F.transform("triples", lambda t: F.array_join(t, " > "))).alias("triples"),
        F.col("triples_counts").cast("long").alias("triples_counts"),
    )
