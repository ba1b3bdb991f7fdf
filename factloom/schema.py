"""The extraction spec and the schema of an article record."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

# Field name -> element path of the journal article tag set.
JATS_PATHS = {
    "nlm-ta": ".//journal-meta//journal-id[@journal-id-type='nlm-ta']",
    "iso-abbrev": ".//journal-meta//journal-id[@journal-id-type='iso-abbrev']",
    "publisher-id": ".//journal-meta//journal-id[@journal-id-type='publisher-id']",
    "journal-title": ".//journal-meta/journal-title-group/journal-title",
    "issn-epub": ".//journal-meta//issn[@pub-type='epub']",
    "publisher-name": ".//journal-meta/publisher/publisher-name",
    "publisher-loc": ".//journal-meta/publisher/publisher-loc",
    "keywordList": ".//kwd-group/kwd//",
    "article-subject-heading": ".//subj-group[@subj-group-type='heading']/subject",
    "article-subject-overline": ".//subj-group[@subj-group-type='overline']/subject",
    "article-subject-discipline3": ".//subj-group[@subj-group-type='Discipline-v3']/subject",
    "article-subject-discipline2": ".//subj-group[@subj-group-type='Discipline-v2']/subject",
    "article-subject-geographical": ".//subj-group[@subj-group-type='Geographical classification']/subject",
    "article-subject-taxon": ".//subj-group[@subj-group-type='Taxon classification']/subject",
    "article-subject-chronological": ".//subj-group[@subj-group-type='Chronological classification']/subject",
    "article-subject-subject": ".//subj-group[@subj-group-type='Subject classification']/subject",
    "article-subject-article": ".//subj-group[@subj-group-type='article-subject-classification']/subject",
    "article-subject-hwp-journal-coll": ".//subj-group[@subj-group-type='hwp-journal-coll']/subject",
    "article-subject-editorial-class": ".//subj-group[@subj-group-type='editorial-class']/subject",
    "doi": ".//article-meta//article-id[@pub-id-type='doi']",
    "pmcid": ".//article-meta//article-id[@pub-id-type='pmcid']",
    "article-title": ".//article-meta//article-title",
    "elocation-id": ".//article-meta/elocation-id",
    "volume": ".//article-meta/volume",
    "keywords": ".//article-meta/kwd-group/kwd",
    "aff-sup": ".//article-meta//sup",
    "aff-institution": ".//article-meta//institution",
    "aff-country": ".//article-meta//country",
    "pub-date-collection": ".//article-meta/pub-date[@pub-type='collection']",
    "pub-date-epub-year": ".//article-meta/pub-date[@pub-type='epub']/year",
    "pub-date-epub-month": ".//article-meta/pub-date[@pub-type='epub']/month",
    "pub-date-epub-day": ".//article-meta/pub-date[@pub-type='epub']/day",
    "permissions-statement": ".//article-meta/permissions/copyright-statement",
    "permissions-year": ".//article-meta/permissions/copyright-year",
    "permissions-holder": ".//article-meta/permissions/copyright-holder",
    "permissions-license": ".//article-meta/permissions/license",
    "funding-group": ".//article-meta/funding-group/award-group",
    "ack": ".//back/ack/p",
    "citations-titles": ".//back//article-title",
    "citations-year": ".//back//year",
    "citations-source": ".//back//source",
    "citations-doi": ".//back//pub-id[@pub-id-type='doi']",
    "citations-pmid": ".//back//pub-id[@pub-id-type='pmid']",
    "citations-pmcid": ".//back//pub-id[@pub-id-type='pmcid']",
}

STRING_LIST = T.ArrayType(T.StringType())


def metadata_schema(fields: Iterable[str] = JATS_PATHS) -> T.StructType:
    """One ``array<string>`` column per field of an extraction spec."""
    return T.StructType([T.StructField(name, STRING_LIST) for name in fields])


def article_schema(fields: Iterable[str] = JATS_PATHS) -> T.StructType:
    """An article record: the spec's fields, ``cprojectID``, full text, abstract."""
    return T.StructType(
        [
            *metadata_schema(fields).fields,
            T.StructField("cprojectID", STRING_LIST),
            T.StructField("fulltext", T.StringType()),
            T.StructField("abstract", T.StringType()),
        ]
    )


ARTICLE = article_schema()

DICTIONARY = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("aliases", T.StringType()),
    ]
)
