"""Reading one article's XML. The only step that runs in Python workers.

Each article is parsed once for all its fields. The per-field alternative, a
native ``xpath`` call for each of 44 paths, would parse it 44 times and cannot
give the text of an element with inline markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.schema import JATS_PATHS, STRING_LIST

PARAGRAPHS = T.StructType(
    [
        T.StructField("body_paragraphs", STRING_LIST),
        T.StructField("abstract_paragraphs", STRING_LIST),
    ]
)


def parse_element(xml: str) -> ElementTree.Element:
    """Parse an article cut out of its file.

    The piece has lost the namespace declarations of the file's root. If that is
    why it fails, the prefixes it uses are declared and it is parsed again.
    """
    try:
        return ElementTree.fromstring(xml)
    except ElementTree.ParseError as error:
        if "unbound prefix" not in str(error):
            raise
    used = set(re.findall(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]", xml)) - {"xml", "xmlns"}
    declared = " ".join(f'xmlns:{prefix}="urn:{prefix}"' for prefix in sorted(used))
    return ElementTree.fromstring(f"<articles {declared}>{xml}</articles>")[0]


def field_values(article: ElementTree.Element, path: str, leading_text_only: bool) -> list:
    """The text of each element on ``path``; none if the path cannot be followed."""
    try:
        found = article.findall(path)
    except (SyntaxError, KeyError):
        return []
    if leading_text_only:
        return [element.text for element in found]
    return ["".join(element.itertext()) for element in found]


def paragraph_texts(article: ElementTree.Element, section: str, nested_twice: bool) -> list[str]:
    """The text of each ``p`` under ``section``.

    A ``p`` within a ``p`` is part of the outer one's text. ``nested_twice`` lists
    it by itself as well.
    """
    paragraphs = article.findall(f".//{section}//p")
    if not nested_twice:
        inner = {id(p) for outer in paragraphs for p in outer.iter("p") if p is not outer}
        paragraphs = [p for p in paragraphs if id(p) not in inner]
    return ["".join(p.itertext()) for p in paragraphs]


# A batch of articles is parsed in pieces of no more rows and, unless one article has more, bytes.
PIECE_ROWS = 256
PIECE_BYTES = 1 << 20


def batch_pieces(
    batch: pa.RecordBatch, column: str, max_rows: int = PIECE_ROWS, max_bytes: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in pieces, cut by the size of their ``column``.

    Parsed texts take many times the room of the raw ones, so what is held at a time
    must not depend on how many rows Spark puts into a batch.
    """
    start, held = 0, 0
    for at, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size = size or 0
        if at > start and (at - start >= max_rows or held + size > max_bytes):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    yield batch.slice(start)


def parse_articles(
    raw: DataFrame,
    xml: str = "xml",
    paths: Mapping[str, str] = JATS_PATHS,
    *,
    leading_text_only: bool = False,
    nested_twice: bool = False,
) -> DataFrame:
    """Add the fields of ``paths``, two paragraph lists, ``ok`` and ``reason``.

    The column ``xml`` is left out; the other columns of ``raw`` are kept. An
    article that cannot be parsed has ``ok`` false, the reason, and null fields.
    """
    kept = [f for f in raw.schema.fields if f.name != xml]
    schema = T.StructType(
        [
            *kept,
            *[T.StructField(name, STRING_LIST) for name in paths],
            *PARAGRAPHS.fields,
            T.StructField("ok", T.BooleanType()),
            T.StructField("reason", T.StringType()),
        ]
    )
    paths = dict(paths)
    kept_names = [f.name for f in kept]
    lists = pa.list_(pa.string())

    def read(text: str | None) -> tuple[list, str | None]:
        try:
            article = parse_element(text or "")
        except (ElementTree.ParseError, ValueError) as error:
            return [None] * (len(paths) + 2), str(error)
        values = [field_values(article, p, leading_text_only) for p in paths.values()]
        values.append(paragraph_texts(article, "body", nested_twice))
        values.append(paragraph_texts(article, "abstract", nested_twice))
        return values, None

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in source for piece in batch_pieces(whole, xml)):
            read_rows = [read(text) for text in batch.column(xml).to_pylist()]
            columns = list(zip(*[values for values, _ in read_rows], strict=True))
            reasons = [reason for _, reason in read_rows]
            if not read_rows:
                columns = [()] * (len(paths) + 2)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in kept_names],
                    *[pa.array(list(values), lists) for values in columns],
                    pa.array([reason is None for reason in reasons], pa.bool_()),
                    pa.array(reasons, pa.string()),
                ],
                names=schema.fieldNames(),
            )

    return raw.mapInArrow(batches, schema)
