"""Removal of byte strings that stand earlier in the corpus as well.

Every string of ``WIDTH`` bytes has an anchor: the one of its 40-byte grams with the
least hash, the first of several. Equal strings have equal anchors at equal places, so
strings are only compared where their anchor repeats. An anchor with the strings that
chose it is a context.

1. Contexts are dealt out in the order of (anchor, context, place). Rows whose
   neighbours have another anchor are alone and leave. A context equal to its
   predecessor repeats in whole; the first of equal contexts stands for them.
2. Anchors with different contexts may still share strings. These contexts, a small
   part of the text, are collected into blocks by anchor, and each block merges the
   Burrows-Wheeler transforms of its shards to find the repeated strings.
3. Anchors with more contexts than a block should hold have their strings compared one
   by one, dealt out by range in the same way as contexts.

Equality of contexts is that of 128 hash bits (anchor and context).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.bwt_merge import repeats
from factloom.llm.common import document_key, numbered
from factloom.llm.shingles import spread
from factloom.staging import stage

WIDTH = 100
GRAM = 40
CHOICES = WIDTH - GRAM + 1

# Bytes that a task looks at together, bytes of contexts in a block, and contexts of an
# anchor beyond which its strings are counted one by one.
PIECE = 1 << 21
BLOCK_BYTES = 1 << 21
MANY = 2000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)
# A context in one number: place of the anchor, strings before it, strings in all.
_BITS = 6


class Hasher:
    """Hashes of all byte strings of a given length within a piece, by prefix sums."""

    def __init__(self) -> None:
        size = PIECE + 2 * WIDTH
        self.of_byte = spread(np.arange(1, 257, dtype=np.uint64))
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, _STEP)])
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, _BACK)])

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum(self.of_byte[data] * self.down[: len(data)])]

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return spread((sums[end] - sums[start]) * self.up[start])


def least_of(value: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    return np.minimum(value[: len(value) - (width - span)], value[width - span :]) if span < width else value


def pieces(encoded: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, where it begins, bytes), in lists of bounded size; longer texts are cut so
    that every string of ``WIDTH`` bytes is in one piece."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for k, text in enumerate(encoded):
        for start in range(0, max(len(text) - WIDTH + 1, 0), PIECE - WIDTH):
            part = text[start : start + PIECE - 1]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((k, start, part))
            size += len(part)
    if held:
        yield held


def anchors(encoded: list[bytes], hasher: Hasher) -> Iterator[pd.DataFrame]:
    """Contexts of the texts: ``anchor``, ``context``, ``text`` (number), ``place``."""
    for held in pieces(encoded):
        data = np.frombuffer(b"".join(part for _, _, part in held), dtype=np.uint8)
        lengths = np.array([len(part) for _, _, part in held])
        piece = np.repeat(np.arange(len(held)), lengths)
        sums = hasher.sums(data)
        all_starts = np.arange(len(data) - GRAM + 1)
        gram = hasher.between(sums, all_starts, all_starts + GRAM)
        # The place in the low bits makes the first of equal grams the least.
        least = least_of(gram & ~_PLACE | all_starts.astype(np.uint64), CHOICES)
        whole = np.flatnonzero(piece[: len(least)] == piece[WIDTH - 1 : WIDTH - 1 + len(least)])
        chosen = (least[whole] & _PLACE).astype(np.int64)
        new = np.r_[True, (chosen[1:] != chosen[:-1]) | (np.diff(whole) != 1)]
        first = np.flatnonzero(new)
        low, high = whole[first], whole[np.r_[first[1:] - 1, len(whole) - 1]]
        at = chosen[first]
        shape = (at - low) << _BITS | (high - low)
        context = hasher.between(sums, low, high + WIDTH) + spread(shape.astype(np.uint64))
        begin = np.array([start for _, start, _ in held]) - (np.cumsum(lengths) - lengths)
        place = (at + begin[piece[at]]) << (2 * _BITS) | shape
        text = np.array([k for k, _, _ in held])[piece[at]]
        yield pd.DataFrame(
            {
                "anchor": gram[at].view(np.int64),
                "context": context.view(np.int64),
                "text": text,
                "place": place,
            }
        )


def encoded(texts: pd.Series) -> list[bytes]:
    return [b"" if pd.isna(t) else t.encode("utf-8", "surrogatepass") for t in texts]


def contexts(docs: DataFrame) -> DataFrame:
    """``(anchor, context, _doc, place)`` of all texts of ``docs`` (``_doc``, ``text``)."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            doc = batch["_doc"].to_numpy()
            for rows in anchors(encoded(batch["text"]), hasher):
                rows["_doc"] = doc[rows.pop("text").to_numpy()]
                yield rows

    return docs.select("_doc", "text").mapInPandas(found, "anchor long, context long, place long, _doc long")


def repeated_contexts(found: DataFrame) -> DataFrame:
    """The contexts whose anchor repeats, with ``first``: whether no equal one is before.

    Dealt out by range, so an anchor that is in very many texts spreads over many
    tasks; the first row of a task has its predecessor in another, and is settled with
    the last rows of all tasks, of which there is one each.
    """
    order = ["anchor", "context", "_doc", "place"]
    parts = found.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = found.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One row is held back, since the next one says whether its anchor repeats.
        held: pd.DataFrame | None = None
        before: tuple[int, int] | None = None
        kept_before = True
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(rows) < 2:
                held = rows
                continue
            yield from marked(rows, before, kept_before, last=False)
            a, c = rows["anchor"].to_numpy(), rows["context"].to_numpy()
            before, kept_before = (a[-2], c[-2]), False
            held = rows.iloc[-1:]
        if held is not None:
            yield from marked(held, before, kept_before, last=True)

    def marked(
        rows: pd.DataFrame, before: tuple[int, int] | None, edge: bool, last: bool
    ) -> Iterator[pd.DataFrame]:
        anchor, context = rows["anchor"].to_numpy(), rows["context"].to_numpy()
        prior_anchor = np.r_[before[0] if before else 0, anchor[:-1]]
        prior_context = np.r_[before[1] if before else 0, context[:-1]]
        like_prior = anchor == prior_anchor
        like_prior[0] &= before is not None
        same = like_prior & (context == prior_context)
        like_next = np.r_[anchor[1:] == anchor[:-1], last]
        keep = like_prior | like_next
        keep[0] |= edge
        out = rows.assign(first=~same, edge=False, last=False)
        out.loc[out.index[0], "edge"] = edge
        out.loc[out.index[-1], "last"] = last
        yield (out if last else out.iloc[:-1])[keep if last else keep[:-1]]

    rows = ordered.mapInPandas(
        neighbours, "anchor long, context long, place long, _doc long, part int, first boolean, edge boolean, last boolean"
    )
    rows = stage(rows, "contexts")
    ends = rows.filter("last").select("anchor", "context", F.col("part").alias("_end"))
    edges = rows.filter("edge").select("anchor", "context", "part")
    # One row per task of the sort on either side.
    known = edges.join(ends, ["anchor", "context"]).filter("_end < part").select("anchor", "context", "part").distinct()
    known = stage(known.withColumn("edge", F.lit(True)).withColumn("_known", F.lit(True)), "edges")
    rows = rows.join(F.broadcast(known), ["anchor", "context", "part", "edge"], "left")
    first = F.col("first") & F.col("_known").isNull()
    return rows.select("anchor", "context", "_doc", "place", first.alias("first"))


def place_parts(place: Column) -> tuple[Column, Column]:
    """Where a context's first string begins, and how many strings it has."""
    mask = (1 << _BITS) - 1
    before = F.shiftright(place, _BITS).bitwiseAND(mask)
    return F.shiftright(place, 2 * _BITS) - before, place.bitwiseAND(mask) + 1


def with_bytes(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """``chosen`` (``anchor``, ``_doc``, ``start``, ``strings``, ``many``) with their ``bytes``."""
    lists = stage(
        chosen.groupBy("_doc").agg(F.collect_list(F.struct("anchor", "start", "strings", "many")).alias("_list")),
        "wanted",
    )
    # The same way at every size: a broadcast of small lists would hide what large ones cost.
    texts = docs.select("_doc", "text").join(lists.hint("merge"), "_doc")

    columns = ["anchor", "_doc", "start", "strings", "many", "bytes"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows of several documents leave together, up to about PIECE bytes.
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text, wanted in zip(batch["_doc"], encoded(batch["text"]), batch["_list"], strict=True):
                for w in wanted:
                    part = text[w["start"] : w["start"] + w["strings"] + WIDTH - 1]
                    rows.append((w["anchor"], doc, w["start"], w["strings"], w["many"], part))
                    size += len(part)
                    if size > PIECE:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return texts.mapInPandas(
        cut, "anchor long, _doc long, start long, strings long, many boolean, bytes binary"
    )


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated_in_blocks(cut: DataFrame, blocks: int) -> DataFrame:
    """``(_doc, start, end)`` of the contexts' strings that repeat an earlier one."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["_doc", "start"]).sort_values(["_doc", "start"])
        found = repeats(rows["bytes"].tolist(), WIDTH)
        spans = [
            (doc, start + a, start + b - 1 + WIDTH)
            for doc, start, flags in zip(rows["_doc"], rows["start"], found, strict=True)
            for a, b in runs(flags)
        ]
        return pd.DataFrame(spans, columns=["_doc", "start", "end"]).astype("int64")

    dealt = cut.withColumn("_block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(block, "_doc long, start long, end long")


def repeated_one_by_one(cut: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts, string by string.

    A string's hash takes the place of anchor and context, so a string that is in very
    many texts spreads over many tasks.
    """
    strings = cut.select(
        "_doc", "bytes", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strings") - 1)).alias("_k")
    )
    digest = F.md5(F.substring("bytes", F.col("_k").cast("int") + 1, F.lit(WIDTH)))
    strings = strings.select(
        digest.alias("_digest"), (F.col("start") + F.col("_k")).alias("place"), "_doc"
    ).select(
        F.conv(F.substring("_digest", 1, 16), 16, -10).cast("long").alias("anchor"),
        F.conv(F.substring("_digest", 17, 16), 16, -10).cast("long").alias("context"),
        "place",
        "_doc",
    )
    later = repeated_contexts(strings).filter(~F.col("first"))
    return later.select("_doc", F.col("place").alias("start"), (F.col("place") + WIDTH).alias("end"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(_doc, start, end)``: byte spans of ``docs`` (``_doc``, ``text``) made of strings
    of ``WIDTH`` bytes that stand earlier as well. Spans may overlap."""
    found = stage(repeated_contexts(contexts(docs)), "repeated")
    start, strings = place_parts(F.col("place"))
    copies = found.filter(~F.col("first")).select("_doc", start.alias("start"), (start + strings + (WIDTH - 1)).alias("end"))
    firsts = found.filter("first").select("anchor", "_doc", start.alias("start"), strings.alias("strings"))
    counts = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    chosen = firsts.join(counts, "anchor").select(
        "anchor", "_doc", "start", "strings", (F.col("_n") > MANY).alias("many")
    )
    cut = stage(with_bytes(chosen, docs), "cut")
    size = cut.filter(~F.col("many")).agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    blocks = repeated_in_blocks(cut.filter(~F.col("many")), 1 + size // BLOCK_BYTES)
    return copies.unionAll(blocks).unionAll(repeated_one_by_one(cut.filter("many")))


def in_order(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``_doc``, a number in the order of the documents, and whether rows
    may share one.

    That is the doc_id if it is a whole number, no row repeats one and none is null. Else
    the different (doc_id, text) are numbered, null ids last, texts of one id by their
    hash; rows that repeat both have one number.
    """
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if whole and odd.isEmpty():
        return docs.withColumn("_doc", F.col("doc_id").cast("long")), False
    keyed = docs.withColumn("_key", document_key(F.col("doc_id"), F.col("text")))
    keys = keyed.select("doc_id", "_key").distinct()
    keys = numbered(keys, [F.col("doc_id").asc_nulls_last(), F.col("_key")], "_doc")
    return keyed.join(stage(keys.select("_key", "_doc"), "order"), "_key").drop("_key"), True


def kept(text: Column, spans: Column) -> Column:
    """Struct of ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (bytes)."""

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_spans in batches:
            rows = []
            for text, found in zip(encoded(texts), all_spans, strict=True):
                left, removed, n, end = [], 0, 0, 0
                for a, b in sorted((s["start"], s["end"]) for s in (() if found is None else found)):
                    if a > end or not n:
                        left.append(text[end:a])
                        n += 1
                        removed += b - a
                    else:
                        removed += max(b - end, 0)
                    end = max(end, b)
                left.append(text[end:])
                rest = b"".join(left)
                rows.append((removed, n, hashlib.sha256(rest).hexdigest(), rest))
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "kept"])

    return cut(text, spans)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of every row of ``docs``.

    Removes each byte that is in a string of 100 bytes which also starts earlier, in an
    earlier document or earlier in the same one (ids that are no whole numbers are
    ordered as Spark orders their type); strings are judged as they are in the input, and never cross documents. Null texts count as empty; texts below 100 bytes
    stay; a null doc_id comes after all others; rows that repeat a doc_id and its text
    are one document (nothing is removed for the sake of the other), rows that repeat
    a doc_id with another text are documents of their own; other columns are not
    looked at; an empty table gives an empty result.
    """
    docs, repeated = in_order(docs.select("doc_id", "text"))
    spans = repeated_spans(docs.dropDuplicates(["_doc"]) if repeated else docs)
    spans = stage(spans.groupBy("_doc").agg(F.collect_set(F.struct("start", "end")).alias("_spans")), "spans")
    rows = docs.join(spans.hint("merge"), "_doc", "left")
    rows = rows.withColumn("_cut", kept(F.col("text"), F.col("_spans")))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return rows.select("doc_id", n_bytes, "_cut.n_removed", "_cut.n_spans", "_cut.kept_sha256", "_cut.kept")


def deduplicate_substrings(docs: DataFrame) -> DataFrame:
    """:func:`remove_repeats` without the bytes that are kept."""
    return remove_repeats(docs).drop("kept")
