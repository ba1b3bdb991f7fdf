"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its word five-mers, each labelled with how often it came
before, so that all are different. A sketch takes the ``length`` five-mers of the least
seeded hash values and keeps them in text order: two texts share a sketch only if they
share these five-mers in the same order, which edits between them rarely change and
moved parts do.

Texts of one sketch are a bucket, and two texts that share a bucket are in one class or
are compared. Most pairs need no comparison of their own: each member is first compared
with one member of its bucket, the strongest pairs (most sketches shared) first, then
those that are not in one class yet; a second round splits the buckets by a second
sketch and compares with the other end, a third compares the buckets that still hold
several classes with the member that shares most. What is left of these buckets is dealt
into blocks, and all pairs of different classes are compared block by block.

The similarity is that of the best alignment of the five-mers: those aligned over all
of either text. As it has to reach a threshold, the alignment only needs a band around
the diagonal.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.shingles import K, labelled, spread
from factloom.staging import stage

SKETCHES, LENGTH = 20, 3
THRESHOLD = 0.8
# Characters of texts that a task sketches at once (a longer text by itself).
AT_ONCE = 2_000_000
# Members of one bucket's text that share a copy of it in a join.
SHARE = 500
# Texts, and characters of texts, that a block of a bucket holds (about).
BLOCK, BLOCK_SIZE = 256, 2_000_000
BUCKET = ["_slot", "_value"]


def sketches(texts: list[str], count: int = SKETCHES, length: int = LENGTH) -> list[np.ndarray | None]:
    """``count`` sketches of each text; None for a text without words."""
    gram, sizes = labelled(texts)
    has = np.flatnonzero(sizes)
    if not len(has):
        return [None] * len(texts)
    sizes_had = sizes[has]
    starts = np.cumsum(sizes_had) - sizes_had
    out = np.empty((len(has), count), dtype=np.uint64)
    last = np.uint64(2**64 - 1)
    seeds = spread(np.arange(1, count + 1, dtype=np.uint64))
    for j, seed in enumerate(seeds):
        value = spread(gram ^ seed)
        places = np.full((len(has), length), len(gram), dtype=np.int64)
        for taken in range(length):
            least = np.minimum.reduceat(value, starts)
            at = np.flatnonzero(value == np.repeat(least, sizes_had))
            row = np.searchsorted(starts, at, side="right") - 1
            open_ = value[at] != last
            at, row = at[open_], row[open_]
            places[row, taken] = at
            value[at] = last
        places.sort(axis=1)
        total = np.full(len(has), seed)
        padded = np.r_[gram, np.uint64(0)]
        for taken in range(length):
            total = spread(total + padded[places[:, taken]])
        out[:, j] = total
    result: list[np.ndarray | None] = [None] * len(texts)
    for row, text in enumerate(has):
        result[text] = out[row].view(np.int64)
    return result


def grouped(texts: list[str], at_once: int) -> Iterator[list[str]]:
    """The texts in order, in lists of bounded size."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > at_once:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def sketch(text: Column) -> Column:
    """The sketches of a text; null for null and for texts without words."""

    @F.pandas_udf("array<long>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found: list[np.ndarray | None] = []
            for held in grouped(["" if pd.isna(t) else t for t in batch], AT_ONCE):
                found.extend(sketches(held))
            yield pd.Series(found, dtype=object)

    return sketched(text)


def increasing(values: np.ndarray) -> int:
    """Length of the longest increasing subsequence of different numbers."""
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return len(values)
    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
        else:
            tails[at] = v
    return len(tails)


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned share of two sequences of different symbols; below the threshold it may be 0.

    As no symbol repeats, the best alignment is the longest increasing run of places.
    An alignment that reaches the threshold leaves out at most ``band`` symbols in all,
    so symbols that are further apart can't be in it.
    """
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    band = int(total * (1 - threshold) / (1 + threshold)) + 1
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < threshold * (total - len(at_a)):
        return 0.0
    same = increasing(at_b[np.argsort(at_a)])
    return same / (total - same)


def alike(left: Column, right: Column, threshold: float) -> Column:
    @F.pandas_udf("boolean")
    def compared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            found = []
            for x, y in zip(a, b, strict=True):
                gram, sizes = labelled([x, y])
                found.append(alignment(gram[: sizes[0]], gram[sizes[0] :], threshold) >= threshold)
            yield pd.Series(found, dtype=bool)

    return compared(left, right)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def stars(buckets: DataFrame, on: list[str], end: Column) -> DataFrame:
    """``(a, b, n)``: each member with one end of its bucket, and in how many buckets.

    Only pairs of different classes; a bucket's end is an aggregate that combines
    before the shuffle.
    """
    ends = buckets.groupBy(*on).agg(end.alias("a"), F.min("class").alias("_low"), F.max("class").alias("_high"))
    ends = ends.filter("_low <> _high").drop("_low", "_high")
    pairs = buckets.join(ends, on).filter(F.col("a") != F.col("_key"))
    return pairs.groupBy("a", F.col("_key").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts are alike.

    ``a`` may be in very many pairs: its text gets a copy per ``SHARE`` of them.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("_copies"))
    spread_pairs = pairs.select("a", "b").join(counts, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("_copies")).cast("int").alias("_copy")
    )
    lefts = counts.join(texts.select(F.col("_key").alias("a"), F.col("text").alias("_left")), "a").select(
        "a", "_left", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy")
    )
    rights = texts.select(F.col("_key").alias("b"), F.col("text").alias("_right"))
    both = spread_pairs.join(rights, "b").join(lefts, ["a", "_copy"])
    return stage(both.filter(alike(F.col("_left"), F.col("_right"), threshold)).select("a", "b"), "links")


def classes_of_texts(sketched: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """``(node, component)`` of the texts (by key) that are alike another text."""
    slots = sketched.select("_key", F.posexplode("_sketch").alias("_slot", "_value"), "_sketch")
    second = F.get("_sketch", F.pmod(F.col("_slot") + 1, F.lit(SKETCHES)))
    buckets = slots.select("_key", "_slot", "_value", second.alias("_second"))
    rounds = [
        (["_slot", "_value"], F.min("_key")),
        (["_slot", "_value", "_second"], F.max("_key")),
    ]
    links = labels = tested = texts = None

    for on, end in rounds:
        found = stars(classed(buckets, labels, "_key", "class"), on, end)
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti")
        found = stage(found, "pairs")
        if found.isEmpty():
            continue
        if texts is None:
            texts = candidate_texts(sketched, docs, found)
        elif labels is not None:
            texts = candidate_texts(sketched, docs, found)
        strongest = found.groupBy("b").agg(F.max(F.struct("n", "a")).alias("_m")).select("_m.a", "b")
        strongest = stage(strongest, "strongest")
        links = add(links, verified(strongest, texts, threshold))
        labels = components(links)
        others = found.select("a", "b").join(strongest, ["a", "b"], "left_anti")
        others = stage(apart(others, labels), "others")
        if not others.isEmpty():
            links = add(links, verified(others, texts, threshold))
            labels = components(links)
        tested = add(tested, found.select("a", "b"))
    if labels is None:
        return None
    return settled(buckets.select(*BUCKET, "_key"), sketched, docs, links, labels, threshold)


def classed(df: DataFrame, labels: DataFrame | None, key: str, name: str) -> DataFrame:
    """``df`` with the class of ``key``; a text that is alike none is its own class."""
    if labels is None:
        return df.withColumn(name, F.col(key))
    known = labels.select(F.col("node").alias(key), F.col("component").alias(name))
    return df.join(known, key, "left").withColumn(name, F.coalesce(name, key))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of different classes."""
    both = classed(classed(pairs, labels, "a", "_class_a"), labels, "b", "_class_b")
    return both.filter("_class_a <> _class_b").select("a", "b")


def unsettled(rows: DataFrame, labels: DataFrame, end: Column) -> DataFrame:
    """``rows`` (bucket, ``_key``) with ``class``, but for the end of each bucket, which
    was compared with all others, and for the buckets whose other rows are one class."""
    columns = [*BUCKET, "_key"]
    ends = rows.groupBy(*BUCKET).agg(end.alias("_end"), F.count(F.lit(1)).alias("_n")).filter("_n > 2")
    left = rows.join(ends, BUCKET).filter("_key <> _end").select(*columns)
    left = stage(classed(left, labels, "_key", "class").select(*columns, "class"), "left")
    mixed = left.groupBy(*BUCKET).agg(F.min("class").alias("_low"), F.max("class").alias("_high"))
    return stage(left.join(mixed.filter("_low <> _high").select(*BUCKET), BUCKET), "unsettled")


def settled(
    buckets: DataFrame, sketched: DataFrame, docs: DataFrame, links: DataFrame, labels: DataFrame, threshold: float
) -> DataFrame:
    """The labels once every pair of each bucket is in one class or was compared."""
    rows = unsettled(buckets, labels, F.min("_key"))
    if rows.isEmpty():
        return labels
    texts = candidate_texts(sketched, docs, rows.select(F.col("_key").alias("a"), F.col("_key").alias("b")))

    sizes = rows.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    weights = rows.join(sizes, BUCKET).groupBy("_key").agg(F.sum("_n").alias("_weight"))
    rows = stage(rows.join(weights, "_key"), "weighted")
    most = F.max_by("_key", F.struct("_weight", "_key"))
    found = stage(apart(stars(rows, BUCKET, most).select("a", "b"), labels), "pairs")
    if not found.isEmpty():
        links = add(links, verified(found, texts, threshold))
        labels = components(links)
    rows = unsettled(rows.drop("class"), labels, most)
    if rows.isEmpty():
        return labels

    held = stage(
        texts.join(sketched.select("_key", "_sketch"), "_key").select(
            "_key", "_sketch", "text", F.length("text").alias("_size")
        ),
        "held",
    )
    for within in (True, False):
        now = classed(rows.drop("class"), labels, "_key", "class")
        sides = stage(block_sides(now.join(held.select("_key", "_size"), "_key"), within), "sides")
        if sides.isEmpty():
            continue
        blocks = sides.join(held.drop("_size"), "_key").groupBy("_slot", "_value", "_pair")
        links = add(links, stage(blocks.applyInPandas(block_links(threshold), "a binary, b binary"), "links"))
        labels = components(links)
    return labels


def block_sides(rows: DataFrame, within: bool) -> DataFrame:
    """``rows`` once for each pair of blocks that they are a side of, as ``_pair``, ``_side``.

    A class of many texts of a bucket has blocks of its own, which are not paired with
    each other; a block paired with itself has one side. ``within``: only these, and
    only of buckets with more than one block.
    """
    none = F.unhex(F.lit(""))
    parts = rows.groupBy(*BUCKET, "class").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_size"))
    parts = parts.withColumn("_own", F.when(F.col("_n") >= BLOCK, F.col("class")).otherwise(none))
    needed = F.greatest(F.sum("_n") / BLOCK, F.sum("_size") / BLOCK_SIZE)
    groups = parts.groupBy(*BUCKET, "_own").agg(F.greatest(F.ceil(needed), F.lit(1)).cast("int").alias("_blocks"))
    dealt = rows.drop("_size").join(parts.select(*BUCKET, "class", "_own"), [*BUCKET, "class"])
    dealt = dealt.join(groups, [*BUCKET, "_own"]).withColumn(
        "_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")).cast("int")
    )
    units = groups.select(*BUCKET, "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    one = units.select(*BUCKET, F.struct("_own", "_block").alias("_one"))
    two = units.select(*BUCKET, F.struct("_own", "_block").alias("_two"))
    pairs = one.join(two, BUCKET).filter(
        "_one <= _two and (_one._own <> _two._own or length(_one._own) = 0)"
    )
    if within:
        several = units.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*BUCKET)
        pairs = one.withColumn("_two", F.col("_one")).filter("length(_one._own) = 0").join(several, BUCKET)

    def name(unit: str) -> Column:
        return F.concat_ws(":", F.hex(F.col(unit)["_own"]), F.col(unit)["_block"].cast("string"))

    pairs = pairs.withColumn("_pair", F.concat_ws("/", name("_one"), name("_two")))
    lefts = pairs.select(*BUCKET, "_one.*", "_pair", F.lit(0).alias("_side"))
    rights = pairs.filter("_one < _two").select(*BUCKET, "_two.*", "_pair", F.lit(1).alias("_side"))
    return dealt.join(lefts.unionAll(rights), [*BUCKET, "_own", "_block"]).select(
        *BUCKET, "_pair", "_side", "_key", "class"
    )


def block_links(threshold: float):
    """A function of a pair of blocks: links that join all texts alike across its sides.

    Texts of one class are not compared, nor texts that share a bucket of a lower slot,
    where they are compared. Links found join classes for the pairs that follow.
    """

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        keys, slot = rows["_key"].tolist(), int(rows["_slot"].iloc[0])
        gram, sizes = labelled(rows["text"].tolist())
        grams = np.split(gram, np.cumsum(sizes)[:-1])
        held = np.stack(rows["_sketch"].to_list())
        _, group = np.unique([bytes(c).hex() for c in rows["class"]], return_inverse=True)
        side = rows["_side"].to_numpy()
        rights = np.flatnonzero(side == 1)
        found = []
        for i in np.flatnonzero(side == 0):
            others = rights if len(rights) else np.arange(i + 1, len(rows))
            least, most = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            here = (held[others] == held[i]).argmax(axis=1) == slot
            for j in others[here & (least / most >= threshold) & (group[others] != group[i])]:
                if group[j] != group[i] and alignment(grams[i], grams[j], threshold) >= threshold:
                    found.append((keys[i], keys[j]))
                    group[group == group[j]] = group[i]
        return pd.DataFrame(found, columns=["a", "b"])

    return compared


def add(one: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if one is None else one.unionAll(more)


def candidate_texts(sketched: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(_key, text)`` of the texts that are in a pair, each once."""
    keys = pairs.select(F.col("a").alias("_key")).unionAll(pairs.select(F.col("b").alias("_key"))).distinct()
    chosen = sketched.select("_key", F.col("_first").alias("_row")).join(keys, "_key")
    rows = docs.select(text_key(F.col("text")).alias("_key"), F.col("doc_id").alias("_row"), "text")
    return stage(rows.join(chosen, ["_key", "_row"]).dropDuplicates(["_key"]), "texts")


def classed_texts(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The rows with a text as ``(doc_id, _key)``, and the texts as
    ``(_key, _first, class_id, class_size)``; both are written tables."""
    keyed = stage(
        docs.select(
            "doc_id", text_key(F.col("text")).alias("_key"), sketch(F.col("text")).alias("_sketch")
        ),
        "sketched",
    )
    texts = stage(
        keyed.groupBy("_key").agg(
            F.min("doc_id").alias("_first"),
            F.count(F.lit(1)).alias("_copies"),
            F.min("_sketch").alias("_sketch"),
        ),
        "distinct",
    )
    labels = classes_of_texts(texts.filter("_sketch is not null"), docs, threshold)
    known = texts.select("_key", "_first", "_copies")
    if labels is None:
        known = known.withColumn("_class", F.col("_key"))
    else:
        named = labels.select(F.col("node").alias("_key"), F.col("component").alias("_class"))
        known = known.join(named, "_key", "left").withColumn("_class", F.coalesce("_class", "_key"))
    known = stage(known, "classed")
    sizes = known.groupBy("_class").agg(
        F.min("_first").alias("class_id"), F.sum("_copies").alias("class_size")
    )
    of_text = known.join(sizes, "_class").select("_key", "_first", "class_id", "class_size")
    return keyed.select("doc_id", "_key"), stage(of_text, "of_text")


def has_text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, class_size, keeps)`` of every row of ``docs``.

    ``class_id`` is the least doc_id of the class; ``keeps`` marks the row with that id.
    Equal texts are one class without being compared. Null and empty texts are alone,
    each a class of its own; a text without words is alike only its copies; a text of
    fewer than five words is one five-mer. Rows with a null doc_id belong to classes,
    which they don't name unless all ids are null; rows that repeat a doc_id and its
    text are all marked as kept or none. Other columns are not looked at; an empty
    table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    keyed, texts = classed_texts(docs.filter(has_text(F.col("text"))), threshold)
    found = keyed.join(texts, "_key").select("doc_id", "class_id", "class_size")
    alone = docs.filter(~has_text(F.col("text"))).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    keeps = F.col("doc_id").eqNullSafe(F.col("class_id"))
    return found.unionAll(alone).withColumn("keeps", keeps)


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id.

    Of rows that repeat its id and text one stays. Null and empty texts all stay. All
    columns are passed on.
    """
    some = docs.filter(has_text(F.col("text")))
    keyed, texts = classed_texts(some.select("doc_id", "text"), threshold)
    kept = texts.filter(F.col("_first").eqNullSafe(F.col("class_id"))).select(
        F.col("_key").alias("_kept_key"), F.col("_first").alias("_kept_id")
    )
    same = (text_key(F.col("text")) == F.col("_kept_key")) & F.col("doc_id").eqNullSafe(F.col("_kept_id"))
    rows = some.join(kept, same, "left_semi")
    repeated = keyed.groupBy("_key", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        rows = rows.dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.filter(~has_text(F.col("text"))))
