"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix by its weight; a source that would be taken more
than ``max_epochs`` times is clamped there, and what it leaves is dealt out again by
weight among the others until no source is above its bound. A source is then taken a
whole number of times, and of the rest as many documents as fill the fraction, in the
order of a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut_words, joined, numbered
from factloom.staging import stage

# Documents of a source are dealt by hash into this many parts to find where the
# fraction ends; only the part in which it ends is sorted.
PARTS = 4096
SOURCE = ["_no_source", "_source"]


def place(doc_id: Column, seed: int) -> Column:
    """A number below 2^48 by the seeded hash of the id; the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def fill(sources: DataFrame, budget: float, max_epochs: int) -> DataFrame:
    """Add ``target`` to ``sources`` (``source_size``, ``weight``).

    Each round brings two sums to the driver: what the clamped sources take, and the
    weight of the others. The water level only rises, so a clamped source stays so.
    """
    bound = (F.col("source_size") * max_epochs).cast("double")
    left, weight, clamped = float(budget), None, -1
    while True:
        over = F.lit(False) if weight is None else bound * weight <= F.col("weight") * left
        row = sources.agg(
            F.sum(F.when(over, bound)).alias("taken"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if row.n == clamped:
            break
        clamped, left, weight = row.n, budget - (row.taken or 0.0), float(row.weight or 0)
        if not weight:
            over = F.lit(True)
            break
    level = F.col("weight") * F.lit(left) / F.lit(weight or 1.0)
    return sources.withColumn("target", F.when(over, bound).otherwise(level))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 7,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row of ``docs``.

    ``size`` is the number of words; sources by code point, null last, get ``weights``
    in turn, and share ``share`` times all words. ``share`` above ``max_epochs`` fills
    every source to its bound. Null and empty texts have size 0 and take 0; a source of
    size 0 has target 0; null ids share one place in the order; repeated rows are
    rows of their own (equal ones are told apart arbitrarily, which gives the same rows);
    an empty table gives an empty result. All documents are counted, and none is
    collected: a source with most of the rows is summed up in ``PARTS`` parts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        F.col("source").isNull().alias("_no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        F.size(cut_words(text)).cast("long").alias("size"),
        place(F.col("doc_id"), seed).alias("_place"),
    ).withColumn("_part", F.col("_place") % PARTS)
    sized = stage(sized, "sized")
    parts = stage(sized.groupBy(*SOURCE, "_part").agg(F.sum("size").alias("_size")), "parts")
    sources = parts.groupBy(*SOURCE).agg(F.sum("_size").alias("source_size"))
    sources = numbered(sources, [F.col(c) for c in SOURCE], "_n")
    given = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("weight", given[(F.col("_n") % len(weights)).cast("int")])
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))
    targets = fill(sources, min(share, max_epochs) * total, max_epochs).select(
        *SOURCE,
        "source_size",
        "target",
        F.coalesce(whole, F.lit(0)).cast("long").alias("_whole"),
    )
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    targets = stage(targets.withColumn("_rest", rest), "targets")

    # The part of each source in which the fraction ends, and what lies before it.
    running = Window.partitionBy(*SOURCE).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.withColumn("_upto", F.sum("_size").over(running)).join(targets, SOURCE)
    ends = ends.filter("_upto > _rest").groupBy(*SOURCE).agg(
        F.min("_part").alias("_end"), F.min("_upto").alias("_end_upto"),
        F.min_by("_size", "_part").alias("_end_size"),
    )
    plan = targets.join(ends, SOURCE, "left")
    plan = stage(
        plan.select(
            *SOURCE, "source_size", "target", "_whole",
            F.coalesce("_end", F.lit(PARTS)).alias("_end"),
            (F.col("_rest") - (F.col("_end_upto") - F.col("_end_size"))).alias("_room"),
        ),
        "plan",
    )
    dealt = joined(sized, plan, SOURCE)
    inside = Window.partitionBy(*SOURCE).orderBy("_place", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    columns = ["doc_id", "size", "source_size", "target"]
    clear = dealt.filter("_part <> _end").select(
        *columns, (F.col("size") * (F.col("_whole") + (F.col("_part") < F.col("_end")).cast("long"))).alias("taken")
    )
    # The document in which the fraction ends is in if that is nearer than out.
    fits = 2 * F.sum("size").over(inside) - F.col("size") <= 2 * F.col("_room")
    last = dealt.filter("_part = _end").select(
        *columns, (F.col("size") * (F.col("_whole") + fits.cast("long"))).alias("taken")
    )
    return clear.unionAll(last)
