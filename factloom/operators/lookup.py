"""Joining a large table to a lookup table whose size is not known in advance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup table is broadcast only if it stays within both bounds.
MAX_BROADCAST_ROWS = 5_000_000
MAX_BROADCAST_BYTES = 256 * 1024 * 1024

# Number of parts a key's rows are spread over when the lookup is shuffled.
SALTS = 32

# Words of a sentence whose rare words travel as one list.
STRETCH = 64

# So many of the most frequent words are broadcast where all of them are too many.
MAX_FREQUENT_ROWS = 500_000


def fits_broadcast(
    lookup: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> bool:
    """Measure ``lookup`` (one small aggregate) against the broadcast bounds."""
    width = sum(
        (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16)
        for c in lookup.columns
    )
    rows, size = lookup.agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    broadcast: bool,
    spread_by: Sequence[str] = (),
    salts: int = SALTS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join on ``on``, with ``broadcast`` saying whether ``lookup`` is small enough.

    If it is not, both sides are shuffled, and the rows of each key on the left
    are spread over ``salts`` parts (chosen by the columns ``spread_by``) that
    each meet a copy of the lookup row. A key that holds a third of all rows then
    costs ``salts`` tasks, not one. ``lookup`` is the side that is copied, so it
    should be unique on ``on`` or smaller than ``left``. A ``lookup`` about as large as
    ``left`` should come with ``hot``, a small table of the keys that are worth it: only
    these are spread and copied then, and any other row is shuffled once.
    """
    on = list(on)
    if broadcast:
        return left.join(F.broadcast(lookup), on, how)
    salt = F.pmod(F.xxhash64(*(spread_by or left.columns)), F.lit(salts)).cast("int")
    last = F.lit(salts - 1)
    if hot is not None:
        marked = F.broadcast(hot.select(*on).distinct().withColumn("_hot", F.lit(True)))
        left, lookup = left.join(marked, on, "left"), lookup.join(marked, on, "left")
        salt, last = F.when(F.col("_hot"), salt).otherwise(0), F.when(F.col("_hot"), last).otherwise(0)
    copies = F.explode(F.sequence(F.lit(0), last))
    left, lookup = left.withColumn("_salt", salt), lookup.withColumn("_salt", copies)
    if hot is not None:
        left, lookup = left.drop("_hot"), lookup.drop("_hot")
    return left.join(lookup, [*on, "_salt"], how).drop("_salt")


def most_frequent(lookup: DataFrame, n: str = "n", max_rows: int = MAX_FREQUENT_ROWS) -> DataFrame:
    """The rows of ``lookup`` with the greatest ``n``, ``max_rows`` at most.

    Rows are taken by powers of two of ``n``, so equal counts stay together, and all
    that comes to the driver is how many rows each power has.
    """
    power = F.floor(F.log2(F.col(n))).cast("int")
    sizes = lookup.filter(F.col(n) > 0).groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("rows")).collect()
    rows, least = 0, 62
    for r in sorted(sizes, key=lambda r: -r["p"]):
        rows += r["rows"]
        if rows > max_rows:
            break
        least = r["p"]
    return lookup.filter(F.col(n) >= 2**least)


def lookup_tokens(
    tokens: DataFrame,
    lookup: DataFrame,
    frequent: DataFrame,
    on: str,
    words: DataFrame | None = None,
    group: Sequence[str] = ("doc_id", "sent_no"),
    place: str = "tok_no",
) -> DataFrame:
    """Left join of ``tokens`` to a ``lookup`` (unique on ``on``) too large to be broadcast.

    ``frequent``, its rows for the most frequent words, is broadcast and serves most
    tokens where they are. Only the others are shuffled, as ``group``, ``place`` and word
    alone, to the lookup and back, and reach their sentence as lists of one stretch of it
    each; so tokens spread by ``group`` stay where they are. ``words`` may give the tokens' ``group``, ``place``
    and ``on`` from a shorter plan.
    """
    group, values = list(group), [c for c in lookup.columns if c != on]
    rest = (tokens if words is None else words).select(*group, place, on).filter(F.col(on).isNotNull())
    rest = rest.join(F.broadcast(frequent.select(on)), on, "left_anti")
    rare = lookup.join(F.broadcast(frequent.select(on)), on, "left_anti")
    listed = F.collect_list(F.struct(place, on, *values)).alias("_rare")
    block = F.floor(F.col(place) / STRETCH).cast("long")
    met = rest.join(rare, on).repartition(*group).groupBy(*group, block.alias("_block")).agg(listed)
    met = met.withColumnsRenamed({c: f"_of_{c}" for c in group})
    served = tokens.join(F.broadcast(frequent.select(on, F.struct(*values).alias("_met"))), on, "left")
    # The stretch is a condition, not a key: keyed by it the tokens would be shuffled anew.
    same = [F.col(c) == F.col(f"_of_{c}") for c in group] + [block - F.col("_block") == 0]
    served = served.join(met.hint("shuffle_hash"), same, "left")
    # Where keys of sentences repeat, the list has the tokens of all of them.
    own = F.filter("_rare", lambda r: (r[place] == F.col(place)) & (r[on] == F.col(on)))
    own = F.when(F.col("_rare").isNotNull() & F.col("_met").isNull(), F.get(own, F.lit(0)))
    found = served.withColumn("_own", own)
    return found.select(
        *tokens.columns, *[F.coalesce(f"_met.{c}", f"_own.{c}").alias(c) for c in values]
    )
