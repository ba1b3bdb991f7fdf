"""A manifest of a dataset: hash trees whose parents keep the states of their hash.

Each row is a leaf. Per group of rows (a language), the leaves in order of their id are
the bottom of a tree of eight children a parent; the trees' roots, in order of the
groups, are the bottom of one more tree, whose root stands for the dataset.

A parent's hash runs over its children's digests. The state before each child is kept
with the parent, 32 bytes each. To fold a changed leaf into the root, each parent on
its way is resumed at the state kept for that child: only the new digest and the
siblings to its right are hashed, never those to its left.

Trees are grown in tiers of blocks. A block is five levels over at most 8^5 neighbours
and is grown by one task of bounded size; the tops of the blocks are the leaves of the
next tier, so 8^15 leaves need three tiers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from factloom.llm import sha_states
from factloom.llm.common import joined, numbered
from factloom.staging import stage

ARITY = 8
LEVELS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "tree long, block long, level int, node long, digest binary, states binary, top boolean, n long"
# A step of a path: slot and number of children, state before the slot, all children.
STEP = 2 + 32 + 32 * ARITY


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as ``-`` if null, else its length in bytes, ``:`` and value."""

    def part(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(f) for f in fields]), 256))


def depth(n: int) -> int:
    """Levels of parents over ``n`` nodes."""
    levels = 0
    while ARITY**levels < n:
        levels += 1
    return levels


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of joined 32-byte pieces as an array of such rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def pieces(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def parents(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the parents, and the state of its parent before each child."""
    count = -(-len(digests) // ARITY)
    state = sha_states.start(count)
    before = np.empty_like(digests)
    for slot in range(ARITY):
        children = digests[slot::ARITY]
        held = len(children)
        before[slot::ARITY] = sha_states.to_bytes(state[:, :held])
        if held:
            state[:, :held] = sha_states.absorb(state[:, :held], children)
    absorbed = np.minimum(ARITY, len(digests) - ARITY * np.arange(count))
    return sha_states.finish(state, absorbed), before


def grown(tier: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """A function from the bottom of a block of at most ``most`` levels to all its nodes."""

    def grow(bottom: pa.Table) -> pa.Table:
        bottom = bottom.sort_by("place")
        n = bottom["n"][0].as_py()
        levels = min(most, max(depth(n) - most * tier, 0))
        digests, states = rows_of(bottom["digest"]), pa.nulls(len(bottom), pa.binary())
        out = []
        for level in range(levels + 1):
            size = len(digests)
            out.append(
                pa.table(
                    {
                        "tree": pa.repeat(bottom["tree"][0], size),
                        "block": pa.repeat(bottom["block"][0], size),
                        "level": pa.array(np.full(size, level, dtype=np.int32)),
                        "node": pa.array(np.arange(size, dtype=np.int64)),
                        "digest": pieces(digests),
                        "states": states,
                        "top": pa.array(np.full(size, level == levels)),
                        "n": pa.array(np.full(size, n, dtype=np.int64)),
                    }
                )
            )
            if level < levels:
                digests, before = parents(digests)
                cut = range(0, len(before), ARITY)
                states = pa.array([before[k : k + ARITY].tobytes() for k in cut], pa.binary())
        return pa.concat_tables(out)

    return grow


def block(levels: int) -> Column:
    return F.expr(f"place div {ARITY**levels}")


def build(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of all trees over ``leaves`` (``tree``, ``place``, ``digest``, and ``n``,
    the number of leaves of the tree), one written table for each tier."""
    tiers: list[DataFrame] = []
    most = leaves.agg(F.max("n")).first()[0] or 0
    while not tiers or most > ARITY ** (levels * len(tiers)):
        blocks = leaves.select("tree", block(levels).alias("block"), "place", "digest", "n")
        grow = grown(len(tiers), levels)
        tiers.append(stage(blocks.groupBy("tree", "block").applyInArrow(grow, NODES), "nodes"))
        leaves = tops(tiers[-1])
    return tiers


def tops(nodes: DataFrame) -> DataFrame:
    """The top of each block, as a leaf of the next tier."""
    return nodes.filter("top").select("tree", F.col("block").alias("place"), "digest", "n")


def steps(nodes: pa.Table, at: np.ndarray) -> np.ndarray:
    """The ways from the nodes ``at`` of a block's bottom to its top, as (n, levels, STEP)."""
    nodes = nodes.sort_by([("level", "ascending"), ("node", "ascending")])
    digests = rows_of(nodes["digest"])
    sizes = np.bincount(nodes["level"].to_numpy())
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(at), len(sizes) - 1, STEP), dtype=np.uint8)
    for level in range(len(sizes) - 1):
        children = digests[first[level] : first[level] + sizes[level]]
        above = nodes["states"].slice(first[level + 1], sizes[level + 1])
        slot = at % ARITY
        base = at - slot
        count = np.minimum(ARITY, sizes[level] - base)
        out[:, level, 0], out[:, level, 1] = slot, count
        out[:, level, 2:34] = rows_of(above)[at]
        family = np.minimum(base[:, None] + np.arange(ARITY), sizes[level] - 1)
        out[:, level, 34:] = children[family].reshape(len(at), -1)
        at = at // ARITY
    return out


def fold(
    digest: np.ndarray, proof: np.ndarray, absorbed: np.ndarray, way: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tops that follow from ``digest`` on its ``way``, and the hash of the siblings so far.

    A parent's hash is resumed at the state before the slot, and takes the digest and
    what is right of it; the hash ``proof`` takes all the siblings, left to right.
    """
    digest, proof, absorbed = digest.copy(), proof.copy(), absorbed.copy()
    for level in range(way.shape[1]):
        step = way[:, level]
        slot, count = step[:, 0], step[:, 1]
        children = step[:, 34:].reshape(len(step), ARITY, 32)
        state = sha_states.from_bytes(step[:, 2:34])
        for child in range(ARITY):
            rows = np.flatnonzero((child < count) & (child != slot))
            if len(rows):
                proof[:, rows] = sha_states.absorb(proof[:, rows], children[rows, child])
            rows = np.flatnonzero((child < count) & (child >= slot))
            if len(rows):
                now = np.where((child == slot)[rows, None], digest[rows], children[rows, child])
                state[:, rows] = sha_states.absorb(state[:, rows], now)
        absorbed += count - np.uint8(1)
        digest = sha_states.finish(state, count)
    return digest, proof, absorbed


def folded(rows: pa.Table, way: np.ndarray) -> pa.Table:
    """``rows`` with ``folded``, ``proof`` and ``absorbed`` brought on along the ``way``."""
    proof, absorbed = sha_states.from_bytes(rows_of(rows["proof"])), rows["absorbed"].to_numpy()
    digest, proof, absorbed = fold(rows_of(rows["folded"]), proof, absorbed, way)
    new = {"folded": pieces(digest), "proof": pieces(sha_states.to_bytes(proof)), "absorbed": pa.array(absorbed)}
    for name, column in new.items():
        rows = rows.set_column(rows.column_names.index(name), name, column)
    return rows


def fold_in_blocks(nodes: DataFrame, rows: DataFrame, levels: int) -> DataFrame:
    """Fold the leaves ``rows`` within their blocks; their ``place`` is then the block's."""

    def through(held: pa.Table, leaves: pa.Table) -> pa.Table:
        if not len(leaves):
            return rows_schema.empty_table()
        at = leaves["place"].to_numpy() % ARITY**levels
        done = folded(leaves.drop_columns(["block"]), steps(held, at))
        return done.set_column(done.column_names.index("place"), "place", leaves["block"])

    rows_schema = to_arrow_schema(rows.schema)
    blocked = rows.withColumn("block", block(levels))
    one = nodes.groupBy("tree", "block")
    return one.cogroup(blocked.groupBy("tree", "block")).applyInArrow(through, rows.schema)


def fold_through(nodes: DataFrame, rows: DataFrame, levels: int) -> DataFrame:
    """Fold ``rows`` through a higher tier, where very many of them may share a block.

    Its nodes are few; the way of each of its leaves is made once and joined to the rows.
    """

    def ways(held: pa.Table) -> pa.Table:
        bottom = int(np.count_nonzero(held["level"].to_numpy() == 0))
        at = np.arange(bottom)
        way = steps(held, at)
        return pa.table(
            {
                "tree": pa.repeat(held["tree"][0], bottom),
                "place": pa.array(at + ARITY**levels * held["block"][0].as_py()),
                "way": pa.array([w.tobytes() for w in way], pa.binary()),
            }
        )

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table["way"].to_pylist()
            lengths = np.array([len(w) for w in held])
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                way = np.frombuffer(b"".join(held[k] for k in at), dtype=np.uint8)
                some = table.drop_columns(["way"]).take(pa.array(at))
                yield from folded(some, way.reshape(len(at), length // STEP, STEP)).to_batches()

    made = stage(nodes.groupBy("tree", "block").applyInArrow(ways, "tree long, place long, way binary"), "ways")
    met = joined(rows, made, ["tree", "place"]).select(*rows.columns, "way")
    return met.mapInArrow(through, rows.schema).withColumn("place", block(levels))


@dataclass
class Manifest:
    """A dataset's trees: ``groups`` has ``tree``, the group's place in order, and ``n``;
    ``leaves`` each row's ``doc_id``, ``tree``, ``place``, ``digest`` (and ``changed``);
    ``tiers`` the nodes of the groups' trees, ``top_tiers`` those of the tree over them,
    in blocks of ``levels`` levels."""

    groups: DataFrame
    leaves: DataFrame
    tiers: list[DataFrame]
    top_tiers: list[DataFrame]
    levels: int

    def subroots(self) -> DataFrame:
        return self.tiers[-1].filter("top").select("tree", F.col("digest").alias("subroot"))

    def root(self) -> bytes | None:
        """The digest of the dataset; None if it has no row."""
        found = self.top_tiers[-1].filter("top").select("digest").first()
        return bytes(found[0]) if found else None


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "lang",
    changes: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> Manifest:
    """Grow the trees of ``docs``.

    Rows are ordered by ``doc_id`` within their ``group`` (null first, UTF-8 bytewise),
    rows of one id by their digest. ``changes`` gives columns whose values differ in a
    second version of the rows; its digests are kept beside the first, to be folded.
    """
    now = [F.col(f"`{f}`") for f in fields]
    then = [(changes or {}).get(f, F.col(f"`{f}`")) for f in fields]
    rows = docs.select(
        F.col(group).isNull().alias("_none"),
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_group"),
        "doc_id",
        leaf(now).alias("digest"),
        leaf(then).alias("changed"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("_none").desc(), F.col("_group"), F.col("doc_id"), F.col("digest"), F.col("_row")]
    rows = stage(numbered(rows, order, "place").drop("_row"), "placed")
    groups = rows.groupBy("_none", "_group").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("_first"))
    groups = stage(numbered(groups, [F.col("_none").desc(), F.col("_group")], "tree"), "groups")
    leaves = joined(rows, groups, ["_none", "_group"]).select(
        "doc_id", "tree", (F.col("place") - F.col("_first")).alias("place"), "digest", "changed", "n"
    )
    leaves = stage(leaves, "leaves")
    tiers = build(leaves, levels)
    count = F.lit(groups.count()).cast("long").alias("n")
    below = tiers[-1].filter("top")
    over = below.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", count)
    return Manifest(groups, leaves, tiers, build(over, levels), levels)


def folded_roots(made: Manifest, changed: DataFrame) -> DataFrame:
    """``changed`` (``tree``, ``place``, ``folded``: the digest that now stands for the leaf;
    other columns are passed on) with ``folded`` the dataset's root if only that leaf
    changes, and ``proof_sha256``, the hash of all siblings on the way."""
    empty = sha_states.START.astype(">u4").tobytes()
    rows = changed.withColumns({"proof": F.lit(empty), "absorbed": F.lit(0).cast("long")})
    rows = fold_in_blocks(made.tiers[0], rows, made.levels)
    for nodes in made.tiers[1:]:
        rows = fold_through(nodes, rows, made.levels)
    # The groups' roots are the leaves of one more tree.
    rows = rows.withColumns({"place": F.col("tree"), "_tree": F.col("tree"), "tree": F.lit(0).cast("long")})
    for nodes in made.top_tiers:
        rows = fold_through(nodes, rows, made.levels)
    rows = rows.withColumn("tree", F.col("_tree")).drop("_tree", "place")
    closed = StructType([f for f in rows.schema if f.name not in ("proof", "absorbed")])
    closed = closed.add(StructField("proof_sha256", BinaryType()))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if len(table):
                state = sha_states.from_bytes(rows_of(table["proof"]))
                digest = sha_states.finish(state, table["absorbed"].to_numpy())
                table = table.drop_columns(["proof", "absorbed"]).append_column("proof_sha256", pieces(digest))
                yield from table.to_batches()

    return rows.mapInArrow(close, closed)


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def verified(docs: DataFrame, changes: dict[str, Column], levels: int = LEVELS) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row.

    Trees are grown over ``docs``; then the row as ``changes`` leaves it is folded along
    its way, and ``verified`` says whether that gives the dataset's root. Null fields
    and null ids have their own mark and place (first); a null language is a group.
    Rows that repeat are leaves of their own. Texts are hashed whole. An empty table
    gives an empty result; columns that are not fields of a leaf are not looked at.
    """
    made = manifest(docs, changes=changes, levels=levels)
    root = made.root()
    leaves = made.leaves.select("doc_id", "tree", "place", "digest", F.col("changed").alias("folded"))
    rows = folded_roots(made, leaves)
    rows = joined(rows, stage(made.subroots(), "subroots"), ["tree"])
    root = F.lit(root).cast(BinaryType())
    return rows.select(
        "doc_id",
        text_of(F.col("digest")).alias("leaf"),
        text_of(F.col("subroot")).alias("subroot"),
        text_of(root).alias("root"),
        text_of(F.col("proof_sha256")).alias("proof_sha256"),
        text_of(F.col("folded")).alias("folded_root"),
        F.coalesce(F.col("folded") == root, F.lit(False)).alias("verified"),
    )
