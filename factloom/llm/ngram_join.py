"""Documents whose sets of word n-grams have a high Jaccard similarity, as a join.

The tokens of a document's set are its different five-word shingles. All tokens have one
global order, rare ones first. Of two sets as similar as asked for, the first tokens of
either must overlap: a set of ``s`` tokens can miss at most ``s / 5`` in the other, so a
prefix that no so many misses can break holds something in common.

Tokens are dealt into classes by how frequent they are. A rare token is indexed by
itself, a frequent one only in combinations of ``k`` tokens of its class: a class of
``n`` tokens of the prefix then stands ``n - k`` misses, not ``n - 1``, and the prefix is
extended until all classes together stand one miss more than there can be. To keep
combinations few, the tokens of a class are dealt by hash into parts, whose number
follows from the size of the larger set, so that both sets have the same parts.

Sets that share an entry of the index are candidates. Bitmaps of their tokens give a
least number of tokens that only one of two sets has; candidates that it does not rule
out are compared token by token. Links join classes, and what is one class already needs
no comparison: the sets of an entry are compared with one of them first (the first, then
the one that shares most), then all that are in different classes still, a large entry's
in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from factloom.llm.common import numbered
from factloom.llm.components import components
from factloom.llm.order_minhash import grouped
from factloom.llm.shingles import spread
from factloom.staging import stage

K = 5
# Two sets link if their similarity is HIGH / WHOLE or more.
HIGH, WHOLE = 4, 5
# Counters of the sketch of token counts (a byte each where it is broadcast), and its blocks.
SLOTS, BLOCKS = 2**20, 64
# A slot counts as frequent beyond so many sets over the usual load, or so many of its
# standard deviations; as very frequent beyond so many times that.
FREQUENT, DEVIATIONS, VERY = 64, 8, 64
# Characters of texts that a task reads at once (a longer text by itself).
AT_ONCE = 2_000_000
# Keys of sets that a task remembers so as not to read copies again.
REMEMBERED = 500_000
# Sets of an entry up to which its open pairs are listed; beyond, and sets in a block.
FEW, BLOCK = 8, 256
# A bitmap that tells which texts are wanted has so many bits.
WANTED_BITS = 25

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class Reader:
    """Sets of shingles of many texts at once."""

    def __init__(self) -> None:
        folded = np.arange(256, dtype=np.uint64)
        folded[65:91] += np.uint64(32)
        self.number = spread(folded + np.uint64(1)) | np.uint64(1)
        self.inside = np.ones(256, dtype=bool)
        self.inside[[0x20, *range(0x09, 0x0E)]] = False
        self.power = self.back = np.ones(1, dtype=np.uint64)

    def _powers(self, odd: int, n: int) -> np.ndarray:
        held = np.full(n, odd, dtype=np.uint64)
        held[0] = 1
        return np.cumprod(held)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and how many words each text has."""
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" " + b" ".join(encoded) + b" ", dtype=np.uint8)
        if len(self.power) < len(data):
            self.power = self._powers(_ODD, len(data))
            self.back = self._powers(pow(_ODD, -1, 2**64), len(data))
        inside = self.inside[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        running = np.cumsum(self.number[data] * self.power[: len(data)])
        value = (running[ends - 1] - running[starts - 1]) * self.back[starts]
        value = spread(value + (ends - starts).astype(np.uint64))
        upto = np.cumsum([len(e) + 1 for e in encoded])
        return value, np.diff(np.r_[0, np.searchsorted(starts, upto)])

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sets' tokens, rising within a text, and the size of each text's set."""
        word, count = self.words(texts)
        text = np.repeat(np.arange(len(texts)), count)
        grams = np.where(count > 0, np.maximum(count - K + 1, 1), 0)
        rank = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.flatnonzero(rank < np.repeat(grams, count))
        total = np.zeros(len(begin), dtype=np.uint64)
        for j in range(K):
            at = np.minimum(begin + j, max(len(word) - 1, 0))
            there = (begin + j < len(word)) & (text[at] == text[begin])
            total = spread(total * _MIX + np.where(there, word[at], np.uint64(j)))
        owner = text[begin]
        order = np.lexsort((total, owner))
        total, owner = total[order], owner[order]
        fresh = np.ones(len(total), dtype=bool)
        fresh[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
        return total[fresh], np.bincount(owner[fresh], minlength=len(texts))


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def slots_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time, with their tokens and the sizes of their sets."""
    reader = Reader()
    for batch in batches:
        at = 0
        for texts in grouped(batch.column("text").to_pylist(), AT_ONCE):
            yield batch.slice(at, len(texts)), *reader.sets(texts)
            at += len(texts)


def keyed_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, key)`` of each row; and rows with the counts of a task, of
    each slot, in blocks: ``(block, part, counts)``."""
    schema = StructType([
        docs.schema["doc_id"], StructField("n_shingles", LongType()), StructField("key", BinaryType()),
        StructField("block", IntegerType()), StructField("part", IntegerType()), StructField("counts", BinaryType()),
    ])
    held = to_arrow_schema(schema)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, part = np.zeros(SLOTS, dtype=np.int64), set(), 0
        for rows, tokens, sizes in read_sets(batches):
            ends = np.cumsum(sizes)
            keys = [set_key(tokens[e - s : e]) if s else None for s, e in zip(sizes, ends, strict=True)]
            fresh = np.zeros(len(keys), dtype=bool)
            for k, key in enumerate(keys):
                if key is not None and key not in seen:
                    seen.add(key)
                    fresh[k] = True
            if len(seen) > REMEMBERED:
                seen.clear()
            counts += np.bincount(slots_of(tokens[np.repeat(fresh, sizes)]), minlength=SLOTS)
            part = (part * 31 + int(ends[-1])) % 64
            columns = [rows.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(keys, pa.binary())]
            columns += [pa.nulls(len(keys), f.type) for f in list(held)[3:]]
            yield pa.RecordBatch.from_arrays(columns, schema=held)
        if counts.any():
            blocks = [c.astype(np.int32).tobytes() for c in counts.reshape(BLOCKS, -1)]
            columns = [pa.nulls(BLOCKS, f.type) for f in list(held)[:3]]
            columns += [pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(np.full(BLOCKS, part, np.int32)), pa.array(blocks)]
            yield pa.RecordBatch.from_arrays(columns, schema=held)

    return stage(docs.mapInArrow(keyed, schema), "keyed")


def slot_counts(keyed: DataFrame) -> np.ndarray:
    """In how many sets the tokens of each slot are: a sum over tasks, in two steps."""

    def adder(kind: type):
        def added(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(c, dtype=kind).astype(np.int64) for c in rows["counts"].to_pylist())
            return pa.table({"block": rows["block"][:1], "counts": pa.array([total.tobytes()])})

        return added

    counts = keyed.filter("block is not null").select("block", "part", "counts")
    counts = counts.groupBy("block", "part").applyInArrow(adder(np.int32), "block int, counts binary")
    counts = counts.groupBy("block").applyInArrow(adder(np.int64), "block int, counts binary")
    out = np.zeros((BLOCKS, SLOTS // BLOCKS), dtype=np.int64)
    for block, held in counts.collect():  # SLOTS numbers
        out[block] = np.frombuffer(held, dtype=np.int64)
    return out.reshape(-1)


def ranks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each slot, the place of its tokens in the global order and their class."""
    usual = np.median(counts)
    over = np.maximum(counts - usual, 0)
    frequent = max(FREQUENT, DEVIATIONS * float(np.sqrt(usual)))
    kind = 1 + (over >= frequent).astype(np.uint8) + (over >= VERY * frequent).astype(np.uint8)
    place = np.where(kind == 1, 0, np.floor(4 * np.log2(np.maximum(over, 1)))).astype(np.uint8)
    return place, kind


def parts_of(tier: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """How many parts a class is dealt into, for pairs whose larger set has 2^tier tokens
    or up to twice that. All classes together lose a quarter of the tokens at most, so
    that a prefix that stands all misses always exists."""
    of_pairs, of_triples = np.maximum(1 << tier >> 3, 1), np.maximum(1 << tier >> 4, 1)
    return np.where(kind == 3, of_triples, of_pairs)


def index_entries(tokens: np.ndarray, sizes: np.ndarray, place: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index entries of sets, and whose they are."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    slot = slots_of(tokens)
    order = np.lexsort((tokens, place[slot], owner))
    tokens, kinds = tokens[order], kind[slot][order]
    size = sizes[owner]
    need = size // WHOLE * (WHOLE - HIGH) + size % WHOLE * (WHOLE - HIGH) // WHOLE + 1
    start = np.cumsum(sizes) - sizes
    low = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
    high = np.frexp(np.maximum(size * WHOLE // HIGH, 1).astype(float))[1] - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    alone = np.zeros(len(tokens), dtype=bool)
    for tier, here in ((low, np.ones(len(tokens), dtype=bool)), (high, high > low)):
        # Sets of fewer than eight tokens have one class only.
        classes = np.where(tier < 3, 1, kinds)
        many = np.flatnonzero(here & (classes > 1))
        part = (tokens[many] >> np.uint64(7)).astype(np.int64) % parts_of(tier[many], classes[many])
        by = np.lexsort((many, part, classes[many], owner[many]))
        many, part = many[by], part[by]
        group = np.ones(len(many), dtype=bool)
        if len(many):
            group[1:] = (
                (owner[many][1:] != owner[many][:-1])
                | (classes[many][1:] != classes[many][:-1])
                | (part[1:] != part[:-1])
            )
        number = np.cumsum(group) - 1
        nth = np.arange(len(many)) - np.flatnonzero(group)[number] if len(many) else number
        stands = np.ones(len(tokens), dtype=np.int64)
        stands[many] = nth >= classes[many] - 1
        before = np.cumsum(stands) - stands
        prefix = here & (before - before[np.repeat(start, sizes)] < need)
        alone |= prefix & (classes == 1)
        held = prefix[many]
        many, number = many[held], number[held]
        for k in (2, 3):
            out.extend(joint(k, many[classes[many] == k], number[classes[many] == k], tokens, owner, tier))
    out.append((tokens[alone], owner[alone]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def joint(
    k: int, at: np.ndarray, group: np.ndarray, tokens: np.ndarray, owner: np.ndarray, tier: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The entries of all combinations of ``k`` tokens of one group; ``at`` lies group by group."""
    most = int(np.bincount(group).max()) if len(group) else 0
    for steps in combinations(range(1, most), k - 1):
        first = np.arange(len(at) - steps[-1])
        first = first[group[first] == group[first + steps[-1]]]
        if len(first):
            value = spread(tokens[at[first]] + tier[at[first]].astype(np.uint64))
            for step in steps:
                value = spread(value * _MIX + tokens[at[first + step]])
            yield value, owner[at[first]]


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token or two, by the token's lowest bits: set by an odd number of tokens."""
    bits = 1 << max(len(tokens) - 1, 63).bit_length()
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(one: np.ndarray, other: np.ndarray) -> int:
    """The least number of tokens that only one of two sets has, by their bitmaps."""
    while len(one) != len(other):
        long, short = (one, other) if len(one) > len(other) else (other, one)
        one, other = long[: len(long) // 2] ^ long[len(long) // 2 :], short
    return int(np.bitwise_count(one ^ other).sum())


def ruled_out(one: np.ndarray, other: np.ndarray, size_one: int, size_other: int) -> bool:
    """Whether two sets can't be similar enough: both together must have ``WHOLE - HIGH``
    of ``WHOLE + HIGH`` tokens apart at most."""
    return (WHOLE + HIGH) * apart(one, other) > (WHOLE - HIGH) * (size_one + size_other)


def indexed(docs: DataFrame, place: np.ndarray, kind: np.ndarray) -> DataFrame:
    """``(doc_id, key, size, bits, entries)`` of the rows, but for copies that the task has seen."""
    schema = StructType([
        docs.schema["doc_id"], StructField("key", BinaryType()), StructField("size", LongType()),
        StructField("bits", BinaryType()), StructField("entries", ArrayType(LongType())),
    ])
    held = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast((place, kind))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, kind = shared.value
        seen: set[tuple] = set()
        for rows, tokens, sizes in read_sets(batches):
            ends = np.cumsum(sizes)
            ids, chosen, keys, bits = rows.column("doc_id").to_pylist(), [], [], []
            for k, (s, e) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
                key = set_key(tokens[e - s : e]) if s else None
                # Of copies the row of the least id is the one that is wanted later on.
                if key is not None and (ids[k], key) not in seen:
                    seen.add((ids[k], key))
                    chosen.append(k)
                    keys.append(key)
                    bits.append(bitmap(tokens[e - s : e]))
            if len(seen) > REMEMBERED:
                seen.clear()
            if not chosen:
                continue
            some = np.zeros(len(sizes), dtype=bool)
            some[chosen] = True
            value, owner = index_entries(tokens[np.repeat(some, sizes)], sizes[some], place, kind)
            by = np.argsort(owner, kind="stable")
            offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(chosen)))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[by].view(np.int64)))
            columns = [rows.column("doc_id").take(pa.array(chosen)), pa.array(keys, pa.binary())]
            columns += [pa.array(sizes[some].astype(np.int64)), pa.array(bits, pa.binary()), lists.cast(held.field(4).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=held)

    return docs.mapInArrow(entries, schema)


def wanted_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, size, tokens)`` of ``nodes`` (``node``, ``first``, ``key``), read again from their texts.

    A bitmap of the wanted ids keeps most other texts from being read and shuffled.
    """
    def slot(doc_id: str) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(doc_id), 64 - WANTED_BITS) + 1).alias("slot")

    blocks = nodes.select(slot("first")).groupBy(F.bitmap_bucket_number("slot").alias("block"))
    found = blocks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = np.zeros(2**WANTED_BITS // 8, dtype=np.uint8)
    for block, held in found.collect():  # 2^WANTED_BITS bits at most
        bits[(block - 1) * 4096 : block * 4096] = np.frombuffer(held, dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = StructType([
        docs.schema["doc_id"], StructField("key", BinaryType()), StructField("tokens", ArrayType(LongType()))
    ])
    out = to_arrow_schema(schema)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("slot").to_numpy(zero_copy_only=False) - 1
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            if hit.any():
                yield batch.filter(pa.array(hit))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tokens, sizes in read_sets(chosen(batches)):
            ends = np.cumsum(sizes)
            keys = [set_key(tokens[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, ends].astype(np.int32)), pa.array(tokens.view(np.int64))
            )
            columns = [rows.column("doc_id"), pa.array(keys, pa.binary()), lists.cast(out.field(2).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    rows = docs.select("doc_id", "text", slot("doc_id")).mapInArrow(tokens_of, schema)
    met = rows.join(nodes.select("node", "first", "key"), "key").filter(F.col("doc_id").eqNullSafe(F.col("first")))
    met = met.select("node", F.size("tokens").alias("size"), "tokens").dropDuplicates(["node"])
    return stage(met, "tokens")


def likely(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) that sizes and bitmaps do not rule out."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = batch.column("_na").to_numpy(), batch.column("_nb").to_numpy()
            one, other = batch.column("_one").to_pylist(), batch.column("_two").to_pylist()
            keep = [
                not ruled_out(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), n, m)
                for x, y, n, m in zip(one, other, size_a.tolist(), size_b.tolist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = index.select("node", "size", "bits")
    sizes = index.select("node", "size")
    pairs = pairs.join(sizes.toDF("a", "_na"), "a").join(sizes.toDF("b", "_nb"), "b")
    pairs = pairs.filter(HIGH * F.greatest("_na", "_nb") <= WHOLE * F.least("_na", "_nb")).select("a", "b")
    met = pairs.join(held.toDF("a", "_na", "_one"), "a").join(held.toDF("b", "_nb", "_two"), "b")
    return stage(met.mapInArrow(kept, "a long, b long").distinct(), "likely")


def linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar enough, compared by their tokens."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    tokens = wanted_sets(docs, stage(nodes.join(ends, "node"), "wanted"))
    met = pairs.join(tokens.toDF("a", "_na", "_one"), "a").join(tokens.toDF("b", "_nb", "_two"), "b")
    common = F.size(F.array_intersect("_one", "_two"))
    similar = WHOLE * common >= HIGH * (F.col("_na") + F.col("_nb") - common)
    return stage(met.filter(similar).select("a", "b"), "links")


def classed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` of the entries that hold several classes, with ``class``."""
    if labels is None:
        rows = rows.withColumn("class", F.col("node"))
    else:
        known = labels.select("node", F.col("component").alias("class"))
        rows = rows.join(known, "node", "left").withColumn("class", F.coalesce("class", "node"))
    rows = stage(rows.select("entry", "node", "class"), "classed")
    mixed = rows.groupBy("entry").agg(F.min("class").alias("_low"), F.max("class").alias("_high"))
    return stage(rows.join(mixed.filter("_low <> _high").select("entry"), "entry"), "open")


def centres(rows: DataFrame, first: bool) -> DataFrame:
    """``(entry, a, _class)``: the set each entry's others are compared with."""
    if first:
        chosen = F.min(F.struct("node", "class"))
    else:
        sizes = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("_n"))
        weights = rows.join(sizes, "entry").groupBy("node").agg(F.sum("_n").alias("_weight"))
        rows = rows.join(weights, "node")
        chosen = F.max_by(F.struct("node", "class"), F.struct("_weight", "node"))
    found = rows.groupBy("entry").agg(chosen.alias("_c"))
    return stage(found.select("entry", F.col("_c.node").alias("a"), F.col("_c.class").alias("_class")), "centres")


def links_of(members: DataFrame, index: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """``(node, component)`` of all sets that link another one, or None.

    ``members`` has ``(entry, node)`` of the entries with several sets.
    """
    links = labels = None
    rows = members

    def add(pairs: DataFrame) -> None:
        nonlocal links, labels
        found = linked(pairs, docs, nodes)
        links = found if links is None else links.unionAll(found)
        labels = components(links)

    for first in (True, False):
        rows = classed(rows, labels)
        if rows.isEmpty():
            return labels
        middle = centres(rows, first)
        met = rows.join(middle, "entry").filter("node <> a")
        pairs = met.filter("class <> _class").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        add(likely(pairs.distinct(), index))
        # What a centre was compared with needs no other comparison with it.
        rows = met.select("entry", "node")
    rows = classed(rows, labels)
    if not rows.isEmpty():
        add(open_pairs(rows, index))
    return labels


def open_pairs(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``(a, b)``: the likely pairs of different classes in each entry of ``rows``."""
    sizes = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("_n"))
    rows = stage(rows.join(sizes, "entry"), "sized")
    few = rows.filter(F.col("_n") <= FEW).select("entry", "node", "class")
    pairs = few.join(few.toDF("entry", "b", "_class"), "entry").filter("node < b and class <> _class")
    pairs = likely(pairs.select(F.col("node").alias("a"), "b").distinct(), index)
    large = rows.filter(F.col("_n") > FEW).drop("_n")
    return pairs.unionAll(pairs_in_blocks(large, index)).distinct()


def pairs_in_blocks(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The likely pairs of entries with very many sets.

    An entry's sets are dealt into blocks, and every two blocks meet in one task.
    """
    entries = rows.groupBy("node").agg(F.array_sort(F.collect_set("entry")).alias("entries"))
    held = stage(index.select("node", "size", "bits").join(entries, "node"), "held")
    counts = rows.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    dealt = rows.join(counts, "entry").withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.struct(F.least(other, F.col("_block")).alias("i"), F.greatest(other, F.col("_block")).alias("j")),
    )
    sides = dealt.select("entry", "node", "class", "_block", F.explode(others).alias("_pair")).select(
        "entry", "node", "class", "_block", "_pair.i", "_pair.j"
    )

    def compared(table: pa.Table) -> pa.Table:
        entry, i, j = (table[c][0].as_py() for c in ("entry", "i", "j"))
        node, block, group = (table[c].to_numpy() for c in ("node", "_block", "class"))
        bits = [np.frombuffer(b, dtype=np.uint8) for b in table["bits"].to_pylist()]
        known = [set(e) for e in table["entries"].to_pylist()]
        size = table["size"].to_numpy()
        found = []
        for x in np.flatnonzero(block == i):
            rest = np.flatnonzero(block == j) if i != j else np.arange(x + 1, len(node))
            near = HIGH * np.maximum(size[rest], size[x]) <= WHOLE * np.minimum(size[rest], size[x])
            for y in rest[near & (group[rest] != group[x])]:
                # A pair is looked at in the first of the entries it shares.
                if min(known[x] & known[y]) == entry and not ruled_out(bits[x], bits[y], size[x], size[y]):
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = sides.join(held, "node").groupBy("entry", "i", "j")
    return stage(met.applyInArrow(compared, "a long, b long"), "open-pairs")


def joined_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs``.

    Words are lower-cased (A-Z) and cut at ASCII blanks. Two rows link if five times the
    shingles they share are four times those of either or more; ``component_id`` is the
    least id that links lead to. Equal sets link without being compared. Null and empty
    texts, and texts of blanks, have no shingles and are alone; a text of fewer than five
    words is one shingle. Null ids name no component unless all of its ids are null; rows
    that repeat are linked as copies. Texts are read whole. Other columns are not looked
    at; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed_sets(docs)
    place, kind = ranks(slot_counts(keyed))
    rows = keyed.filter("block is null").select("doc_id", "n_shingles", "key")
    some = rows.filter("key is not null")
    nodes = some.groupBy("key").agg(F.min("doc_id").alias("first"))
    nodes = stage(numbered(nodes, [F.col("key")], "node"), "nodes")
    own = indexed(docs, place, kind).join(nodes.select("key", "first", "node"), "key")
    own = own.filter(F.col("doc_id").eqNullSafe(F.col("first"))).drop("doc_id", "key", "first")
    index = stage(own, "index")  # rows that repeat id and text may stand there twice, to no effect
    entries = index.select("node", F.explode("entries").alias("entry"))
    several = entries.groupBy("entry").agg(F.min("node").alias("_low"), F.max("node").alias("_high"))
    members = entries.join(several.filter("_low <> _high").select("entry"), "entry")
    labels = links_of(stage(members.select("entry", "node").distinct(), "members"), index, docs, nodes)
    if labels is None:
        nodes = nodes.withColumn("component", F.col("node"))
    else:
        nodes = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = stage(nodes.select("key", "first", "component"), "labelled")
    names = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = nodes.join(names, "component").select("key", "component_id")
    found = some.join(named, "key").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionAll(alone)
