"""Phrases whose words belong together, by best-first growth with bounds.

Of each language, the phrases of two to four words with the best association score: the
least, over the cuts of the phrase in two, of twice its count over the counts of both
parts. The count of a prefix bounds the score of all that can grow from it: no phrase
with the prefix ``p`` of first word ``w`` scores above ``2 f(p) / (f(w) + f(p))``.

Growth is best first. All pairs are counted and scored; a level is set where the best of
them end, and only prefixes whose bound reaches the level are grown, together with the
neighbours of candidates above it, which decide whether a longer phrase takes their
place. A language is settled once enough candidates above its level survive: all that
could reach the level were grown, ties included. Otherwise its level is lowered and the
frontier is expanded further, down to nothing left.

Words are 64-bit hashes of language and word in the counts; the table of words is exact,
and another seed is taken if two words of the corpus share a hash. What a pass over the
texts has to know is a bitmap of fixed size of the prefixes to grow. A bit that is set
by chance makes it count a phrase too many, never too few or wrongly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import joined
from factloom.llm.order_minhash import grouped
from factloom.llm.shingles import spread
from factloom.staging import stage

LEAST, TOP, LONGEST = 30, 2000, 4
# Candidates of a language above its first level, and how much deeper each next one goes.
BEST, DEEPER = 2 * TOP, 8
# A bitmap of prefixes has so many bits, 4 MB, whatever the size of the corpus.
BITS = 25
# Characters of texts, and different phrases, that a task holds at once.
AT_ONCE, HELD = 1_000_000, 400_000

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_BETWEEN, _END = 1, 2


def _classes() -> np.ndarray:
    """Of each byte: part of a word (0), between words, or the end of a piece."""
    of = np.zeros(256, dtype=np.uint8)
    of[[0x20, 0x09]] = _BETWEEN
    of[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END
    return of


CLASSES = _classes()


def _powers(odd: int, n: int) -> np.ndarray:
    held = np.full(n, odd, dtype=np.uint64)
    held[0] = 1
    return np.cumprod(held)


class Words:
    """The words of many texts: hashes, pieces, texts, and where they are in the bytes."""

    def __init__(self, seed: int):
        folded = np.arange(256, dtype=np.uint64)
        folded[65:91] += np.uint64(32)
        self.number = spread(folded + np.uint64(1 + 256 * seed)) | np.uint64(1)
        self.power = self.back = np.ones(1, dtype=np.uint64)

    def read(self, texts: list[str], langs: np.ndarray) -> None:
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = b"\n" + b"\n".join(encoded) + b"\n"
        data = np.frombuffer(self.bytes, dtype=np.uint8)
        if len(self.power) < len(data):
            self.power = _powers(_ODD, len(data))
            self.back = _powers(pow(_ODD, -1, 2**64), len(data))
        kind = CLASSES[data]
        inside = kind == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        # A word's hash is the difference of two running sums, moved to the same place.
        running = np.cumsum(self.number[data] * self.power[: len(data)])
        value = (running[self.ends - 1] - running[self.starts - 1]) * self.back[self.starts]
        value = spread(value + (self.ends - self.starts).astype(np.uint64))
        ends = np.cumsum([len(e) + 1 for e in encoded])
        self.text = np.searchsorted(ends, self.starts)
        self.piece = np.searchsorted(np.flatnonzero(kind == _END), self.starts)
        self.hash = spread(value ^ langs[self.text])

    def word(self, k: int) -> str:
        held = self.bytes[self.starts[k] : self.ends[k]].decode("utf-8", "replace")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in held)

    def grams(self, size: int) -> list[np.ndarray]:
        """The places of the phrases of ``size`` words, as one array of hashes for each."""
        n = max(len(self.hash) - size + 1, 0)
        whole = np.flatnonzero(self.piece[:n] == self.piece[size - 1 : size - 1 + n])
        return [self.hash[whole + k] for k in range(size)]


def combined(words: list[np.ndarray]) -> np.ndarray:
    return reduce(lambda value, word: spread(value * _MIX + word), words)


def lang_numbers(langs: list[str]) -> np.ndarray:
    known = {lang: int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "big") for lang in set(langs)}
    return np.array([known[lang] for lang in langs], dtype=np.uint64)


def read_words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Words, list[str]]]:
    """The words of the texts of all batches, some texts at a time, and the texts' languages."""
    words = Words(seed)
    for batch in batches:
        langs, at = batch.column("lang").to_pylist(), 0
        for texts in grouped(batch.column("text").to_pylist(), AT_ONCE):
            here = langs[at : at + len(texts)]
            at += len(texts)
            words.read(texts, lang_numbers(here))
            if len(words.hash):
                yield words, here


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """``(lang, word, w, n)``: every word of every language with its hash and count."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for words, langs in read_words(batches, seed):
            value, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            held.append(
                pa.table(
                    {
                        "lang": pa.array([langs[k] for k in words.text[first]]),
                        "word": pa.array([words.word(k) for k in first]),
                        "w": pa.array(value.view(np.int64)),
                        "n": pa.array(n),
                    }
                )
            )
            if sum(len(h) for h in held) > 2 * HELD:
                held = [words_tallied(held)]
                if len(held[0]) > HELD:
                    yield from held.pop().to_batches(200_000)
        if held:
            yield from words_tallied(held).to_batches(200_000)

    rows = docs.mapInArrow(counted, "lang string, word string, w long, n long")
    return stage(rows.groupBy("lang", "word", "w").agg(F.sum("n").alias("n")), "words")


def words_tallied(parts: list[pa.Table]) -> pa.Table:
    held = pa.concat_tables(parts).group_by(["lang", "word", "w"]).aggregate([("n", "sum")])
    return held.rename_columns({"n_sum": "n"}).select(["lang", "word", "w", "n"])


def tallied(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different phrases with their counts added up."""
    words = [np.concatenate(column) for column in zip(*[p[0] for p in parts], strict=True)]
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(combined(words))
    words = [w[order] for w in words]
    # Neighbours of one hash but of different words stay apart.
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = reduce(np.logical_or, [w[1:] != w[:-1] for w in words])
    first = np.flatnonzero(fresh)
    return [w[first] for w in words], np.add.reduceat(counts[order], first) if len(first) else counts


def hits(bits: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    slot = combined(words) >> np.uint64(64 - BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


Part = tuple[int, int, np.ndarray]


def count_grams(docs: DataFrame, seed: int, size: int, parts: list[Part], every: bool, least: int) -> DataFrame:
    """``(w1, …, a)``: the phrases of ``size`` words that occur ``least`` times or more,
    if one of their ``parts`` (first word, number of words, bitmap) is in its bitmap, or
    ``every`` part is."""
    columns = [f"w{k + 1}" for k in range(size)]
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def rows(words: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = 200_000
        for at in range(0, len(counts), step):
            held = [pa.array(w[at : at + step].view(np.int64)) for w in words]
            yield pa.record_batch([*held, pa.array(counts[at : at + step])], [*columns, "a"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        for words, _ in read_words(batches, seed):
            grams = words.grams(size)
            found = [hits(bits, grams[at : at + n]) for at, n, bits in shared.value]
            keep = reduce(np.logical_and if every else np.logical_or, found)
            grams = [g[keep] for g in grams]
            held.append(tallied([(grams, np.ones(len(grams[0]), dtype=np.int64))]))
            if sum(len(h[1]) for h in held) > 2 * HELD:
                held = [tallied(held)]
                if len(held[0][1]) > HELD:
                    yield from rows(*held.pop())
        if held:
            yield from rows(*tallied(held))

    counts = docs.mapInArrow(counted, ", ".join(f"{c} long" for c in [*columns, "a"]))
    counts = counts.groupBy(*columns).agg(F.sum("a").alias("a"))
    return stage(counts.filter(F.col("a") >= least), f"phrases-of-{size}")


def bitmap(grams: DataFrame, columns: list[str]) -> np.ndarray:
    """The bits of the phrases in ``columns``, put together by an aggregate over blocks."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in columns]
            slot = combined(words) >> np.uint64(64 - BITS)
            yield pa.record_batch([pa.array(slot.view(np.int64) + 1)], ["slot"])

    found = grams.select(*columns).mapInArrow(slots, "slot long")
    blocks = found.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bits = np.zeros(2**BITS // 8, dtype=np.uint8)
    for block, held in blocks.collect():  # 2^BITS bits at most
        at = (block - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(held, dtype=np.uint8)
    return bits


def score(a: Column, left: Column, right: Column) -> Column:
    """Twice the count over the sum of the parts' counts, in millionths, without rounding up."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", wide[0] * F.lit(2_000_000).cast("decimal(8,0)"), wide[1] + wide[2])


def bound(a: Column, first: Column) -> Column:
    """What no phrase that goes on from one of ``a`` occurrences can exceed."""
    return score(a, first, a)


def cut(cuts: list[tuple[Column, Column]]) -> Column:
    """The lowest-scoring cut as ``(score, k, l, r)``; of equal ones the first."""
    return F.array_min(F.array(*[
        F.struct(score(F.col("a"), left, right).alias("score"), F.lit(k + 1).alias("k"), left.alias("l"), right.alias("r"))
        for k, (left, right) in enumerate(cuts)
    ]))


def renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def score_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``(lang, w1, w2, a, f1, f2, score, l, r, bound)``."""
    pairs = pairs.join(renamed(words, lang="lang", w1="w", f1="n"), "w1")
    pairs = pairs.join(renamed(words, w2="w", f2="n"), "w2")
    best = cut([(F.col("f1"), F.col("f2"))])
    return stage(pairs.withColumn("_cut", best).select(
        "lang", "w1", "w2", "a", "f1", "f2", "_cut.score", "_cut.l", "_cut.r", bound(F.col("a"), F.col("f1")).alias("bound")
    ), "pairs")


def score_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(lang, w1, w2, w3, a, f1, f3, score, l, r, bound)``."""
    start = renamed(pairs, lang="lang", w1="w1", w2="w2", f1="f1", f12="a")
    end = renamed(pairs, w2="w1", w3="w2", f23="a", f3="f2")
    rows = triples.join(start, ["w1", "w2"]).join(end, ["w2", "w3"])
    best = cut([(F.col("f1"), F.col("f23")), (F.col("f12"), F.col("f3"))])
    return stage(rows.withColumn("_cut", best).select(
        "lang", "w1", "w2", "w3", "a", "f1", "f3", "_cut.score", "_cut.l", "_cut.r",
        bound(F.col("a"), F.col("f1")).alias("bound"),
    ), "triples")


def join_fours(fours: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """The fours with the counts of their parts; a triple that was not counted is null."""
    start = renamed(pairs, lang="lang", w1="w1", w2="w2", f1="f1", f12="a")
    end = renamed(pairs, w3="w1", w4="w2", f34="a", f4="f2")
    rows = fours.join(start, ["w1", "w2"]).join(end, ["w3", "w4"])
    rows = rows.join(renamed(triples, w1="w1", w2="w2", w3="w3", f123="a"), ["w1", "w2", "w3"], "left")
    return rows.join(renamed(triples, w2="w1", w3="w2", w4="w3", f234="a"), ["w2", "w3", "w4"], "left")


def score_fours(rows: DataFrame) -> DataFrame:
    best = cut([(F.col("f1"), F.col("f234")), (F.col("f12"), F.col("f34")), (F.col("f123"), F.col("f4"))])
    # Without the triple it starts with, it is below the level: its start's bound was.
    rows = rows.filter("f123 is not null and f234 is not null").withColumn("_cut", best)
    return rows.select("lang", "w1", "w2", "w3", "w4", "a", "_cut.score", "_cut.l", "_cut.r")


def undisplaced(rows: DataFrame, longer: DataFrame, size: int) -> DataFrame:
    """``rows`` (phrases of ``size`` words) that no phrase of one word more takes the place of.

    A phrase of two words more that would do so holds one of one word more that does.
    """
    own = [f"w{k + 1}" for k in range(size)]
    after = longer.select(*own, F.col("a").alias("_more"))
    before = longer.select(*[F.col(f"w{k + 2}").alias(f"w{k + 1}") for k in range(size)], F.col("a").alias("_more"))
    most = stage(after.unionAll(before).groupBy(*own).agg(F.max("_more").alias("_more")), "longer")
    return rows.join(most, own, "left").filter("_more is null or 5 * _more < 4 * a").drop("_more")


def levels_of(rows: DataFrame, depth: int) -> DataFrame:
    """``(lang, level)``: the score of the language's ``depth``-th row, 0 if it has fewer."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc())
    ranked = rows.select("lang", "score", F.row_number().over(order).alias("_rank")).filter(F.col("_rank") <= depth)
    found = ranked.groupBy("lang").agg(F.min("score").alias("_least"), F.count(F.lit(1)).alias("_n"))
    level = F.when(F.col("_n") < depth, F.lit(0).cast("long")).otherwise(F.col("_least"))
    return stage(found.select("lang", level.alias("level")), "levels")


def above(rows: DataFrame, levels: DataFrame, what: str) -> DataFrame:
    return joined(rows, levels, ["lang"]).filter(F.col(what) >= F.col("level")).drop("level")


def grow(docs: DataFrame, seed: int, pairs: DataFrame, levels: DataFrame, least: int) -> DataFrame:
    """All phrases whose score reaches their language's level and which none displaces."""

    def count(size: int, start: DataFrame, neighbours: DataFrame) -> DataFrame:
        own = [f"w{k + 1}" for k in range(size - 1)]
        parts = [(0, size - 1, bitmap(start, own)), (1, size - 1, bitmap(neighbours, own))]
        return count_grams(docs, seed, size, parts, False, least)

    best_pairs = stage(above(pairs, levels, "score"), "best-pairs")
    triples = score_triples(count(3, above(pairs, levels, "bound"), best_pairs), pairs)
    best_triples = stage(above(triples, levels, "score"), "best-triples")
    fours = stage(join_fours(count(4, above(triples, levels, "bound"), best_triples), pairs, triples), "fours")
    # A triple at the end of a four may not have been grown; where it matters it is counted.
    known = F.least(
        bound(F.col("a"), F.col("f1")), score(F.col("a"), F.col("f12"), F.col("f34")),
        score(F.col("a"), F.col("f123"), F.col("f4")),
    )
    open_ends = above(fours.filter("f123 is not null and f234 is null").withColumn("_most", known), levels, "_most")
    open_ends = stage(renamed(open_ends, w1="w2", w2="w3", w3="w4").distinct(), "open-ends")
    if not open_ends.isEmpty():
        ends = count_grams(docs, seed, 3, [(0, 3, bitmap(open_ends, ["w1", "w2", "w3"]))], True, least)
        ends = renamed(ends, w2="w1", w3="w2", w4="w3", _end="a")
        fours = fours.join(ends, ["w2", "w3", "w4"], "left").withColumn("f234", F.coalesce("f234", "_end"))
        fours = stage(fours.drop("_end"), "fours")
    found = [
        undisplaced(best_pairs, triples, 2).withColumn("words", F.array("w1", "w2")),
        undisplaced(best_triples, fours, 3).withColumn("words", F.array("w1", "w2", "w3")),
        above(score_fours(fours), levels, "score").withColumn("words", F.array("w1", "w2", "w3", "w4")),
    ]
    columns = ["lang", "words", "a", "l", "r", "score"]
    return stage(reduce(DataFrame.unionAll, [f.select(*columns) for f in found]), "survivors")


def in_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with ``phrase``: the words of ``words``, joined by blanks."""
    for k in range(LONGEST):
        of = renamed(words, _w="w", **{f"_word{k}": "word"})
        rows = rows.withColumn("_w", F.get("words", F.lit(k))).join(of, "_w", "left").drop("_w")
    spelled = F.concat_ws(" ", *[F.col(f"_word{k}") for k in range(LONGEST)])
    return rows.withColumn("phrase", spelled).drop("words", *[f"_word{k}" for k in range(LONGEST)])


def exact_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """The table of words under the first seed that gives each its own hash."""
    for seed in range(64):
        words = count_words(docs, seed)
        if words.groupBy("w").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
            return words, seed
    raise RuntimeError("no seed tells all words apart")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, best: int = BEST, deeper: int = DEEPER
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    Phrases are of two to four words that occur ``least`` times or more; ``a`` is their
    count, ``l`` and ``r`` those of the parts of their lowest-scoring cut, ``n`` the
    language's words. Order is by score, count (both falling) and phrase (bytes rising),
    so ties have one order. Null texts have no words; a null language is ``und``, together
    with the language of that name; repeated rows count as often as they stand there. A
    text is read whole, and a task holds one text at least. Other columns are not looked
    at; an empty table gives an empty result. ``best`` and ``deeper`` set how far growth
    goes in the first round and how much further in the next ones, not the result.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, seed = exact_words(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = stage(words.filter(F.col("n") >= least), "frequent")
    known = bitmap(renamed(frequent, w1="w"), ["w1"])
    pairs = score_pairs(count_grams(docs, seed, 2, [(0, 1, known), (1, 1, known)], True, least), frequent)

    settled: list[DataFrame] = []
    open_pairs, here, depth = pairs, docs, best
    while True:
        levels = levels_of(open_pairs, depth)
        survivors = grow(here, seed, open_pairs, levels, least)
        counts = survivors.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
        state = levels.join(counts, "lang", "left").select(
            "lang", (F.col("level").eqNullSafe(0) | (F.coalesce("_n", F.lit(0)) >= top)).alias("done")
        )
        state = stage(state, "state")
        settled.append(joined(survivors, state.filter("done").select("lang"), ["lang"]))
        left = state.filter("not done").select("lang")
        if left.isEmpty():
            break
        open_pairs, here, depth = joined(open_pairs, left, ["lang"]), joined(docs, left, ["lang"]), depth * deeper
    found = in_words(reduce(DataFrame.unionAll, settled), frequent)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return joined(ranked, stage(totals, "totals"), ["lang"]).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
