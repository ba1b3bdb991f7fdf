"""The Jaccard join over shingles, against comparing all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from factloom.llm import ngram_join as J

COLUMNS = "doc_id long, text string, key string, node long, entry string, n long"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*[words[k:] for k in range(5)]))


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    out = []
    for k, r in enumerate(rows):
        ids = [rows[i][0] for i in range(len(rows)) if group[i] == group[k] and rows[i][0] is not None]
        out.append((r[0], len(sets[k]), min(ids, default=None)))
    return sorted(out, key=str)


def some_rows():
    drawn = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)] + ["Straße", "É", "\x00", "x\x1fy"]

    def text(n):
        return drawn.choices(vocabulary, k=n)

    passage = text(30)
    bases = [text(n) for n in (3, 5, 9, 12, 30, 60, 60, 200)] + [passage + text(6) for _ in range(3)]
    rows = []
    for k in range(330):
        words = list(drawn.choice(bases)) if k % 5 else [*text(3), *passage, *text(3 + k % 4)]
        for _ in range(drawn.choice([0, 1, 1, 2, 3])):
            words[drawn.randrange(len(words))] = drawn.choice(vocabulary)
        words = words + text(drawn.choice([0, 0, 1, 4]))
        words = [w.upper() if drawn.random() < 0.1 and w.startswith("w") else w for w in words]
        rows.append((k + 10, drawn.choice([" ", "\n", "\t ", "\x0b"]).join(words), "key", 1, "e", 2))
    rows += [(5, None, None, None, None, None), (6, "", "", 0, "", 0), (7, " \n\t", "", 0, "", 0), (8, None, "", 0, "", 0)]
    rows += [(rows[3][0], rows[9][1], "", 0, "", 0), rows[3], rows[3], (None, rows[5][1], "", 0, "", 0)]
    rows += [(None, "one of a kind and all alone in here", "", 0, "", 0), (2, "a b c d", "", 0, "", 0), (1, "A b  c d ", "", 0, "", 0)]
    long = " ".join(text(30_000))
    return [*rows, (900, long, "", 0, "", 0), (901, long + " and more", "", 0, "", 0)]


def test_similar_sets_share_an_entry():
    rng = np.random.default_rng(7)
    for round in range(60):
        universe = rng.integers(0, 2**63, 400 if round % 2 else 60).astype(np.uint64)
        place = rng.integers(0, 30, J.SLOTS).astype(np.uint8)
        kind = rng.choice([1, 2, 3], J.SLOTS, p=[[0.2, 0.4, 0.4], [0, 0, 1], [0, 1, 0], [0.8, 0.1, 0.1]][round % 4]).astype(np.uint8)
        sets = []
        for _ in range(12):
            base = rng.choice(universe, rng.integers(1, len(universe) // 2), replace=False)
            for _ in range(4):
                kept = base[rng.random(len(base)) > rng.choice([0.02, 0.08])]
                held = np.union1d(kept, rng.choice(universe, rng.integers(0, max(len(base) // 9, 2))))
                if len(held):
                    sets.append(held)
        sizes = np.array([len(s) for s in sets])
        value, owner = J.index_entries(np.concatenate(sets), sizes, place, kind)
        entries = [set(value[owner == k].tolist()) for k in range(len(sets))]
        for a, b in combinations(range(len(sets)), 2):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 80 * (sizes[a] + sizes[b] - common):
                assert entries[a] & entries[b]


def test_frequent_tokens_are_indexed_in_combinations():
    tokens = np.arange(1, 101, dtype=np.uint64) << np.uint64(40)
    place = np.zeros(J.SLOTS, dtype=np.uint8)
    alone, _ = J.index_entries(tokens, np.array([100]), place, np.full(J.SLOTS, 1, dtype=np.uint8))
    assert sorted(alone.tolist()) == tokens[:21].tolist()
    paired, _ = J.index_entries(tokens, np.array([100]), place, np.full(J.SLOTS, 2, dtype=np.uint8))
    assert not set(paired.tolist()) & set(tokens.tolist())


@pytest.mark.parametrize("frequent, very, few, block", [(64, 64, 8, 256), (2, 4, 2, 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, frequent, very, few, block):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "DEVIATIONS", 0)
    monkeypatch.setattr(J, "VERY", very)
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "BLOCK", block)
    rows = some_rows()
    docs = spark.createDataFrame(rows, COLUMNS)
    got = sorted((tuple(r) for r in J.joined_documents(docs).collect()), key=str)
    assert got == brute(rows)


def test_no_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in J.joined_documents(docs).collect()) == [(1, 0, 1), (2, 0, 2)]
    assert J.joined_documents(docs.limit(0)).collect() == []


def test_bitmaps_rule_out_no_similar_sets():
    rng = np.random.default_rng(11)
    ruled = 0
    for _ in range(400):
        base = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        one = np.unique(base[rng.random(len(base)) > rng.choice([0, 0.05, 0.3])])
        other = np.union1d(base[rng.random(len(base)) > 0.08], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64))
        bits = [np.frombuffer(J.bitmap(t), np.uint8) for t in (one, other)]
        common = len(np.intersect1d(one, other))
        assert J.apart(*bits) <= len(one) + len(other) - 2 * common
        similar = 100 * common >= 80 * (len(one) + len(other) - common)
        out = J.ruled_out(*bits, len(one), len(other))
        assert not (similar and out)
        ruled += out
    assert ruled > 50


def test_blocks_of_an_entry_give_all_pairs(spark):
    drawn = random.Random(9)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(40):
        words = list(base)
        for at in drawn.sample(range(60), 2):
            words[at] = f"u{k}-{at}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = J.indexed(docs, np.zeros(J.SLOTS, dtype=np.uint8), np.ones(J.SLOTS, dtype=np.uint8))
    index = J.stage(index.withColumnRenamed("doc_id", "node").drop("key", "entries"), "index")
    entries = spark.createDataFrame([(e, k, k) for e in (1, 2) for k in range(40)], "entry long, node long, class long")
    got = [tuple(r) for r in J.pairs_in_blocks(entries, index).collect()]
    assert len(got) == len(set(got))
    sets = [shingles(r[1]) for r in rows]
    similar = {(a, b) for a, b in combinations(range(40), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert similar and similar <= set(got)
