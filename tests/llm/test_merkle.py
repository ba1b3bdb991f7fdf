"""The manifest's trees and folds, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import sha_states
from factloom.llm.merkle import folded_roots, manifest, verified

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, tree int, n string, place int"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, source, lang, n_chars, text = row[:5]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest("-" if v is None else f"{len(v.encode())}:{v}" for v in values)


def grow(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest(nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def climb(levels, at, now):
    siblings = []
    for nodes in levels[:-1]:
        base = at - at % 8
        family = nodes[base : base + 8]
        siblings += family[: at - base] + family[at - base + 1 :]
        family[at - base] = now
        now, at = digest(family), at // 8
    return now, siblings


def expected(rows, tampered):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, placed = [], []
    for number, lang in enumerate(langs):
        here = sorted(
            (r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r)))
        )
        trees.append(grow([leaf(r) for r in here]))
        placed += [(number, at, r) for at, r in enumerate(here)]
    top = grow([t[-1][0] for t in trees])
    root = top[-1][0]
    out = []
    for number, at, r in placed:
        now, below = climb(trees[number], at, leaf(r, tampered(r)))
        now, above = climb(top, number, now)
        out.append((r[0], leaf(r), trees[number][-1][0], root, digest(below + above), now, now == root))
    return sorted(out, key=str)


def some_rows():
    drawn = random.Random(5)
    langs = [None, "", "de", "é", "z", *[f"l{k}" for k in range(8)]]
    rows = []
    for k in range(230):
        lang = "en" if k % 3 else drawn.choice(langs)
        text = drawn.choice([None, "", "Ab " * drawn.randint(1, 9), "É straße"])
        rows.append((k * 7, drawn.choice([None, "s", ""]), lang, drawn.choice([None, k]), text, 1, "n", 2))
    rows += [rows[4], rows[4], (None, None, None, None, None, 0, None, None), (rows[9][0], *rows[8][1:])]
    rows.append((5, "s", "en", 3, "Long " * 60_000, 1, "n", 2))
    return rows


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_folds_give_the_root_unless_tampered(spark, levels):
    rows = some_rows()
    docs = spark.createDataFrame(rows, COLUMNS)
    lower = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "ABCDEFGHIJKL", "abcdefghijkl"))
    found = verified(docs, {"text": F.coalesce(lower, F.col("text"))}, levels=levels)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == expected(rows, lambda r: r[0] is not None and r[0] % 2 == 0)
    assert {r[-1] for r in got} == {True, False}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "s", None, 3, "x", 1, "n", 2)], COLUMNS)
    got = verified(one, {}).collect()
    assert got[0].root == got[0].leaf == leaf((1, "s", None, 3, "x")) and got[0].verified
    assert got[0].proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert verified(one.limit(0), {}).collect() == []


def test_parents_keep_the_state_before_each_child(spark):
    docs = spark.createDataFrame([r for r in some_rows() if r[2] == "en"], COLUMNS)
    made = manifest(docs, levels=2)
    nodes = made.tiers[0].collect()
    at = {(n.block, n.level, n.node): n for n in nodes}
    for (block, level, node), parent in at.items():
        if not level:
            assert parent.states is None
            continue
        state = sha_states.start(1)
        for slot in range(len(parent.states) // 32):
            kept = np.frombuffer(parent.states[32 * slot : 32 * slot + 32], np.uint8)[None]
            assert (sha_states.from_bytes(kept) == state).all()
            child = at[block, level - 1, node * 8 + slot].digest
            state = sha_states.absorb(state, np.frombuffer(child, np.uint8)[None])
    # Another digest in the place of one leaf gives another root, its own digest the same.
    leaves = made.leaves.filter("place in (0, 70)").withColumn("folded", F.col("digest"))
    other = leaves.withColumn("folded", F.unhex(F.sha2("digest", 256)))
    assert {bytes(r.folded) for r in folded_roots(made, leaves.drop("n", "changed")).collect()} == {made.root()}
    changed = [bytes(r.folded) for r in folded_roots(made, other.drop("n", "changed")).collect()]
    assert len({*changed, made.root()}) == 3
