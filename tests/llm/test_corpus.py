"""Operators that compare documents, against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import exact_substrings, order_minhash
from factloom.llm.bwt_merge import repeats
from factloom.llm.mixing import mix
from factloom.llm.order_minhash import alignment, deduplicated, near_duplicates
from factloom.llm.positional_index import decontaminate, marked, matches
from factloom.llm.quotations import as_mail, link_quotations
from factloom.llm.shingles import labelled


def test_merged_transforms_find_all_repeats():
    drawn = random.Random(1)
    for _ in range(100):
        width = drawn.choice([1, 3, 8])
        texts = [bytes(drawn.choices(b"ab\x00", k=drawn.randint(0, 30))) for _ in range(8)]
        seen, expected = set(), []
        for t in texts:
            expected.append([])
            for k in range(max(len(t) - width + 1, 0)):
                expected[-1].append(t[k : k + width] in seen)
                seen.add(t[k : k + width])
        assert [f.tolist() for f in repeats(texts, width, 40)] == expected


@pytest.mark.parametrize("many", [2000, 3])
def test_repeated_strings_are_removed(spark, monkeypatch, many):
    monkeypatch.setattr(exact_substrings, "MANY", many)
    drawn = random.Random(2)
    base = "".join(drawn.choices("abcdefgh é\n", k=3000))
    rows = []
    for k in range(80):
        at = drawn.randint(0, 2700)
        rows.append((k, "".join(drawn.choices("xyz", k=30)) + base[at : at + drawn.randint(50, 300)]))
    rows += [(100, "ab" * 400), (101, None), (102, ""), (103, "x" * 99), (104, base), (7, rows[7][1])]
    seen, expected = set(), {}
    for k, text in sorted(set(rows), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(data[at : at + 100])
        rest = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        expected[k] = (len(data), sum(gone), hashlib.sha256(rest).hexdigest())
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_doc", F.lit(0))
    found = exact_substrings.deduplicate_substrings(docs).collect()
    assert len(found) == len(rows)
    assert all((r.n_bytes, r.n_removed, r.kept_sha256) == expected[r.doc_id] for r in found)
    assert exact_substrings.deduplicate_substrings(docs.limit(0)).count() == 0


@pytest.mark.parametrize("many", [2000, 1])
def test_repeated_strings_under_text_ids(spark, monkeypatch, many):
    monkeypatch.setattr(exact_substrings, "MANY", many)
    passage = "".join(random.Random(3).choices("abcdefgh", k=150))
    # In the order of text, a10 is ahead of a9; a string of one letter repeats within its row.
    rows = [("a9", "zz" + passage), ("a10", passage), (None, passage), ("b", "q" * 400), ("c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = {r.doc_id: r.n_removed for r in exact_substrings.deduplicate_substrings(docs).collect()}
    assert found == {"a10": 0, "a9": 150, None: 150, "b": 399, "c": 0}


def test_mix(spark):
    rows = [(k, "w " * (k % 9), ["a", "b", None][k % 3], 5) for k in range(600)]
    rows += [(None, None, "a", 5), (1, "w", "b", 5), (1, "w", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    found = mix(docs).collect()
    assert len(found) == len(rows)
    assert all(r.taken <= 2 * r.size for r in found)
    by_target = {}
    for r in found:
        by_target[(r.target, r.source_size)] = by_target.get((r.target, r.source_size), 0) + r.taken
    assert all(abs(taken - t) <= 9 and t <= 2 * size for (t, size), taken in by_target.items())
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mix(docs.limit(0)).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    drawn = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(30):
        text = drawn.choices(words, k=120)
        for copy in range(3):
            edited = list(text)
            for _ in range(copy * 2):
                edited[drawn.randrange(120)] = "edit"
            rows.append((10 * k + copy, " ".join(edited)))
    rows += [(1000, None), (1001, None), (1002, ""), (1003, "!!"), (1004, "!!"), (1005, "a b"), (1006, "A, b."), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(1))
    texts = dict(rows)
    ids = sorted(texts)
    parent = {k: k for k in ids}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    grams = {k: labelled([texts[k] or ""])[0] for k in ids}
    for a in ids:
        for b in ids:
            same = texts[a] and texts[a] == texts[b]
            if a < b and (same or alignment(grams[a], grams[b]) >= 0.8):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found} == {k: root(k) for k in ids}
    kept = sorted(r.doc_id for r in deduplicated(docs).collect())
    assert kept == sorted({root(k) for k in ids})
    assert near_duplicates(docs.limit(0)).count() == 0


def test_copies_alike_only_their_original(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 32)
    drawn = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    base = drawn.choices(words, k=120)
    passage = drawn.choices(words, k=40)
    texts = [" ".join(base)]
    for k in range(300):
        edited = list(base)
        for at in drawn.sample(range(120), 2):
            edited[at] = f"edit{k}"
        texts.append(" ".join(edited))
    texts += [" ".join(passage + drawn.choices(words, k=20)) for _ in range(100)]
    lost = drawn.choices(words, k=120)
    for k in range(150):
        edited = list(lost)
        for at in drawn.sample(range(120), 2):
            edited[at] = f"other{k}"
        texts.append(" ".join(edited))
    drawn.shuffle(texts)
    grams = [labelled([t])[0] for t in texts]
    least = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if least[a] != least[b] and alignment(grams[a], grams[b]) >= 0.8:
                low, high = sorted((least[a], least[b]))
                least = [low if k == high else k for k in least]
    assert max(least.count(k) for k in least) == 301
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert found == dict(enumerate(least))


def test_decontamination(spark):
    item = " ".join(f"t{k}" for k in range(14))
    rows = [(1, f"A b {item.upper()} c"), (2, "x t0 t1 t2"), (3, None), (4, ""), (5, "Short, one!"), (1, f"A b {item.upper()} c")]
    rows += [(6, " ".join(item.split()[:6] + ["new"] + item.split()[6:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(7))
    items = spark.createDataFrame([(7, item), (8, "short one"), (9, ""), (10, None), (7, item)], "item_id long, text string")
    found = decontaminate(docs, items).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in found) == [
        (1, 17, 14, 1), (1, 17, 14, 1), (2, 4, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, 2, 2, 1), (6, 15, 0, 0),
    ]
    assert decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate(docs.limit(0), items).count() == 0
    near = {r._off for r in matches(docs.filter("doc_id = 6"), items, slop=1).collect()}
    assert near


def test_decontamination_of_repeated_words(spark):
    drawn = random.Random(9)
    texts = [" ".join(drawn.choices("ab" if k % 3 else "abc", k=drawn.randint(5, 60))) for k in range(40)]
    texts += ["a " * 3000, "a b " * 500, "b " * 9, None]
    passages = [" ".join(drawn.choices("ab", k=drawn.randint(3, 16))) for _ in range(12)] + ["a " * 1500, "b a " * 40, "b"]

    def windows(words):
        return {tuple(words[k : k + 10]) for k in range(max(len(words) - 9, 1))} if words else set()

    expected = {}
    for k, text in enumerate(texts):
        words, hit, found = (text or "").split(), set(), set()
        for i, passage in enumerate(passages):
            for w in windows(passage.split()):
                places = [p for p in range(len(words) - len(w) + 1) if tuple(words[p : p + len(w)]) == w]
                hit |= {p + j for p in places for j in range(len(w))}
                found |= {str(i)} if places else set()
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected[k] = (len(words), len(hit), len(found), digest, bool(hit))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    assert {r[0]: tuple(r[1:]) for r in decontaminate(docs, items).collect()} == expected


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "k", 2, 3, "r", 4)],
        "doc_id long, text string, _key string, _aligned int, _hits int, _row string, `x.y` int",
    )
    items = spark.createDataFrame([(7, "b c")], "item_id long, text string")
    (row,) = marked(docs, items).collect()
    assert tuple(row) == (1, "a b c", "k", 2, 3, "r", 4, 3, [1, 2], ["7"])


def test_quotations(spark):
    texts = ["Hello all.\nHow is it?", "Fine, thanks.", "Hello all.\nHow is it?", "And you?"]
    rows = [(1, k, "user", t) for k, t in enumerate(texts)] + [(2, 0, "user", None), (None, 0, "user", "x"), (2, 1, "a", "")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): r for r in link_quotations(as_mail(chats)).collect()}
    assert len(found) == len(rows)
    assert [found[1, k].own for k in range(4)] == texts
    # The third message repeats the first, which is the original of its quotes.
    assert [(found[1, k].parent_turn, found[1, k].depth) for k in range(4)] == [(None, 0), (0, 1), (1, 2), (0, 1)]
    assert link_quotations(chats.limit(0)).count() == 0


def test_trimmed_and_interleaved_quotations(spark):
    first = "Alpha one is here.\nBeta two follows it.\nGamma three ends.\nDelta four.\n\nEpsilon five.\n\nZeta six."
    rows = [
        (1, 0, "user", first),
        (1, 1, "user", "nothing in common"),
        (1, 2, "user", "> Beta two follows it.\n> Gamma  three ends.\nYes.\n> Delta four.\n>\n> Epsilon five.\nNo."),
        (1, 3, "user", "> Alpha one is here.\n> Zeta six.\nCut in between."),
        (1, 4, "user", ">> Gamma three ends.\n>> Delta four.\n> Yes.\nAgreed."),
        (1, 5, "user", "> Nobody wrote this.\n> Nor that.\nWhat?"),
        (2, 1, "user", "> Beta two follows it.\n> Gamma three ends.\nElsewhere."),
    ]
    docs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.parent_turn, r.depth) for r in link_quotations(docs).collect()}
    assert found == {
        (1, 0): (0, 0, None, 0), (1, 1): (0, 0, None, 0), (1, 2): (2, 2, 0, 1), (1, 3): (1, 1, 0, 1),
        (1, 4): (2, 2, 2, 2), (1, 5): (1, 0, None, 0), (2, 1): (1, 0, None, 0),
    }
