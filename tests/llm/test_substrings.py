"""Substring deduplication and string tiling."""

from __future__ import annotations

import random

import numpy as np

from sonara.llm import debruijn, tiling
from sonara.llm.common import Scratch

from . import brute
from .conftest import CLASHING, prose


def test_removal_against_brute_force(docs, texts):
    assert brute.multiset(debruijn.removal_digest(docs).collect()) == brute.multiset(brute.removal(texts))


def test_other_spans(docs, texts):
    assert brute.multiset(debruijn.removal_digest(docs, span=8, seed=3).collect()) == brute.multiset(brute.removal(texts, 8))


def test_paths_are_contracted(spark):
    """A chain of 9, a fork that ends it, a closed path, and units by themselves."""
    chain = [(k, k, k + 1, k % 3 + 1) for k in range(9)]
    fork = [(20, 9, 30, 1), (21, 9, 31, 1), (22, 31, 32, 4)]
    ring = [(40, 50, 51, 1), (41, 51, 52, 1), (42, 52, 50, 1)]
    units = spark.createDataFrame(chain + fork + ring + [(60, 70, 71, 1), (61, 72, 72, 1)], "id long, source long, target long, n int")
    got = {r["id"]: (r["head"], r["behind"]) for r in debruijn.contract_paths(units, Scratch(spark, "test")).collect()}
    want = {k: (0, sum(j % 3 + 1 for j in range(k))) for k in range(1, 9)} | {22: (21, 1)}
    assert got == want
    assert debruijn.contract_paths(units.limit(0), Scratch(spark, "test")).collect() == []


def test_a_long_passage_is_one_span(spark):
    """Copies of a passage, some cut short, in otherwise different texts; and a text that repeats itself."""
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(300)]
    texts = [(k, " ".join([f"a{k}_{j}" for j in range(40)] + passage + [f"b{k}_{j}" for j in range(40)])) for k in range(4)]
    texts += [(10, " ".join(passage[50:120] + [f"c{j}" for j in range(40)])), (11, " ".join(["x", "y", "z"] * 60)), (12, " ".join(prose(rng, 50) * 3))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert brute.multiset(debruijn.removal_digest(docs).collect()) == brute.multiset(brute.removal(texts))
    found = debruijn.Repeats(docs)
    spans = {r["_doc"]: r["spans"] for r in found.spans.collect()}
    assert found.paths.count() > 0 and all(len(spans[k]) <= 5 for k in range(4))


def test_texts_are_cleaned_in_place(docs, texts):
    cleaned = debruijn.remove_repeats(docs)
    assert cleaned.columns == docs.columns
    want = {}
    for (i, t), (_, n, gone, digest) in zip(texts, brute.removal(texts)):
        want.setdefault(i, []).append(t if not gone else digest)
    import hashlib

    for r in cleaned.collect():
        assert r["text"] in want[r["doc_id"]] or hashlib.sha256((r["text"] or "").encode()).hexdigest() in want[r["doc_id"]]
    assert cleaned.count() == docs.count()


def test_empty(nothing, spark):
    assert debruijn.removal_digest(nothing).collect() == [] and debruijn.remove_repeats(nothing).collect() == []
    bench = spark.createDataFrame([], "item_id long, text string")
    assert tiling.contaminated(nothing, bench).collect() == []


def _tiles_plainly(item, text, m):
    """Greedy tiling by looking at all pairs of places again and again."""
    item, text, total = list(item), list(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] is not None and item[i + n] == text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < m:
            return total
        total += n
        item[i : i + n] = [None] * n
        text[j : j + n] = [-1] * n


def test_tiles_against_all_pairs():
    rng = random.Random(2)
    for _ in range(40):
        item = np.array([rng.randrange(6) for _ in range(rng.randrange(4, 30))], np.uint64) + np.uint64(1)
        text = np.array([rng.randrange(6) for _ in range(rng.randrange(4, 40))], np.uint64) + np.uint64(1)
        tiles = tiling.tile(item, text, 3)
        used_i, used_j = set(), set()
        for i, j, n in tiles:
            assert n >= 3 and np.array_equal(item[i : i + n], text[j : j + n])
            assert not used_i & set(range(i, i + n)) and not used_j & set(range(j, j + n))
            used_i |= set(range(i, i + n))
            used_j |= set(range(j, j + n))
        assert sum(n for _, _, n in tiles) == _tiles_plainly(item.tolist(), text.tolist(), 3)


def test_tiles_cover_as_much_as_all_pairs():
    rng = random.Random(3)
    for _ in range(1500):
        item = np.array([rng.randrange(6) for _ in range(rng.randrange(4, 30))], np.uint64) + np.uint64(1)
        text = np.array([rng.randrange(6) for _ in range(rng.randrange(4, 40))], np.uint64) + np.uint64(1)
        assert sum(n for _, _, n in tiling.tile(item, text, 3)) == _tiles_plainly(item.tolist(), text.tolist(), 3)


def test_overlapping_quotes_add_up(spark):
    item = [f"i{k}" for k in range(20)]
    text = " ".join([*item[5:14], "x", "y", *item[0:8]])
    got = tiling.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"], r["n_tiles"]) for r in got] == [(1, 10, 0.7, 2)]


def test_reordered_and_recased_passages_are_caught(spark):
    rng = random.Random(4)
    item = prose(rng, 40)
    other = [f"q{k}" for k in range(40)]
    reordered = " ".join(item[20:] + ["and"] + item[:20])
    rows = [
        (1, " ".join(prose(rng, 30) + item + prose(rng, 30))), (2, "".join(c if c == "ß" else c.upper() for c in reordered)), (3, " ".join(item[:15])), (4, " ".join(prose(rng, 200))), (5, None), (6, ""),
        (7, '"' + " ".join(item[:25]) + '!"'), (1, " ".join(item)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other)), (12, "too short"), (13, None)], "item_id long, text string")
    got = tiling.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 10), (1, 10), (2, 10), (7, 10)]
    assert all(r["n_tiles"] >= 2 for r in got if r["doc_id"] == 2)
    assert sorted(r["doc_id"] for r in tiling.remove_contaminated(docs, bench).collect()) == [3, 4, 5, 6]


def test_items_in_slices(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(9)]
    docs = spark.createDataFrame([(k, " ".join(prose(rng, 20)) + " " + items[k][1]) for k in range(9)], "doc_id long, text string")
    monkeypatch.setattr(tiling, "SLICE_WORDS", 50)
    got = tiling.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, k) for k in range(9)]


def test_clashing_names_come_back(spark, docs, texts):
    rows = [(10, texts[0][1])]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    cleaned, left = debruijn.remove_repeats(docs), tiling.remove_contaminated(docs, bench)
    for got in (cleaned, left):
        assert got.columns == docs.columns
        assert all(r[c] == c for r in got.collect() for c in CLASHING)
    bad = {r["doc_id"] for r in tiling.contaminated(docs, bench).collect()}
    assert bad and left.count() == sum(i not in bad for i, _ in texts)
    assert tiling.remove_contaminated(docs, bench.limit(0)).count() == len(texts)
