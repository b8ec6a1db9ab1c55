"""The n-gram join and connected components."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from sonara.llm import kernels as K
from sonara.llm import ngram_join
from sonara.llm.common import Scratch
from sonara.llm.components import components

from . import brute
from .conftest import CLASHING


def test_words_and_hashes():
    texts = ["a b\tc", "", None, "é   x\x0b\x0cy", "a", "tail "]
    for limit in (1, 4, 1000):
        found = []
        seen = {}
        for chunk in K.chunks(pa.array(texts), limit):
            w = K.words(chunk)
            body = chunk.data.tobytes()
            for d in range(len(w.bounds) - 1):
                own = [body[a:b].decode() for a, b in zip(w.start[w.bounds[d] : w.bounds[d + 1]], w.end[w.bounds[d] : w.bounds[d + 1]])]
                found.append(own)
                for x, h in zip(own, w.hash[w.bounds[d] : w.bounds[d + 1]].tolist()):
                    assert seen.setdefault(x, h) == h
        assert found == [brute.words(t) for t in texts]
        assert len(set(seen.values())) == len(seen)


def test_cells_survive_packing():
    rng = np.random.default_rng(1)
    for cells in (np.sort(rng.integers(0, 2**20, 5000, dtype=np.uint32)), np.sort(rng.integers(0, 2**32, 50, dtype=np.uint32)), np.array([7], np.uint32)):
        assert np.array_equal(ngram_join._unpack_cells(*ngram_join._pack_cells(cells)), cells)


@pytest.mark.parametrize("percent", [1, 50, 75, 90, 100])
def test_sizes_that_link_meet_in_one_band(spark, percent):
    reach = ngram_join.bands_in_reach("size", percent)
    sizes = [*range(1, 400), 4096, 4097, 2**20, 3 * 2**28, 2**30]
    rows = spark.createDataFrame([(s,) for s in sizes], "size int").select("size", ngram_join.size_band("size", percent).alias("band"), reach.alias("reach")).collect()
    band = {r["size"]: r["band"] for r in rows}
    for r in rows:
        for other in sizes:
            if 100 * min(r["size"], other) >= percent * max(r["size"], other):
                assert band[other] in r["reach"], (r["size"], other)
        assert len(r["reach"]) == len(set(r["reach"])) <= 3


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_against_brute_force(docs, texts):
    got = brute.multiset(ngram_join.near_duplicate_components(docs).collect())
    assert got == brute.multiset(brute.components(texts))


def test_small_bitmap_and_few_heavy_cells_change_nothing(docs, texts, monkeypatch):
    """The broadcast counts only steer the order."""
    monkeypatch.setattr(ngram_join, "MAX_BITS", 9)
    monkeypatch.setattr(ngram_join, "MAX_HEAVY", 64)
    monkeypatch.setattr(ngram_join, "HEAVY", 3)
    monkeypatch.setattr(ngram_join, "VERIFY_COST", 10**6)  # asks for as many matches as it may
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", 1)
    got = brute.multiset(ngram_join.near_duplicate_components(docs).collect())
    assert got == brute.multiset(brute.components(texts))


def test_costly_prefixes_ask_for_more_matches():
    cheap = ngram_join.choose_matches(np.ones(40, np.uint8), 0, 10, 8)
    hot = ngram_join.choose_matches(np.full(40, 12, np.uint8), 0, 10, 8)
    assert hot[0] == 8 and hot[1] == 17 and cheap[1] == 10 + cheap[0] - 1
    assert ngram_join.choose_matches(np.ones(5, np.uint8), 30, 10, 8)[1] == 0


def test_one_document_of_each_group_stays(docs, texts):
    kept = ngram_join.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    least = {c for i, _, c in brute.components(texts) if i is not None}
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = sorted({(i, t or "") for i, t in texts if i in least}) + sorted((-1, t or "") for i, t in texts if i is None)
    assert sorted((i, t or "") for i, t in rows if i is not None) + sorted((-1, t or "") for i, t in rows if i is None) == want
    assert all(r[c] == c for r in kept.collect() for c in CLASHING)


def test_empty(nothing):
    assert ngram_join.near_duplicate_components(nothing).collect() == []
    assert ngram_join.keep_one_per_component(nothing).collect() == []


@pytest.mark.parametrize("rows", [[(1, None)], [(1, "x"), (2, "x")], [(3, "a b c d e f"), (3, "a b c d e f")]])
def test_tiny(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert brute.multiset(ngram_join.near_duplicate_components(frame).collect()) == brute.multiset(brute.components(rows))


def test_the_least_demanding_text_of_an_id_decides(spark):
    rows = [(1, 2, 10, 10, 0, 0, 3, 3), (1, 2, 10, 10, 0, 0, 1, 3)]
    columns = "_node long, node long, _size int, size int, _place int, place int, _matches int, matches int"
    for order in (rows, rows[::-1]):
        pairs = spark.createDataFrame(order, columns).coalesce(1)
        assert [tuple(r) for r in ngram_join._candidates(pairs, "least(matches, _matches)", "8").collect()] == [(1, 2)]
