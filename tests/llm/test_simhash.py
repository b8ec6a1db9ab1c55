"""SimHash components against all pairs, with long lists and without."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from sonara.llm import kernels as K
from sonara.llm import queries, simhash
from sonara.llm.common import Scratch, table

from . import brute
from .test_corpus_queries import SF
from .test_corpus_queries import pytestmark as needs_tables


def plain_print(text, n=4):
    w = brute.words((text or "").translate(brute.FOLD))
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] * bool(w)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """(doc_id, fingerprint, least reachable id) by all pairs of fingerprints; rows of one id are one node."""
    prints = [plain_print(t) for _, t in rows]
    of_id = defaultdict(set)
    for (i, _), p in zip(rows, prints):
        if i is not None:
            of_id[i].add(p)
    parent = {p: p for own in of_id.values() for p in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = list(parent)
    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    for own in of_id.values():
        first, *others = own
        for b in others:
            parent[find(b)] = find(first)
    least = {}
    for i, own in of_id.items():
        for p in own:
            least[find(p)] = min(least.get(find(p), i), i)
    return [(i, f"{p:016x}", None if i is None else least[find(p)]) for (i, _), p in zip(rows, prints)]


def test_fingerprints(texts):
    own = [t for _, t in texts]
    for limit in (50, 1 << 20):
        got = [int(p) for chunk in K.chunks(pa.array(own), limit) for p in simhash.fingerprints(chunk, 4)]
        assert got == [plain_print(t) for t in own]


def test_votes_in_slices(monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 7)
    own = ["a b c d e f g h i j k l m n o p q r s t u v w x y z", None, "x", "q r s t " * 9]
    (chunk,) = K.chunks(pa.array(own))
    assert [int(p) for p in simhash.fingerprints(chunk, 4)] == [plain_print(t) for t in own]


def test_against_all_pairs(docs, texts):
    got = Counter(map(tuple, simhash.near_duplicate_components(docs).collect()))
    assert got == Counter(plain_components(texts))


def clustered(rng):
    """Fingerprints in dense clusters, at distances around the limit, with bytes at the sign and at both ends."""
    out = set()
    for centre in (0, 2**64 - 1, rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(60):
            p = centre
            for k in rng.sample(range(64), rng.randrange(8)):
                p ^= 1 << k
            out.add(p)
    return sorted(out | {rng.getrandbits(64) for _ in range(100)})


@pytest.mark.parametrize("short", [{3: 64, 4: 512}, {3: 4, 4: 512}, {3: 2, 4: 2}])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, short):
    monkeypatch.setattr(simhash, "SHORT_LISTS", short)
    prints = clustered(random.Random(6))
    frame = spark.createDataFrame([(p - (p >> 63 << 64), k) for k, p in enumerate(prints)], "print long, node long")
    got = {tuple(sorted(r)) for r in simhash.links(frame, Scratch(spark, "test-simhash")).collect()}
    near = {(i, k) for k, p in enumerate(prints) for i in range(k) if (p ^ prints[i]).bit_count() <= 4}
    assert got <= near
    if short[4] > 2:
        assert got == near

    def reach(links):
        parent = list(range(len(prints)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(k) for k in range(len(prints))]

    assert reach(got) == reach(near)


def test_postings_are_never_broadcast(spark, monkeypatch):
    """Spark sizes exploded rows by those they come from, so it took many of them for few."""
    monkeypatch.setattr(simhash, "SHORT_LISTS", {3: 4, 4: 512})
    plans, keep = [], Scratch.keep

    def recorded(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", recorded)
    frame = spark.createDataFrame([(p - (p >> 63 << 64), k) for k, p in enumerate(clustered(random.Random(6)))], "print long, node long")
    found = simhash.links(frame, Scratch(spark, "test-simhash"))
    assert [name for name, _ in plans] == ["postings", "postings"]
    assert not any("BroadcastExchange" in plan for _, plan in plans)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_nothing_and_one(spark, nothing):
    assert simhash.near_duplicate_components(nothing).collect() == []
    rows = [(None, "a text without an id"), (None, None), (4, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, simhash.near_duplicate_components(frame).collect())) == Counter(plain_components(rows))


@needs_tables
def test_query_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert Counter(map(tuple, queries.QUERIES["op12_simhash"](spark, SF).collect())) == Counter(plain_components(rows))
