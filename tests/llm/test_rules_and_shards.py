"""URL filters, ring sharding and adaptive quality rules."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from sonara.llm import quality_rules, sharding, url_filter

from . import brute

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "a.org/f"), ("block", "a.org/fr/x/"), ("allow", "a.org/fr/x/"), ("allow", "c.d.net")]


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:cut].translate(brute.FOLD), path[:end]


def plain_rule(url):
    host, path = plain_parts(url)
    best = None
    for v, text in RULES:
        h, slash, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            key = (h.count("."), len(slash + p), v == "block")
            if best is None or key > best[0]:
                best = (key, text, v)
    return (host, path, best[1], best[2]) if best else (host, path, None, "allow")


def test_urls_against_all_rules(spark):
    rng = random.Random(1)
    urls = [None, "", "x", "://", "http://NET", "http://net/", "https://A.org/fr/x/y?q#z", "http://a.org/fr/x", "http://a.org/free", "http://c.d.net", "http://c.d.net?x", "http://x.c.d.net/q", "http://u@b.net:80/", "http://é.org/fr/", "http://net\n/a"]
    hosts = ["net", "example.net", "w.example.net", "example.com", "notexample.com", "org", "a.org", "b.a.org", "EXAMPLE.com", ""]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/de/1', '/fr/x/', '/f', '/en', '//en/'])}{rng.choice(['', '?a/b', '#/en/'])}" for _ in range(200)]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, RULES).collect()}
    assert got == {k: plain_rule(u) for k, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.limit(0), RULES).collect() == []
    clashing = pages.selectExpr("*", "'x' as _judged", "1 as _row", "'h' as host")
    assert {(r["page_id"], r["host"], r["_judged"], r["_row"]) for r in url_filter.filter_urls(clashing, RULES).collect()} == {(k, plain_rule(u)[0], "x", 1) for k, u in enumerate(urls)}
    cased = pages.selectExpr("page_id", "url", "'x' as HOST", "'y' as Verdict", "1 as `a.b`")
    assert url_filter.filter_urls(cased, RULES).columns == ["page_id", "url", "a.b", "host", "path", "rule", "verdict"]
    with pytest.raises(ValueError):
        url_filter.parse_rule("deny", "x/")


def _place_one_by_one(ids, shards, limits, nodes):
    """The rounds of the ring with single keys."""
    import hashlib

    where = {}
    position = lambda i: int(hashlib.md5(f"key-{'null' if i is None else i}".encode()).hexdigest()[: sharding._HEX_DIGITS], 16)
    arc = lambda i: next((k for k, (p, _) in enumerate(nodes) if p >= position(i)), 0)
    waiting = {}
    for i in sorted(ids, key=position):
        waiting.setdefault(arc(i), []).append((arc(i), position(i), i))
    room = list(limits)
    while waiting:
        moved = {}
        for at in sorted(waiting):
            for key in waiting[at]:
                if room[nodes[at][1]]:
                    room[nodes[at][1]] -= 1
                    where[key[2]] = nodes[at][1]
                else:
                    moved.setdefault(at, []).append(key)
        free = [k for k, (_, s) in enumerate(nodes) if room[s]]
        waiting = {}
        for at in sorted(moved):
            waiting.setdefault(next((k for k in free if k > at), free[0] if free else 0), []).extend(moved[at])
    return where


@pytest.mark.parametrize("factor", [1.0, 1.25])
def test_ring_against_single_keys(spark, factor):
    ids = list(range(0, 3000, 7))
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    rows = sharding.shard_documents(docs, shards=7, virtual_nodes=9, load_factor=factor).collect()
    want = _place_one_by_one(ids, 7, sharding.bounds(len(ids), 7, factor), sharding.ring(7, 9))
    assert {r["doc_id"]: r["shard"] for r in rows} == want


def test_shards_hold_their_law(docs, texts):
    rows = sharding.shard_documents(docs, shards=8).collect()
    assert brute.multiset((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == brute.multiset((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    again = sharding.shard_documents(docs.repartition(2), shards=8).collect()
    assert brute.multiset(rows) == brute.multiset(again)


def test_growth_moves_few_keys(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(4000)], "doc_id long, text string")
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, shards=n, load_factor=1.25).collect()} for n in (20, 21))
    assert sum(a[i] != b[i] for i in a) < 0.25 * len(a)


def test_fewer_rows_than_shards(spark, nothing):
    docs = spark.createDataFrame([(1, None), (2, "b")], "doc_id long, text string")
    assert {r["slot"] for r in sharding.shard_documents(docs, shards=5).collect()} == {0}
    assert sharding.shard_documents(nothing).collect() == []


def test_statistics_against_brute_force(spark, docs, texts):
    more = [(100, "a|b <c>\n\nx y\nx y\n x y\n\t\nx y"), (101, "\n"), (102, "x\n\nx"), (103, "l1\r\nl1\r\nl1\n"), (104, "a b a b a b"), (105, "z")]
    frame = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(i, t, None, None) for i, t in more], "doc_id long, text string, lang string, source string"))
    got = quality_rules.with_statistics(frame).select("doc_id", *quality_rules.STATISTICS).collect()
    assert brute.multiset(got) == brute.multiset((i, *brute.statistics(t)) for i, t in [*texts, *more])


def test_rules_adapt_to_groups(spark, nothing):
    rng = random.Random(8)
    make = lambda n, marks: " ".join(("#|" if rng.random() < marks else "") + "word" + str(rng.randrange(10**6)) for _ in range(n))
    rows = [(k, make(100, 0.5), "xx", "code") for k in range(300)] + [(1000 + k, make(100, 0.0), "en", "news") for k in range(300)]
    rows += [(5000, make(100, 0.9), "en", "news"), (5001, make(20, 0), "en", "news"), (5002, "a b " * 60, "en", "news"), (5003, make(100, 0.0), "en", "tiny"), (5004, make(100, 0.9), "en", "tiny"), (5005, None, None, None)]
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] == (False, True) for i in (*range(300), *range(1000, 1300), 5003))
    assert [kept[i] for i in (5000, 5001, 5002, 5004, 5005)] == [(False, False), (True, False), (True, False), (False, False), (True, False)]
    assert quality_rules.apply_rules(nothing).collect() == []


def test_sketches_merge(spark, docs):
    stats = quality_rules.with_statistics(docs)
    whole = quality_rules.merge(quality_rules.sketch(stats), ())
    direct = quality_rules.sketch(stats.withColumn("lang", stats.lang.substr(1, 0)).withColumn("source", stats.source.substr(1, 0)))
    assert brute.multiset(whole.collect()) == brute.multiset(quality_rules.merge(direct, ()).collect())


def test_every_group_has_cutoffs_of_its_own(spark):
    """Quartiles of a group's values with those of its language and of all, scaled to so many documents."""
    rng = random.Random(12)
    sizes = {("en", "a"): 300, ("en", "b"): 3, ("de", "a"): 40, (None, None): 1, ("de", None): 500}
    values = {g: [rng.randrange(*((0, 64) if g[1] == "a" else (100, 127))) for _ in range(n)] for g, n in sizes.items()}  # one bucket for each value
    rows = [(*g, "symbols", v, values[g].count(v)) for g in values for v in set(values[g])]
    fine = spark.createDataFrame(rows, "lang string, source string, measure string, bucket long, n long")
    got = {(r["lang"], r["source"]): r["high_symbols"] for r in quality_rules.cutoffs(quality_rules.blend(fine, (20, 6)), ("lang", "source"), 3.0).collect()}
    for g in values:
        weight = Counter()
        for scale, own in ((None, values[g]), (20, [v for h in values if h[0] == g[0] for v in values[h]]), (6, [v for h in values for v in values[h]])):
            for v in own:
                weight[v] += 1.0 if scale is None else scale / len(own)
        upto, total, quartiles = 0.0, sum(weight.values()), {}
        for v in sorted(weight):
            upto += weight[v]
            for q in (1, 3):
                if upto >= total * q / 4 - 1e-9:
                    quartiles.setdefault(q, v)
        assert got[g] == quartiles[3] + 3 * (quartiles[3] - quartiles[1]) + 1000
    assert len({got["en", "a"], got["en", "b"]}) == 2, "sources of one language differ"


def test_growth_at_load_factor_one_moves_few_keys(spark):
    frame = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard_documents(frame, shards=n).collect()} for n in (40, 41))
    assert sum(a[k] != b[k] for k in a) < 0.1 * len(a)
