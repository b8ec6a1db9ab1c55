"""Drawn pairs, impostor grids, running totals and shard windows against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sonara.functions import permutation, ranking
from sonara.operators import batching, contracts, shards, splits, trials
from sonara.plans import queries
from sonara.scratch import Scratch

from .test_queries import SF


def digest(*parts):
    return hashlib.sha256("\x1f".join(map(str, (2026, *parts))).encode()).hexdigest()


def plain_permutation(x, n, *key):
    a = max(1, math.ceil(math.sqrt(n)))
    b = (n + a - 1) // a
    while True:
        for r in range(4):
            left, right = divmod(x, b)
            drawn = int(digest(*key, r, right if r % 2 == 0 else left)[:15], 16)
            x = (left + drawn) % a * b + right if r % 2 == 0 else left * b + (right + drawn) % b
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 6, 10, 66, 91, 1000, 4951])
def test_keyed_permutation_is_one(spark, n):
    got = spark.range(n).select("id", permutation.keyed_permutation(F.col("id"), F.lit(n).cast("long"), 2026, "k", F.lit("s")).alias("x")).collect()
    assert sorted(r["x"] for r in got) == list(range(n))
    assert all(r["x"] == plain_permutation(r["id"], n, "k", "s") for r in got[:200])


def test_pair_numbers(spark):
    got = spark.range(5000).select("id", *[c.alias(k) for k, c in zip("ij", permutation.pair_of(F.col("id")))]).collect()
    assert [(r["i"], r["j"]) for r in got[:6]] == [(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3)]
    assert all(0 <= r["i"] < r["j"] and r["j"] * (r["j"] - 1) // 2 + r["i"] == r["id"] for r in got)
    far = [j * (j - 1) // 2 + d for j in (94906266, 10**9, 2 * 10**9 + 1) for d in (-1, 0, 1)]
    got = spark.createDataFrame([(x,) for x in far], "x long").select("x", *[c.alias(k) for k, c in zip("ij", permutation.pair_of(F.col("x")))]).collect()
    assert all(0 <= r["i"] < r["j"] and r["j"] * (r["j"] - 1) // 2 + r["i"] == r["x"] for r in got)


def test_greatest_common_divisors(spark):
    rows = [(12, 18), (7, 13), (1, 1), (2**40, 2**20 * 3), (7540113804746346429, 4660046610375530309), (5, 5)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", permutation.gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r["g"] == math.gcd(r["a"], r["b"]) for r in got)


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr(ranking, "STRETCH", 4)
    rng = random.Random(3)
    rows = [(g, k, rng.randrange(10)) for g in "ab" for k in rng.sample(range(40), 25)]
    got = ranking.running_total(spark.createDataFrame(rows, "g string, k int, v int"), F.col("v"), "k", "before", ("g",)).collect()
    assert sorted((r["g"], r["k"], r["v"], r["before"]) for r in got) == sorted((g, k, v, sum(w for h, i, w in rows if h == g and i < k)) for g, k, v in rows)
    got = ranking.running_total(spark.range(10).toDF("k"), F.lit(1), "k", "before").collect()
    assert all(r["before"] == r["k"] for r in got)


def test_legacy_pairs_are_drawn_from_all(spark):
    sizes = {"a": 40, "b": 3, "c": 2, "d": 5}
    rows = [(s, f"{s}/{k}.wav") for s, n in sizes.items() for k in range(n)]
    got = trials.drawn_pairs(spark.createDataFrame(rows + rows[:5], "speaker_id string, path string"), 10).collect()
    expected = set()
    for s, n in sizes.items():
        own = sorted((p for o, p in rows if o == s), key=lambda p: (digest("genuine", p), p))
        every = [(own[i], own[j]) for j in range(n) for i in range(j)]
        expected |= {tuple(sorted(every[plain_permutation(k, len(every), "genuine", s)])) for k in range(min(10, len(every)))}
    assert len(got) == len(expected) == 10 + 3 + 1 + 10
    assert {(r["left_audio_path"], r["right_audio_path"]) for r in got} == expected
    assert trials.drawn_pairs(spark.createDataFrame([("a", "a/1.wav")], "speaker_id string, path string"), 10).collect() == []


def test_legacy_trials_read_utterances_once_and_draw_on_all_cores(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(s, f"{s}/{k}.wav") for s in "abcd" for k in range(5)], "speaker_id string, path string").coalesce(1)
    made = trials.legacy_trials(rows.mapInArrow(counted, rows.schema), 4)
    assert made.count() == 32 and seen.value == 20
    assert trials._spread(rows).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    drawn = rows.select(permutation.keyed_permutation(F.lit(0), F.lit(9), 1, F.col("path")))
    assert "aggregate(" not in drawn._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """Names and plans of the tables that are kept meanwhile."""
    found, keep = [], Scratch.keep

    def recorded(self, df, name):
        found.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", recorded)
    return found


def test_drawn_numbers_and_rounds_are_never_broadcast(spark, plans):
    """Spark sizes exploded rows by those they come from, so it took many of them for few."""
    rows = spark.createDataFrame([(s, f"{s}/{k}.wav") for s in "abcd" for k in range(5)], "speaker_id string, path string")
    assert trials.legacy_trials(rows, 4).count() == 32
    made = dict(plans)
    assert {"genuine", "impostor"} <= set(made)
    assert not any("BroadcastExchange" in made[name] for name in ("genuine", "impostor"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_legacy_ids_broadcast_no_drawn_rows(spark, plans):
    assert [(r["rule"], r["detail"]) for r in queries.legacy_ids(spark, SF).collect()] == [("contiguous_ids", "2997")]
    assert not any("BroadcastExchange" in plan for name, plan in plans if name in ("genuine", "impostor"))


@pytest.mark.parametrize("slack", [6.0, 0.0])
def test_least_pairs_are_exact(spark, slack):
    """Without slack some speakers come through a bound with too few pairs and go again."""
    rows = [(f"s{s}", f"s{s}/{k}.wav") for s, n in enumerate([60, 45, 30, 2, 5] * 4) for k in range(n)]
    quotas = spark.createDataFrame([(f"s{s}", 4 + s % 2) for s in range(20)], "speaker_id string, quota long")
    got = trials._least_pairs(spark.createDataFrame(rows + rows[:9], "speaker_id string, path string"), quotas, 2026, slack).collect()
    expected = set()
    for s in range(20):
        own = sorted(p for o, p in rows if o == f"s{s}")
        expected |= set(sorted((digest("genuine", f"s{s}", a, b), a, b) for i, a in enumerate(own) for b in own[i + 1 :])[: 4 + s % 2])
    assert len(got) == len(expected) and {(r["digest"], r["a"], r["b"]) for r in got} == expected


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("total", [9, 12])
def test_impostors_of_few_utterances(spark, seed, total):
    """Four unseen pairs for each of three speaker pairs: all of them can be had."""
    rows = [(s, f"{s}/{k}.wav") for s in "abc" for k in range(2)]
    made = trials.impostor_trials(spark.createDataFrame(rows, "speaker_id string, path string"), total, seed).collect()
    assert len({(r["left_audio_path"], r["right_audio_path"]) for r in made}) == len(made) == total
    uses = Counter(p for r in made for p in (r["left_audio_path"], r["right_audio_path"]))
    for s in "abc":
        own = [uses[p] for o, p in rows if o == s]
        assert max(own) - min(own) <= 1


def test_impostors_use_utterances_equally(spark):
    rng = random.Random(9)
    rows = [(f"s{s}", f"s{s}/{k}.wav") for s in range(7) for k in range(rng.randrange(3, 12))]
    made = trials.impostor_trials(spark.createDataFrame(rows, "speaker_id string, path string"), 60).collect()
    assert len({(r["left_audio_path"], r["right_audio_path"]) for r in made}) == 60
    uses = Counter(p for r in made for p in (r["left_audio_path"], r["right_audio_path"]))
    for s in {s for s, _ in rows}:
        own = [uses[p] for o, p in rows if o == s]
        assert max(own) - min(own) <= 1


def plain_windows(rows, p, k, window, seed, epoch=0):
    """(window, batch, speaker, set of rows) in seat order, halving from the top down."""
    d = lambda *parts: hashlib.sha256("\x1f".join(map(str, (seed, epoch, *parts))).encode()).hexdigest()
    order = sorted({s for s, _, _ in rows}, key=lambda s: (d("shard", s), s))
    base = {s: n // window for n, s in enumerate(order)}
    own = defaultdict(list)
    for s, speaker, path in sorted(rows, key=lambda r: (base[r[0]], d("row", r[2]), r[2])):
        own[speaker].append((path, base[s]))
    units = {}
    for speaker, queue in own.items():
        cuts = [queue[i : i + k] for i in range(0, len(queue) - len(queue) % k, k)] + ([queue[-k:]] if len(queue) % k else [])
        units[speaker] = [([x for x, _ in cut], max(b for _, b in cut)) for cut in cuts]
    able = lambda lo, hi: lo > max(base.values()) or sum(any(lo <= b < hi for _, b in u) for u in units.values()) >= p

    def halve(lo, width):
        half = width // 2
        if width > 1 and able(lo, lo + half) and able(lo + half, lo + width):
            return halve(lo, half) + halve(lo + half, half)
        return [(lo, lo + width)]

    top = 1 << max(base.values()).bit_length()
    circle = sorted(own, key=lambda s: (d("speaker", s), s))
    out, first = [], 0
    for lo, hi in halve(0, top):
        mine = {s: [x for x, b in u if lo <= b < hi] for s, u in units.items()}
        mine = {s: u for s, u in mine.items() if u}
        if not mine:
            continue
        batches = -(-sum(map(len, mine.values())) // p)
        start = first * p % len(circle)
        turn = [s for s in circle[start:] + circle[:start] if s in mine]
        for seat in range(batches * p):
            e, s = divmod(seat, len(turn))
            u = mine[turn[s]]
            out.append((lo, first + seat // p, turn[s], tuple(sorted(u[e % len(u)])), e // len(u)))
        first += batches
    return out


@pytest.mark.parametrize("window,p", [(1, 3), (2, 3), (1, 8), (4, 12)])
def test_shard_windows_against_halving(spark, window, p):
    rng = random.Random(window + p)
    rows = []
    for n in range(230):  # speakers drift through the shards, some are rare, some are everywhere
        s = rng.choice([n // 25, n // 25 + 1, 11]) if n % 7 else 12
        rows.append((f"train/{n // 16:02d}", f"s{s}", f"s{s}/{n}.wav"))
    rows += [(f"train/{k:02d}", f"r{j}", f"r{j}/{k}.wav") for j in range(3) for k in (j, j + 9)]
    rows = [r for r in rows if Counter(x[1] for x in rows)[r[1]] >= 2]
    got = batching.windowed_batches(spark.createDataFrame(rows, "shard_path string, speaker_id string, path string"), p, 2, window, 5).collect()
    seats = defaultdict(list)
    for r in got:
        seats[r["shard_window"], r["batch_id"], r["speaker_id"], r["cycle"], r["slot"] // 2].append(r["path"])
        assert r["shard_path"] == next(x[0] for x in rows if x[2] == r["path"])
    want = plain_windows(rows, p, 2, window, 5)
    assert sorted((w, b, s, tuple(sorted(x)), c) for (w, b, s, c, _), x in seats.items()) == sorted(want)
    for b in {r["batch_id"] for r in got}:
        own = [r for r in got if r["batch_id"] == b]
        assert sorted(r["slot"] for r in own) == list(range(2 * p)) and set(Counter(r["speaker_id"] for r in own).values()) == {2} and len({r["path"] for r in own}) == 2 * p


def test_windows_read_few_shards_and_expose_speakers_equally(spark):
    rows = [(f"train/{n // 32:02d}", f"s{n % 8}", f"s{n % 8}/{n}.wav") for n in range(32 * 12)]
    batches = batching.windowed_batches(spark.createDataFrame(rows, "shard_path string, speaker_id string, path string"), 3, 2, 2, 1)
    assert len({r["shard_window"] for r in batches.collect()}) == 6
    exposure = [r["exposure"] for r in batching.speaker_exposure(batches).collect()]
    assert max(exposure) - min(exposure) <= 1
    assert max(r["n_shards"] for r in batching.shards_per_batch(batches).collect()) <= 2


def test_windowed_batches_of_a_feature_index(spark):
    utt = spark.createDataFrame([(f"{s}", f"{s}/{k}.wav") for s in range(12) for k in range(5 + s)], "speaker_id string, path string")
    index = shards.feature_index(splits.portable_manifest(utt, split := splits.assign_splits(utt, (12, 0, 0)), splits.train_labels(split)), size=16)
    contracts.require(contracts.all_of(shards.alignment_violations(index, 16), shards.cache_violations(index, 16)))
    index = index.withColumnRenamed("relative_audio_path", "path")
    rows = batching.windowed_batches(index, 3, 2, 2, 5).collect()
    assert {r["path"] for r in rows} <= {r["path"] for r in utt.collect()} and len({r["speaker_id"] for r in rows}) == 12
    with pytest.raises(ValueError, match="P exceeds"):
        batching.windowed_batches(index, 13, 2, 2, 5)
    with pytest.raises(ValueError, match="K exceeds"):
        batching.windowed_batches(index, 3, 6, 2, 5)


def test_windows_are_never_halved_without_speakers(spark):
    units = spark.createDataFrame([("a", 0, 0), ("b", 0, 3), ("a", 1, 5)], "speaker_id string, unit long, base long")
    bases = spark.range(7).toDF("base")
    got = batching.shard_windows(units, bases, 2, Scratch(spark, "test-windows")).collect()
    assert {r["base"]: r["shard_window"] for r in got} == {k: 0 for k in range(7)}
    one = batching.shard_windows(units, bases, 1, Scratch(spark, "test-windows")).collect()
    assert {r["base"]: r["shard_window"] for r in one} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4}
