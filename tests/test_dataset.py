"""Splits, contracts, trials and batches on small utterance tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sonara.functions import text
from sonara.functions.digests import canonical_pair, table_identity
from sonara.functions.ranking import digest_rank, ordered_rank
from sonara.operators import batching, contracts, splits, trials


@pytest.fixture(scope="module")
def utt(spark):
    rows = [(f"{s}", f"{s}/{k}.wav") for s in range(1, 13) for k in range(5 + s % 4)]
    return spark.createDataFrame(rows, "speaker_id string, path string").cache()


def test_splits_are_disjoint_and_follow_the_digest(spark, utt):
    split = {r["speaker_id"]: r["split"] for r in splits.assign_splits(utt, (8, 2, 2)).collect()}
    order = sorted(split, key=lambda s: (hashlib.sha256(f"2026|{s}".encode()).hexdigest(), s))
    assert [split[s] for s in order] == ["train"] * 8 + ["validation"] * 2 + ["final_test"] * 2


def test_labels_are_numeric_aware_and_manifest_holds_its_contract(spark, utt):
    split = splits.assign_splits(utt, (8, 2, 2))
    labels = splits.train_labels(split)
    found = [r["speaker_id"] for r in labels.orderBy("label").collect()]
    assert found == sorted(found, key=int)
    manifest = splits.portable_manifest(utt, split, labels)
    contracts.require(contracts.manifest_violations(manifest, split, labels))
    bent = manifest.withColumn("speaker_label", F.lit(-1))
    with pytest.raises(contracts.ContractError):
        contracts.require(contracts.manifest_violations(bent, split, labels))


@pytest.mark.parametrize("path,speaker,rule", [("C:/a.wav", "C:", "portable_path"), ("x\\a.wav", "", "portable_path"), ("/1/a.wav", "1", "portable_path"), ("1/a.wav", "2", "parent_is_speaker"), ("1/a.mp3", "1", "wav_suffix"), (None, None, "portable_path")])
def test_one_broken_field_trips_its_rule(spark, path, speaker, rule):
    rows = spark.createDataFrame([(path, speaker)], "path string, speaker_id string")
    assert rule in {r["rule"] for r in contracts.utterance_violations(rows).collect()}


def test_ranks_are_global(spark):
    rows = spark.range(1000).withColumn("d", F.sha2(F.col("id").cast("string"), 256))
    by_digest = digest_rank(rows, "d", "id").orderBy("d").select("rank").collect()
    assert [r[0] for r in by_digest] == list(range(1000))
    assert all(r["id"] == r["rank"] for r in ordered_rank(spark.range(1000), [F.col("id")]).collect())


def test_costly_keys_are_columns_when_rows_are_sorted(spark):
    """Expressions in a sort's order are worked out at every comparison."""
    rows = spark.createDataFrame([(x,) for x in ("10", "9", "b", "A", "007", "7")], "speaker_id string")
    keys = text.numeric_aware_columns(F.col("speaker_id"))
    ranked = ordered_rank(rows, [F.col(k) for k in keys], "n", "test-keys", keys)
    assert ranked.columns == ["speaker_id", "n"] and [r["speaker_id"] for r in ranked.orderBy("n").collect()] == ["007", "7", "9", "10", "A", "b"]


def test_identity_ignores_order_and_sees_content(spark, utt):
    a = table_identity(utt).first()
    assert a == table_identity(utt.orderBy(F.desc("path")).repartition(3)).first()
    assert a != table_identity(utt.withColumn("path", F.concat("path", F.lit("x")))).first()


def test_numeric_aware_order_and_padding(spark):
    rows = spark.createDataFrame([(x,) for x in ("b", "10", " 7", "A", "2")], "s string")
    assert [r[0] for r in rows.orderBy(*text.numeric_aware(F.col("s"))).collect()] == ["2", " 7", "10", "A", "b"]
    assert rows.select(text.numbered("t-", F.lit(1234567))).first()[0] == "t-1234567"
    with pytest.raises(Exception):
        rows.select(canonical_pair(F.col("s"), F.col("s"))[0]).collect()


def _brute_genuine(rows, total):
    by = {}
    for s, p in rows:
        by.setdefault(s, []).append(p)
    d = lambda *x: hashlib.sha256("\x1f".join(map(str, (2026, *x))).encode()).hexdigest()
    ranked = sorted(by, key=lambda s: (d("genuine-quota", s), s))
    out = set()
    for k, s in enumerate(ranked):
        n = total // len(by) + (k < total % len(by))
        pairs = sorted((d("genuine", s, a, b), a, b) for a in by[s] for b in by[s] if a < b)
        out |= {(a, b) for _, a, b in pairs[:n]}
    return out


def test_genuine_trials_are_the_least_digests(spark, utt, monkeypatch):
    rows = [(r["speaker_id"], r["path"]) for r in utt.collect()]
    want = _brute_genuine(rows, 50)
    get = lambda: {(r[0], r[1]) for r in trials.genuine_trials(utt, 50).select("left_audio_path", "right_audio_path").collect()}
    assert get() == want
    monkeypatch.setattr(trials, "BLOCK", 3)  # several blocks for each speaker
    assert get() == want


def test_impostor_trials_are_balanced_and_valid(spark, utt):
    genuine, impostor = trials.genuine_trials(utt, 30), trials.impostor_trials(utt, 30)
    both = trials.with_trial_ids(genuine, impostor, "t-")
    contracts.require(trials.trial_violations(both, utt))
    counts = [r["impostor_endpoints"] for r in trials.participation(both).collect()]
    assert max(counts) - min(counts) <= 1
    ids = sorted(r["trial_id"] for r in both.collect())
    assert ids == [f"t-{k:05d}" for k in range(60)]
    broken = both.withColumn("target", F.when(F.col("trial_id") == "t-00000", 0).otherwise(F.col("target")))
    assert {"target_is_same_speaker", "balanced_targets"} <= {r["rule"] for r in trials.trial_violations(broken, utt).collect()}


@pytest.mark.parametrize("bucket_rows", [1, 7, 4096])
def test_neighbour_trials_lose_no_pair(spark, bucket_rows):
    rows = [(f"{s}", f"{s}/{k}.wav") for s in range(6) for k in range(3 + 8 * s)]
    place = lambda r: (hashlib.sha256(f"2026\x1fneighbour\x1f{r[1]}".encode()).hexdigest(), r[1])
    expected = Counter()
    for own in [[r for r in rows if r[0] == f"{s}"] for s in range(6)] + [rows]:
        order = sorted(own, key=place)
        for i, x in enumerate(order):
            for y in order[i + 1 : i + 4]:
                if own is not rows or x[0] != y[0]:
                    expected[(*sorted((x[1], y[1])), int(own is not rows))] += 1
    made = trials.neighbour_trials(spark.createDataFrame(rows, "speaker_id string, path string"), 3, bucket_rows=bucket_rows).collect()
    assert Counter((r["left_audio_path"], r["right_audio_path"], r["target"]) for r in made) == expected
    assert all(r["left_audio_path"].startswith(r["left_speaker_id"] + "/") and r["right_audio_path"].startswith(r["right_speaker_id"] + "/") for r in made)


def test_legacy_trials(spark, utt):
    made = trials.legacy_trials(utt, 4)
    rows = made.collect()
    assert sorted(r["trial_id"] for r in rows) == list(range(len(rows)))
    assert sum(r["target"] for r in rows) * 2 == len(rows)
    contracts.require(trials.trial_violations(made, utt))
    with pytest.raises(ValueError):
        trials.legacy_trials(spark.createDataFrame([("1", "1/a.wav")], "speaker_id string, path string"), 4)


def test_legacy_trials_add_impostor_rounds(spark):
    rows = [(s, f"{s}/{k}.wav") for s in "ab" for k in range(7)]
    utterances = spark.createDataFrame(rows, "speaker_id string, path string")
    made = trials.legacy_trials(utterances, 100)
    assert Counter(r["target"] for r in made.collect()) == {0: 42, 1: 42}
    contracts.require(trials.trial_violations(made, utterances))
    with pytest.raises(ValueError):
        trials.legacy_trials(utterances.where("speaker_id = 'a'"), 100)


def test_pk_batches(spark, utt):
    rows = batching.pk_batches(utt, 5, 2, 1).collect()
    by = {}
    for r in rows:
        by.setdefault(r["batch_id"], []).append(r)
    assert len(by) == -(-utt.count() // 10)
    for batch in by.values():
        assert sorted(r["slot"] for r in batch) == list(range(10))
        assert set(Counter(r["speaker_id"] for r in batch).values()) == {2} and len({r["path"] for r in batch}) == 10
    exposure = Counter(s for batch in by.values() for s in {r["speaker_id"] for r in batch})
    assert max(exposure.values()) - min(exposure.values()) <= 1
    again = {(r["batch_id"], r["slot"], r["path"]) for r in batching.pk_batches(utt.repartition(7), 5, 2, 1).collect()}
    assert again == {(r["batch_id"], r["slot"], r["path"]) for r in rows}
    with pytest.raises(Exception, match="P exceeds"):
        batching.pk_batches(utt, 13, 2, 1).collect()
    with pytest.raises(Exception, match="K exceeds"):
        batching.pk_batches(utt, 2, 6, 1).collect()


def test_round_robin_and_microbatches(spark, utt):
    batches = batching.pk_batches(utt, 4, 2, 1)
    rows = batching.microbatches(batches, 4).collect()
    assert all(r["distinct_speakers"] and r["n_rows"] == 4 for r in rows)
    with pytest.raises(ValueError):
        batching.resume(batches, 3, 3)


def test_trials_are_made_once_for_all_their_rules(spark):
    utterances = spark.createDataFrame([(s, f"{s}/{k}.wav") for s in "ab" for k in range(3)], "speaker_id string, path string")
    rows = [("1", "a/0.wav", "a/1.wav", "a", "a", 1), ("1", "a/0.wav", "b/1.wav", "a", "b", 0), (None, "b/0.wav", "b/1.wav", "b", "b", 1), (None, "b/0.wav", "a/0.wav", "b", "a", 0), ("2", "a/0.wav", "b/0.wav", "a", "b", 0)]
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(target):
        made.add(1)
        return target

    given = spark.createDataFrame(rows, "trial_id string, left_audio_path string, right_audio_path string, left_speaker_id string, right_speaker_id string, target int")
    found = trials.trial_violations(given.withColumn("target", counted("target")), utterances).collect()
    assert {(r["key"], r["detail"]) for r in found if r["rule"] == "unique_id"} == {("1", "2"), (None, "2")}
    assert {(r["key"], r["detail"]) for r in found if r["rule"] == "unique_pair"} == {("a/0.wav b/0.wav", "2")}
    assert made.value == len(rows)
