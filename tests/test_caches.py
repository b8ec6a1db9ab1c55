"""Feature caches, identities, artifacts, scalar formats and impostor rounds."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonara.functions import text
from sonara.operators import batching, caches, contracts, metrics, scoring, trials
from sonara.plans import package


def rules(found):
    return sorted((r["rule"], r["key"]) for r in found.collect())


def test_first_batch(spark):
    good = [[1.0] * 3] * 2
    rows = [(str(k), "train", good, k) for k in range(6)]
    make = lambda rows: spark.createDataFrame(rows, "relative_audio_path string, final_split string, fbank array<array<float>>, manifest_row_index long")
    assert rules(caches.first_batch_violations(make(rows), "train", shape=(2, 3))) == []
    rows[1] = ("1", "train", [[1.0] * 3], 1)
    rows[2] = ("2", "train", [[float("nan")] * 3] * 2, 2)
    rows[5] = ("5", "train", None, 5)  # beyond the first four
    assert rules(caches.first_batch_violations(make(rows), "train", shape=(2, 3))) == [("feature_shape", "1"), ("finite_features", "2")]
    assert rules(caches.first_batch_violations(make(rows[:2]), "train", shape=(2, 3))) == [("feature_shape", "1"), ("first_batch", "train")]


def test_plans(spark):
    of = lambda *states: caches.plan_state(spark.createDataFrame([(str(k), s) for k, s in enumerate(states)], "shard string, state string")).first()["plan"]
    assert of("missing", "missing") == "new" and of("valid", "missing") == "resume" and of("valid", "valid") == "complete"
    assert of("valid", "different") is None and of("valid", "unexpected") is None and of() == "new"


def test_inference_checks_its_function(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(70)], "k int, v array<float>").coalesce(1)
    seen = caches.infer(rows, lambda x: np.full((len(x), 1), len(x)), "k", "v", batch=32)
    assert sorted(r["embedding"][0] for r in seen.collect()) == [6.0] * 6 + [32.0] * 64
    for wrong in (lambda x: x[:-1], lambda x: x[:, 0], lambda x: x * np.inf):
        with pytest.raises(Exception, match="inference gave"):
            caches.infer(rows, wrong, "k", "v").collect()
    assert caches.infer(rows.limit(0), lambda x: x, "k", "v").collect() == []


def test_embeddings_are_reused_under_their_binding_alone(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), [float(k), 1.0]) for k in range(5)], "path string, v array<float>")
    double, root = (lambda x: 2 * x), f"{tmp_path}/e"
    make = lambda binding, f=double: package.saved_embeddings(rows, f, root, binding, 2, "path", "v")
    assert make("a").count() == 5
    assert sorted(r["embedding"][0] for r in make("a", lambda x: x / 0).collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]  # not computed again
    with pytest.raises(contracts.ContractError, match="binding"):
        make("b")


def test_checkpoints(spark, tmp_path):
    good = {"next_epoch": 1, "position": 3, "optimizer_steps": 13, "scheduler_steps": 13, "sampler_seed": 7, "sampler_epoch": 1, "configuration_sha256": "c", "final_test_accesses": 0, "patience": 2, "min_improvement": 1e-4}
    rows = lambda **more: spark.createDataFrame([{**good, **more}])
    check = lambda frame: {r for r, _ in rules(caches.checkpoint_violations(frame, 10, "c", 7))}
    assert check(rows()) == set()
    assert check(rows(position=4)) == {"cursor_steps"} and check(rows(scheduler_steps=2)) == {"scheduler_steps"} and check(rows(sampler_epoch=0)) == {"sampler_state"}
    assert check(rows(configuration_sha256="x", final_test_accesses=1, patience=3)) == {"configuration", "final_test_untouched", "stopping_rule"}
    assert check(rows(position=11, optimizer_steps=21, scheduler_steps=21)) == {"cursor_range"}
    package.save_checkpoint(rows(), f"{tmp_path}/c", 10, "c", 7)
    package.save_checkpoint(rows(position=5, optimizer_steps=15, scheduler_steps=15), f"{tmp_path}/c", 10, "c", 7)
    assert package.load_checkpoint(spark, f"{tmp_path}/c", 10, "c", 7).first()["position"] == 5
    with pytest.raises(contracts.ContractError):
        package.save_checkpoint(rows(position=4), f"{tmp_path}/c", 10, "c", 7)
    with pytest.raises(contracts.ContractError):
        package.load_checkpoint(spark, f"{tmp_path}/c", 10, "other", 7)


def test_numbers_as_text(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0, 0.1, 1e-4, 9.99e-5, -2.5e-7, 1e7, 12345678.9, 1e15, 1e16, 1e22, 0.30000000000000004, float("nan"), float("inf"), float("-inf")] + [rng.uniform(-1, 1) for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(text.shortest_float(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == [repr(x) for x in xs]
    words = [" 7 ", "+5", "01", "1_0", "12345678901234567890", "1__0", "_1", "x", None, "-3"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.parsed_int(F.col("w")).alias("i")).collect()
    assert [None if r["i"] is None else int(r["i"]) for r in got] == [7, 5, 1, 10, 12345678901234567890, None, None, None, None, -3]
    assert [r[0] for r in spark.createDataFrame([("Straße",), (None,)], "w string").select(text.casefolded(F.col("w"))).collect()] == ["strasse", None]


def test_numbers_as_text_are_the_shortest(spark):
    """Of these, versions of the JVM before 19 write a digit more; of the last ones, all versions do."""
    xs = [2e-3, 2.0**-44, 2.2250738585072014e-308, 2e23, 1.1e-322, 1.0000000000000001e-7 * 3, *[k / 100 * 1e-7 for k in range(1, 3000)], 5e-324, -1e-323]
    got = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select(text.shortest_float(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == [*map(repr, xs), None]


@pytest.mark.parametrize("speakers,utterances,total", [(2, 3, 5), (3, 4, 7), (5, 2, 9), (7, 3, 40), (4, 6, 30)])
def test_impostors_take_part_equally_and_never_twice(spark, speakers, utterances, total):
    rows = spark.createDataFrame([(f"s{s}", f"s{s}/{k}.wav") for s in range(speakers) for k in range(utterances)], "speaker_id string, path string")
    pairs = sorted(tuple(r)[:3] for r in trials.impostor_speaker_pairs(rows, total).collect())
    assert [p for p, _, _ in pairs] == list(range(total)) and all(a != b for _, a, b in pairs)
    counts = [sum(s in p[1:] for p in pairs) for s in {x for p in pairs for x in p[1:]}]
    assert max(counts) - min(counts) <= 1 and sum(counts) == 2 * total
    made = trials.impostor_trials(rows, total).collect()
    assert len({(r["left_audio_path"], r["right_audio_path"]) for r in made}) == len(made) == total
    assert all(r["left_audio_path"] < r["right_audio_path"] and r["left_audio_path"].startswith(r["left_speaker_id"] + "/") for r in made)
    assert {(min(a, b), max(a, b), p) for p, a, b in pairs} == {(min(r["left_speaker_id"], r["right_speaker_id"]), max(r["left_speaker_id"], r["right_speaker_id"]), r["position"]) for r in made}


def test_too_many_impostors_are_refused(spark):
    rows = spark.createDataFrame([(f"s{s}", f"s{s}/{k}.wav") for s in range(2) for k in range(2)], "speaker_id string, path string")
    with pytest.raises(ValueError, match="unseen"):
        trials.impostor_trials(rows, 5).collect()
    with pytest.raises(ValueError, match="two speakers"):
        trials.impostor_speaker_pairs(rows.where("speaker_id = 's0'"), 1)


def test_a_trial_without_an_embedding_is_an_error(spark):
    made = spark.createDataFrame([("a", "b", 1), ("a", "z", 0)], "left_audio_path string, right_audio_path string, target int")
    known = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "path string, embedding array<float>")
    with pytest.raises(Exception, match="no embedding of z"):
        scoring.score_trials(made, known).collect()
    assert scoring.score_trials(made.limit(1), known).first()["score"] == 1.0


def test_summaries_and_rates_against_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(0, 0.3, 500).clip(-1, 1), 3)
    targets = rng.integers(0, 2, 500)
    frame = spark.createDataFrame([(float(s), int(t)) for s, t in zip(values, targets)] + [(None, 1)], "score double, target int")
    for r in metrics.numeric_summary(frame, "score", "target").collect():
        own = values[targets == r["target"]]
        want = [len(own), own.min(), own.mean(), own.std(), *np.quantile(own, [0.25, 0.5, 0.75]), own.max()]
        assert [r[c] for c in ("count", "minimum", "mean", "standard_deviation", "q1", "median", "q3", "maximum")] == pytest.approx(want)
    grid = [-2.0, -0.5, 0.0, float(values[0]), 0.77, 2.0]
    for r in metrics.empirical_errors(frame.where("score is not null"), spark.createDataFrame([(x,) for x in grid], "threshold double")).collect():
        assert r["far"] == pytest.approx((values[targets == 0] >= r["threshold"]).mean()) and r["frr"] == pytest.approx((values[targets == 1] < r["threshold"]).mean())


def test_batches_are_fed_in_order(spark):
    rows = spark.createDataFrame([(f"p{k}", k % 3) for k in range(100)], "path string, label int")
    collated = batching.collate(batching.random_batches(rows, "path", 4, 1), rows, "label").repartition(7)

    def consume(fed):
        last = None
        for b in fed:
            yield {"batch_id": b["batch_id"], "before": last, "n": len(b["label"])}
            last = b["batch_id"]

    got = sorted(map(tuple, batching.feed(collated, consume, "batch_id long, before long, n int", 3).collect()))
    assert [b for b, _, _ in got] == list(range(25)) and all(n == 4 for _, _, n in got)
    assert sum(before is None for _, before, _ in got) == 3 and all(before in (None, b - 1) for b, before, _ in got)


def test_mixed_rows_are_not_collated(spark):
    rows = spark.createDataFrame([("a", 1, [1.0]), ("b", 2, [2.0]), ("c", None, [3.0]), ("d", 4, [4.0, 5.0])], "path string, label int, v array<double>")
    batch = lambda *paths: spark.createDataFrame([(0, k, p) for k, p in enumerate(paths)], "batch_id long, slot int, path string")
    assert tuple(batching.collate(batch("b", "a"), rows, "label", "v").first()) == (0, ["b", "a"], [2, 1], [[2.0], [1.0]])
    for paths, message in ((("a", "c"), "mixed values of label"), (("a", "d"), "mixed values of v"), (("a", "z"), "no row for z")):
        with pytest.raises(Exception, match=message):
            batching.collate(batch(*paths), rows, "label", "v").collect()


def test_caches_are_built_and_gone_on_with(spark, tmp_path):
    from sonara.plans import package
    from sonara.sources import packs

    manifest = spark.createDataFrame([(f"s{s}/{k}.wav", f"s{s}", s if s < 2 else -1, "train" if s < 2 else "validation") for s in range(3) for k in range(5)], "relative_audio_path string, speaker_id string, speaker_label int, final_split string")
    features = manifest.selectExpr("relative_audio_path", "array(array(1.0f, 2.0f)) as fbank")
    config, out = spark.range(1).selectExpr("4 as shard_size"), f"{tmp_path}/c"
    assert package.build_cache(manifest, features, config, out, (1, 2), 4) == {"state": "new", "total": 5, "reused": 0, "written": 5}
    assert package.build_cache(manifest, features, config, out, (1, 2), 4) == {"state": "complete", "total": 5, "reused": 5, "written": 0}
    assert packs.read(spark, f"{out}/shards").count() == 15
    for bad, message in ((features.limit(3), "missing_features"), (features.selectExpr("relative_audio_path", "array(array(1.0f)) as fbank"), "feature_shape")):
        with pytest.raises(Exception, match=message):
            package.build_cache(manifest, bad, config, f"{tmp_path}/d", (1, 2), 4)
    with pytest.raises(ValueError, match="differs"):
        package.build_cache(manifest, features, spark.range(1).selectExpr("5 as shard_size"), out, (1, 2), 4)


def test_jobs_from_the_command_line(spark, tmp_path):
    from sonara.plans.__main__ import main

    rows = [(f"s{s}/{k}.wav", f"s{s}") for s in range(4) for k in range(4)]
    spark.createDataFrame(rows, "relative_audio_path string, speaker_id string").write.parquet(f"{tmp_path}/m")
    main(["trials", f"{tmp_path}/m", f"{tmp_path}/t", "--total", "8"])
    main(["trials", f"{tmp_path}/m", f"{tmp_path}/t", "--total", "8"])
    assert spark.read.parquet(f"{tmp_path}/t/trials").count() == 16
    rng = np.random.default_rng(1)
    spark.createDataFrame([(p, rng.normal(0, 1, 3).tolist()) for p, _ in rows], "path string, embedding array<float>").write.parquet(f"{tmp_path}/e")
    job = [f"{tmp_path}/t/trials", f"{tmp_path}/e", f"{tmp_path}/r"]
    main(["final", *job, "--check"])
    main(["final", *job, "--run"])
    assert spark.read.parquet(f"{tmp_path}/r").count() == 1
    with pytest.raises(ValueError, match="done before"):
        main(["final", *job, "--run"])
    with pytest.raises(SystemExit):
        main(["final", *job])
