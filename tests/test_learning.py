"""Margins, losses, schedules, features and scores."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonara.operators import contracts, features, learning, scoring


def test_margin_changes_only_the_target(spark):
    rows = spark.createDataFrame([(0.5, True), (0.5, False), (-0.99, True)], "c double, t boolean")
    a, b, c = (r[0] for r in rows.select(learning.margin_logit(F.col("c"), F.col("t"))).collect())
    assert a == pytest.approx(30 * math.cos(math.acos(0.5) + 0.2)) and b == pytest.approx(15) and c == pytest.approx(30 * (-0.99 - math.sin(math.pi - 0.2) * 0.2))
    zero = rows.select(learning.margin_logit(F.col("c"), F.col("t"), margin=0.0)).first()[0]
    assert zero == pytest.approx(15)


@pytest.mark.parametrize("limit", [4_000_000, 6, 2])
def test_cross_entropy_by_class_blocks(spark, limit):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(9, 2)), rng.normal(size=(5, 2))
    rows = spark.createDataFrame([(k, k % 6, v.tolist()) for k, v in enumerate(x)], "id int, label int, embedding array<double>")
    heads = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(w)], "class int, weights array<double>")
    assert len(learning.class_blocks(heads, limit)) == {4_000_000: 1, 6: 2, 2: 5}[limit]
    cos = x @ w.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(w, axis=1)
    logits = 30 * cos
    got = {r["id"]: r["loss"] for r in learning.cross_entropy(rows, heads, "id", lambda c, _: learning.softmax_logit(c), limit=limit).collect()}
    for k in range(9):
        want = None if k % 6 == 5 else np.log(np.exp(logits[k]).sum()) - logits[k, k % 6]
        assert got[k] is None if want is None else got[k] == pytest.approx(want, rel=1e-9)
    each = learning.cosines_to_classes(rows, heads, "id", limit=limit).collect()
    assert {(r["id"], r["class"]): pytest.approx(r["cos"]) for r in each} == {(k, c): cos[k, c] for k in range(9) for c in range(5)}
    with pytest.raises(ValueError, match="one class"):
        learning.class_blocks(heads, 1)


def test_cross_entropy_moves_no_rows(spark):
    rows = spark.range(50).selectExpr("id", "id % 3 as label", "array(1d, cast(id as double)) as embedding")
    heads = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(3)], "class int, weights array<double>")
    plan = learning.cross_entropy(rows, heads, "id", learning.margin_logit)._jdf.queryExecution().executedPlan().toString()
    left = plan[: plan.index("BroadcastExchange")]
    assert "Exchange" not in left and "BroadcastNestedLoopJoin" in left


@pytest.mark.parametrize("by", [(), ("g",), ("g", "h")])
def test_moments(spark, by):
    rng = np.random.default_rng(5)
    rows = [(int(k), ["a", None, "b"][k % 3], int(k % 2), (rng.normal(size=4) + 1e6).tolist()) for k in range(200)]
    frame = spark.createDataFrame([*rows, (-1, "a", 0, None)], "id int, g string, h int, v array<double>").repartition(7)
    for r in features.moments(frame, "v", *by).collect():
        own = np.array([v for _, g, h, v in rows if all({"g": g, "h": h}[c] == r[c] for c in by)])
        assert r["n"] == len(own)
        assert np.allclose(r["mean"], own.mean(0), rtol=1e-14) and np.allclose(r["m2"], ((own - own.mean(0)) ** 2).sum(0), rtol=1e-6)
    normal = np.array([r["normalized"] for r in features.mean_var_norm(frame.where("v is not null"), "v").collect()])
    assert normal.shape == (200, 4) and np.allclose(normal.mean(0), 0, atol=1e-6) and np.allclose(normal.std(0), 1, atol=1e-6)


def test_moments_of_a_common_group_and_of_nothing(spark):
    frame = spark.range(20000, numPartitions=80).selectExpr("if(id % 3 = 0, id, 7) as g", "array(cast(id as double), 1d) as v")
    found = features.moments(frame, "v", "g")
    assert found.where("g = 7").first()["n"] == 13333 - 1 + 1 and found.count() == 6668
    assert features.moments(frame.limit(0), "v", "g").collect() == []
    with pytest.raises(Exception, match="different lengths"):
        features.moments(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "g int, v array<double>"), "v", "g").collect()


def test_schedule(spark):
    rows = {r["step"]: r["factor"] for r in learning.cosine_learning_rate(spark.range(11).withColumnRenamed("id", "step"), 10).collect()}
    assert rows[0] == 1 and rows[10] == pytest.approx(0.1) and rows[5] == pytest.approx(0.55)
    with pytest.raises(Exception, match="beyond"):
        learning.cosine_learning_rate(spark.range(12).withColumnRenamed("id", "step"), 10).collect()


def test_early_stopping(spark):
    rows = [(k, v) for k, v in enumerate([0.5, 0.4, 0.39995, 0.39992, 0.1])]
    r = learning.early_stopping(spark.createDataFrame(rows, "epoch int, value double")).first()
    assert (r["best"], r["best_epoch"], r["stopped_epoch"], r["epochs_run"]) == (0.4, 1, 3, 4)


def test_scores(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "path string, embedding array<float>")
    trials = spark.createDataFrame([("a", "c"), ("a", "b"), ("a", "z")], "left_audio_path string, right_audio_path string")
    got = {r["right_audio_path"]: r["score"] for r in scoring.score_trials(trials, vectors).collect()}
    assert got == {"c": 0.0, "b": 1.0, "z": 0.0}
    broken = trials.unionByName(spark.createDataFrame([("a", "q")], trials.schema))
    assert [r["rule"] for r in scoring.embedding_violations(broken, vectors.unionByName(vectors.limit(1))).collect()] == ["unique_embedding", "missing_embedding"]


def test_fbank_shape_and_tone(spark):
    t = np.arange(48000) / 16000
    wave = np.sin(2 * np.pi * 1000 * t).astype(np.float32)
    rows = spark.createDataFrame([("a", wave.tolist())], "p string, w array<float>")
    out = np.array(rows.select(features.fbank_udf("w")).first()[0])
    assert out.shape == (301, 80) and np.isfinite(out).all()
    centres = features.mel_filters()[out[150].argmax()].argmax() * 40
    assert abs(centres - 1000) < 80
    norm = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "f array<array<float>>").select(features.sentence_norm(F.col("f"))).first()[0]
    assert norm == [[-1.0, -2.0], [1.0, 2.0]]


def test_feature_contract(spark):
    rows = [("ok", [[0.0, 1.0]]), ("nan", [[float("nan"), 1.0]]), ("short", [[0.0]])]
    found = contracts.feature_violations(spark.createDataFrame(rows, "relative_audio_path string, fbank array<array<float>>"), (1, 2)).collect()
    assert {(r["rule"], r["key"]) for r in found} == {("finite_features", "nan"), ("feature_shape", "short")}
