"""Quality and toxicity on planted data, judged on held-out rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonara.llm import mil_toxicity, pu_quality, samples
from sonara.llm.common import Scratch

from .conftest import prose

BAD = ["rotzak", "rotzig", "blarg", "blargen"]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        words = prose(rng, rng.randrange(60, 150))
        low, toxic = i % 5 == 0, i % 3 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        if low:
            words = [w + rng.choice(["###", "%%%", "|"]) for w in words]
        rows.append((i, " ".join(words), "clash"))
        if i % 10:
            labels.append((i, 0 if low else 1, int(toxic)))
    rows += [(5000, None, ""), (5001, "", ""), (None, "text without an id", ""), (7, "second text of an id", "")]
    labels += [(5001, None, None), (None, 1, 1), (9_999_999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, y string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _accuracy(rows, truth):
    own = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(own) > 200
    return sum(r["predicted"] == truth[r["doc_id"]] for r in own) / len(own)


def _shape(rows):
    assert len(rows) == 1204 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows if r["doc_id"] is not None)


def test_quality_from_positives_alone(planted):
    docs, labels = planted
    # Only the labels of held-out rows and the prior could tell; negatives never enter the risk.
    model = pu_quality.train(docs, labels)
    rows = pu_quality.score(docs, model).collect()
    _shape(rows)
    assert _accuracy(rows, {i: int(i % 5 != 0) for i in range(1200) if i != 7}) > 0.95


def test_toxicity_from_document_labels(planted):
    docs, labels = planted
    model = mil_toxicity.train(docs, labels)
    rows = mil_toxicity.score(docs, model).collect()
    _shape(rows)
    assert _accuracy(rows, {i: int(i % 3 == 0) for i in range(1200) if i != 7}) > 0.95
    assert all(r["score"] == 0 and r["worst_sentence"] == -1 for r in rows if r["doc_id"] in (5000, 5001))
    found = mil_toxicity.offending_sentences(docs, model).collect()
    assert found and sum(any(b in r["sentence"] for b in BAD) for r in found) > 0.95 * len(found)
    kept = mil_toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    odd = docs.selectExpr("*", "text as _text", "1 as `a.b`", "'h' as HOST", "2 as _row")
    assert mil_toxicity.drop_toxic(odd, model).columns == odd.columns and mil_toxicity.drop_toxic(odd, model).count() == kept.count()
    assert kept.count() == sum(r["score"] < 0.3 for r in rows)


def test_held_out_labels_are_never_learnt(spark, planted):
    docs, labels = planted
    lies = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in mil_toxicity.score(docs, mil_toxicity.train(docs, y)).collect() if r["doc_id"] not in (None, 7)} for y in (labels, lies))
    assert a == pytest.approx(b)


@pytest.mark.parametrize("module", [pu_quality, mil_toxicity])
def test_no_rows_and_no_labels(spark, planted, nothing, module):
    docs, labels = planted
    empty = labels.limit(0)
    assert module.score(nothing, module.train(nothing, empty)).collect() == []
    some = docs.limit(3)
    assert len(module.score(some, module.train(some, empty)).collect()) == 3


def test_risk_and_gradient_against_plain_loops():
    rng = np.random.default_rng(3)
    soft = lambda z: float(np.log1p(np.exp(-abs(z))) + max(z, 0.0))

    def plain(w, positive, unlabelled, prior):
        z = lambda x: sum(max(0.0, float(x @ w[0][:, k] + w[1][k])) * w[2][k] for k in range(len(w[1]))) + w[3][0]
        mean = lambda rows, sign: sum(soft(sign * z(x)) for x in rows) / len(rows)
        bracket = mean(unlabelled, 1) - prior * mean(positive, 1)
        return prior * mean(positive, -1), bracket

    for prior in (0.3, 0.95):
        for _ in range(4):
            w = [rng.normal(0, 1, (3, 4)), rng.normal(0, 1, 4), rng.normal(0, 1, 4), rng.normal(0, 1, 1)]
            p, u = rng.normal(0.5, 1, (7, 3)), rng.normal(0, 1, (9, 3))
            risk, grads = pu_quality.nnpu_step(w, p, u, prior)
            own, bracket = plain(w, p, u, prior)
            assert risk == pytest.approx(own + max(0.0, bracket))
            target = (lambda: -plain(w, p, u, prior)[1]) if bracket < 0 else (lambda: sum(plain(w, p, u, prior)))
            for i, g in enumerate(grads):
                for at in np.ndindex(w[i].shape):
                    w[i][at] += 1e-6
                    up = target()
                    w[i][at] -= 2e-6
                    down = target()
                    w[i][at] += 1e-6
                    assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_noisy_or_against_plain_loops():
    rng = np.random.default_rng(4)
    for _ in range(10):
        w, bias = rng.normal(0, 1, 5), float(rng.normal(-1, 1))
        sentences = [[rng.integers(0, 5, rng.integers(0, 4)).tolist() for _ in range(rng.integers(0, 5))] for _ in range(6)]
        bags = []
        for doc in sentences:
            full = [x for x in doc if x]
            bags.append(mil_toxicity.Bag(len(doc), np.array([f for x in full for f in x], np.int32), np.array([k for k, x in enumerate(full) for _ in x], np.int32)))
        y, weight = rng.integers(0, 2, 6), rng.random(6)

        def plain(w, bias):
            total = 0.0
            for doc, label, k in zip(sentences, y, weight):
                clean = 1.0
                for x in doc:
                    clean *= 1 - 1 / (1 + np.exp(-(sum(w[f] for f in x) + bias)))
                total -= k * np.log(max(1 - clean, 1e-9) if label else clean)
            return total

        loss, by_weight, by_bias = mil_toxicity.noisy_or_step(w, bias, mil_toxicity._Joined(bags), y, weight)
        assert loss == pytest.approx(plain(w, bias))
        if any(label and not doc for doc, label in zip(sentences, y)):
            continue  # the loss is cut off there and has no slope
        for k in range(5):
            step = 1e-6 * np.eye(5)[k]
            assert by_weight[k] == pytest.approx((plain(w + step, bias) - plain(w - step, bias)) / 2e-6, abs=1e-4)
        assert by_bias == pytest.approx((plain(w, bias + 1e-6) - plain(w, bias - 1e-6)) / 2e-6, abs=1e-4)


def test_scored_documents_are_the_noisy_or_of_their_sentences(planted):
    docs, labels = planted
    model = mil_toxicity.train(docs, labels)
    by_sentence = {}
    for r in mil_toxicity.offending_sentences(docs, model, threshold=0.0).collect():
        by_sentence.setdefault(r["doc_id"], []).append(r["score"])
    for r in mil_toxicity.score(docs, model).collect():
        if r["doc_id"] not in (None, 7):
            assert r["score"] == pytest.approx(1 - np.prod([1 - p for p in by_sentence.get(r["doc_id"], [])]), abs=1e-6)


def test_ties_and_a_very_long_text(spark, planted):
    docs, labels = planted
    rng = random.Random(3)
    long = " ".join(prose(rng, 120_000))
    rows = spark.createDataFrame([(1, long), (2, long), (3, long + " " + BAD[0] + "."), (4, None), (5, "")], "doc_id long, text string")
    for module in (pu_quality, mil_toxicity):
        got = {r["doc_id"]: r for r in module.score(rows, module.train(docs, labels)).collect()}
        assert len(got) == 5 and got[1]["score"] == got[2]["score"] and got[4]["score"] == got[5]["score"] and all(0 <= r["score"] <= 1 for r in got.values())


def test_samples_are_bounded_by_rows(spark):
    """An id that most rows have gives one text, the same one whatever the order of the rows."""
    docs = spark.range(60_000).selectExpr("if(id < 59000, 7, id) as doc_id", "concat('text ', id % 5000) as text")
    chosen = spark.createDataFrame([(k, k % 2) for k in [7, *range(59_000, 59_100), 1]], "_id long, y int")
    a, b = (sorted(map(tuple, samples.sampled_texts(d, chosen, 1000, Scratch(spark, "test-samples")).collect())) for d in (docs, docs.orderBy("text").repartition(3)))
    assert a == b and len(a) == 101
    with pytest.raises(ValueError, match="bound"):
        samples.sampled_texts(docs, docs.selectExpr("doc_id as _id", "1 as y"), 1000, Scratch(spark, "test-samples"))


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_prior_from_positives_and_unlabelled_rows(share):
    rng = np.random.default_rng(int(share * 100))
    draw = lambda n, at: rng.normal(at, 1, (n, 6))
    n = 6000
    positive, unlabelled = draw(3000, 1.5), np.concatenate([draw(int(n * share), 1.5), draw(n - int(n * share), -1.5)])
    assert abs(pu_quality.estimate_prior(positive, unlabelled) - share) < 0.03
    assert pu_quality.estimate_prior(positive[:1], unlabelled[:1]) == 0.5


def test_discriminator_gradient_against_differences():
    rng = np.random.default_rng(8)
    w = [rng.normal(0, 1, (3, 4)), rng.normal(0, 1, 4), rng.normal(0, 1, 4), rng.normal(0, 1, 1)]
    p, u = rng.normal(0.5, 1, (7, 3)), rng.normal(0, 1, (9, 3))
    _, grads = pu_quality.discriminator_step(w, p, u)
    for i, g in enumerate(grads):
        for at in np.ndindex(w[i].shape):
            loss = []
            for step in (1e-6, -1e-6):
                w[i][at] += step
                loss.append(pu_quality.discriminator_step(w, p, u)[0])
                w[i][at] -= step
            assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-5)
