"""Equal error rate and summaries against fixed cases and brute force."""

from __future__ import annotations

import math
import random

import pytest

from sonara.operators import metrics


def frame(spark, scores, targets):
    return spark.createDataFrame(list(zip(map(float, scores), targets)), "score double, target int")


def rate(spark, scores, targets):
    return metrics.equal_error_rate(frame(spark, scores, targets)).first()


def brute(scores, targets):
    """All thresholds one by one."""
    top = math.nextafter(max(scores), math.inf)
    genuine, impostor = ([s for s, t in zip(scores, targets) if t == k] for k in (1, 0))
    points = [(t, sum(s >= t for s in impostor) / len(impostor), sum(s < t for s in genuine) / len(genuine)) for t in [top, *sorted(set(scores), reverse=True)]]
    eer = next((far for _, far, frr in points if far == frr), None)
    for (_, f1, r1), (_, f2, r2) in zip(points, points[1:]):
        if eer is None and f1 - r1 < 0 < f2 - r2:
            eer = f1 + (r1 - f1) / ((f2 - r2) - (f1 - r1)) * (f2 - f1)
    near = min(points[1:], key=lambda p: (abs(p[1] - p[2]), (p[1] + p[2]) / 2, -p[0]))
    return eer, near


def test_perfect_separation(spark):
    r = rate(spark, [0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0])
    assert r["eer"] == 0 and r["empirical_far"] == 0 and r["empirical_frr"] == 0


def test_exact_crossing_whatever_the_order(spark):
    a = rate(spark, [0.9, 0.4, 0.6, 0.1], [1, 1, 0, 0])
    b = rate(spark, [0.1, 0.6, 0.4, 0.9], [0, 0, 1, 1])
    assert a == b and a["eer"] == 0.5 and a["exact"]


def test_interpolated_crossing(spark):
    r = rate(spark, [0.9, 0.6, 0.8, 0.7, 0.1], [1, 1, 0, 0, 0])
    assert r["eer"] == pytest.approx(0.5) and r["eer_threshold"] == pytest.approx(0.75) and not r["exact"]


def test_all_ties(spark):
    assert rate(spark, [0.5] * 4, [1, 0, 1, 0])["eer"] == 0.5


@pytest.mark.parametrize("scores,targets", [([0.1, 0.2], [1, 1]), ([math.nan, 0.2], [1, 0]), ([math.inf, 0.2], [1, 0]), ([0.1, 0.2], [2, 0]), ([1.01, 0.2], [1, 0])])
def test_invalid(spark, scores, targets):
    with pytest.raises(Exception):
        rate(spark, scores, targets)


def test_random_cases_against_brute_force(spark):
    rng = random.Random(11)
    for _ in range(6):
        n = rng.randint(4, 19)
        scores = [rng.choice([-0.8, -0.2, 0.0, 0.2, 0.8]) for _ in range(n)]
        targets = [1, 0] + [rng.randint(0, 1) for _ in range(n - 2)]
        r, (eer, near) = rate(spark, scores, targets), brute(scores, targets)
        assert r["eer"] == pytest.approx(eer, abs=1e-12)
        assert (r["empirical_threshold"], r["empirical_far"], r["empirical_frr"]) == pytest.approx(near)


def test_summary(spark):
    r = metrics.numeric_summary(frame(spark, [0.1, 0.2, 0.3], [1, 1, 1]), "score").first()
    assert r["count"] == 3 and r["median"] == pytest.approx(0.2) and r["standard_deviation"] == pytest.approx(math.sqrt(2 / 300))
