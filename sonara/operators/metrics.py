"""Verification metrics: operating points, equal error rate, summaries.

Scores are accepted when they reach the threshold.  Everything is a fold over (score, target) rows: counts per distinct
score first, then running totals in score buckets, so no task sees all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Buckets of [-1, 1], or of a summary's range, for running totals.
_BUCKETS = 4096


def score_counts(scores: DataFrame) -> DataFrame:
    """Rows (threshold, p, n): genuine and impostor trials of every distinct score."""
    return scores.groupBy(F.col("score").cast("double").alias("threshold")).agg(F.count_if(F.col("target") == 1).alias("p"), F.count_if(F.col("target") == 0).alias("n"))


def _points(counts: DataFrame, *kept: str) -> DataFrame:
    """``counts`` (threshold, p, n and ``kept`` columns) as rows (threshold, far, frr, ``kept``)."""
    by_score = counts.withColumn("_bucket", F.floor((F.col("threshold") + 1) * (_BUCKETS / 2)))
    totals = by_score.groupBy("_bucket").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    whole = Window.partitionBy()
    offsets = totals.select(
        "_bucket", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"), F.sum("_p").over(whole).alias("_all_p"), F.sum("_n").over(whole).alias("_all_n")
    )
    inside = Window.partitionBy("_bucket").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    return by_score.join(F.broadcast(offsets), "_bucket").select(
        "threshold",
        ((F.col("_n0") + F.sum("n").over(inside)) / F.col("_all_n")).alias("far"),
        ((F.col("_all_p") - F.col("_p0") - F.sum("p").over(inside)) / F.col("_all_p")).alias("frr"),
        *kept,
    )


def _with_anchor(counts: DataFrame) -> DataFrame:
    anchor = counts.agg(F.max("threshold").alias("m")).where("m is not null").select(
        F.expr("cast(java_method('java.lang.Math', 'nextUp', m) as double)").alias("threshold"), F.lit(0.0).alias("far"), F.lit(1.0).alias("frr"), F.lit(True).alias("is_anchor")
    )
    return _points(counts).withColumn("is_anchor", F.lit(False)).unionByName(anchor)


def operating_points(scores: DataFrame) -> DataFrame:
    """Rows (threshold, far, frr, is_anchor) for every distinct score, and an anchor above the highest with far 0, frr 1.

    ``scores`` has ``score`` and ``target`` (1 genuine, 0 impostor).
    """
    return _with_anchor(Scratch(scores.sparkSession, "operating-points").keep(score_counts(scores), "counts"))


def empirical_errors(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows (threshold, far, frr) for given distinct thresholds: the rates of accepting scores from each on.

    Thresholds take their places among the distinct scores and are read off the running totals.
    """
    asked = thresholds.select(F.col("threshold").cast("double").alias("threshold"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    both = score_counts(scores).withColumn("asked", F.lit(False)).unionByName(asked)
    merged = both.groupBy("threshold").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("asked").alias("asked"))
    return _points(merged, "asked").where("asked").drop("asked")


def equal_error_rate(scores: DataFrame) -> DataFrame:
    """One row: n_genuine, n_impostor, eer, eer_threshold, empirical_threshold, empirical_far, empirical_frr, exact.

    The crossing of far and frr: an exact one at the highest threshold if there is any, else interpolated between the two
    points around it.  The empirical point is the one, but for the anchor, of least gap, then least mean error, then
    highest threshold.  One class alone, or a score that is not finite or outside [-1, 1], is an error.
    """
    checked = scores.select(
        F.when(F.isnan("score") | (F.abs("score") > 1.000001) | F.col("score").isNull() | ~F.col("target").isin(0, 1) | F.col("target").isNull(), F.raise_error(F.lit("scores lie in [-1, 1] and targets are 0 or 1"))).otherwise(F.col("score").cast("double")).alias("score"),
        "target",
    )
    by_score = Scratch(scores.sparkSession, "equal-error-rate").keep(score_counts(checked), "counts")  # trials are scored once
    points = _with_anchor(by_score).withColumn("gap", F.col("far") - F.col("frr"))
    # The gap rises as the threshold falls: the last point below zero and the first from zero on enclose the crossing.
    ends = points.agg(
        F.max(F.when(F.col("gap") == 0, F.struct("threshold", "far"))).alias("exact"),
        F.min(F.when(F.col("gap") < 0, F.struct("threshold", "far", "frr", "gap"))).alias("above"),
        F.max(F.when(F.col("gap") > 0, F.struct("threshold", "far", "frr", "gap"))).alias("below"),
        F.min(F.when(~F.col("is_anchor"), F.struct(F.abs("gap").alias("g"), ((F.col("far") + F.col("frr")) / 2).alias("e"), (-F.col("threshold")).alias("t"), F.col("far"), F.col("frr")))).alias("near"),
    )
    counts = by_score.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_genuine"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_impostor"))
    weight = -F.col("above.gap") / (F.col("below.gap") - F.col("above.gap"))
    between = lambda c: F.col(f"above.{c}") + weight * (F.col(f"below.{c}") - F.col(f"above.{c}"))
    found = F.col("exact").isNotNull()
    return counts.join(F.broadcast(ends)).select(
        F.when((F.col("n_genuine") == 0) | (F.col("n_impostor") == 0), F.raise_error(F.lit("both classes are needed"))).otherwise(F.col("n_genuine")).cast("long").alias("n_genuine"),
        "n_impostor",
        F.when(found, F.col("exact.far")).otherwise(between("far")).alias("eer"),
        F.when(found, F.col("exact.threshold")).otherwise(between("threshold")).alias("eer_threshold"),
        (-F.col("near.t")).alias("empirical_threshold"),
        F.col("near.far").alias("empirical_far"),
        F.col("near.frr").alias("empirical_frr"),
        found.alias("exact"),
    )


def _beside(left: DataFrame, right: DataFrame, on: tuple[str, ...], one_row: bool) -> DataFrame:
    """Join with null-safe keys; the right side's keys go."""
    other, rule = right.withColumnsRenamed({k: f"_r_{k}" for k in on}), F.lit(True)
    for k in on:
        rule &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(F.broadcast(other) if one_row else other, rule).drop(*[f"_r_{k}" for k in on])


def _ranked(rows: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Rows (``by``, _v, _c, _upto, count, minimum, mean, maximum): distinct values with how often they occur and how many
    of their group come up to them.

    Running totals are taken in buckets of each group's range, so no task holds the values of a group.
    """
    own = Scratch(rows.sparkSession, "summary").keep(rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_c")), "values")
    v, c = F.col("_v"), F.col("_c")
    basic = own.groupBy(*by).agg(F.sum("_c").alias("count"), F.min("_v").alias("minimum"), (F.sum(v * c) / F.sum(c)).alias("mean"), F.max("_v").alias("maximum"))
    near = _beside(own, basic, by, not by).withColumn("_bucket", F.coalesce(F.floor((v - F.col("minimum")) / F.nullif(F.col("maximum") - F.col("minimum"), F.lit(0.0)) * _BUCKETS), F.lit(0)))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    offsets = near.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_n")).select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return _beside(near, offsets, (*by, "_bucket"), not by).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))


def _quantile(q: float) -> Column:
    """Aggregate over ``_ranked`` rows: the interpolated quantile."""
    place = (F.max("count") - 1) * q
    at = lambda f: F.min(F.when(F.col("_upto") > f((F.col("count") - 1) * q), F.col("_v")))
    return at(F.floor) + (at(F.ceil) - at(F.floor)) * (place - F.floor(place))


def quantiles(rows: DataFrame, value: str, fractions: list[float], *by: str) -> DataFrame:
    """Rows (``by``, fraction, value): exact quantiles, interpolated between neighbours; null values do not count."""
    found = _ranked(rows, value, by).groupBy(*by).agg(F.array(*[F.struct(F.lit(q).alias("fraction"), _quantile(q).alias("value")) for q in fractions]).alias("q"))
    return found.select(*by, F.explode("q").alias("q")).select(*by, "q.*")


def numeric_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, minimum, mean, population standard deviation, exact interpolated quartiles and maximum per group.

    Null values do not count; null groups are groups.
    """
    v, c = F.col("_v"), F.col("_c")
    spread = F.sqrt(F.sum(c * (v - F.col("mean")) * (v - F.col("mean"))) / F.sum(c)).alias("standard_deviation")
    of = lambda x: F.max(x).alias(x)
    return _ranked(rows, value, by).groupBy(*by).agg(of("count"), of("minimum"), of("mean"), spread, *[_quantile(q).alias(name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))], of("maximum"))


def _differences(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (y, d): of equal keys the second vector and the entries' differences to the first, both in double precision."""
    double = lambda x: x.cast("double")
    pairs = a.select(key, F.col(vector).alias("_x")).join(b.select(key, F.transform(vector, double).alias("y")), key)
    return pairs.select("y", F.zip_with("_x", "y", lambda x, y: y - double(x)).alias("d"))


def max_difference(a: DataFrame, b: DataFrame, key: str, vector: str, relative: float = 1e-5, absolute: float = 1e-6) -> DataFrame:
    """One row (n, max_abs_diff, all_close) over the vectors of equal keys; of unequally long ones the common entries."""
    rows = _differences(a, b, key, vector).select(F.filter(F.zip_with("d", "y", lambda d, y: F.struct(F.abs(d).alias("d"), F.abs(y).alias("y"))), lambda e: e["d"].isNotNull()).alias("e"))
    close = F.forall("e", lambda e: e["d"] <= absolute + relative * e["y"])
    return rows.agg(F.coalesce(F.sum(F.size("e")), F.lit(0)).cast("long").alias("n"), F.max(F.array_max(F.transform("e", lambda e: e["d"]))).alias("max_abs_diff"), F.bool_and(close).alias("all_close"))


def norm_and_delta(before: DataFrame, after: DataFrame, key: str, vector: str) -> DataFrame:
    """One row (norm, max_delta, sum_delta, n_bad) of the change between two vector tables with equal keys."""
    rows = _differences(before, after, key, vector).select(F.filter("d", lambda d: d.isNotNull()).alias("d"))
    total = lambda f: F.aggregate("d", F.lit(0.0), lambda s, d: s + f(d))
    bad = F.size(F.filter("d", lambda d: F.isnan(d) | (F.abs(d) == float("inf"))))
    return rows.agg(F.sqrt(F.sum(total(lambda d: d * d))).alias("norm"), F.max(F.array_max(F.transform("d", F.abs))).alias("max_delta"), F.sum(total(F.abs)).alias("sum_delta"), F.coalesce(F.sum(bad), F.lit(0)).cast("long").alias("n_bad"))
