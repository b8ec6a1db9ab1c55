"""The closed-form parts of margin-softmax training."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ordered_rank
from ..functions.vectors import cosine, l2_normalize
from ..scratch import Scratch

#: Fixed values of the head.
SCALE, MARGIN, CLAMP = 30.0, 0.2, 1e-7
#: Weights, classes times dimensions, that are broadcast at once.
MAX_WEIGHTS = 4_000_000


def class_centroids(embeddings: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Rows (class, weights): unit vectors along the classes' mean embeddings, whatever their length."""
    longest = embeddings.agg(F.max(F.size(vector))).first()[0] or 1
    means = embeddings.groupBy(F.col(label).alias("class")).agg(*[F.avg(F.get(F.col(vector), k).cast("double")).alias(f"m{k}") for k in range(longest)], F.max(F.size(vector)).alias("_length"))
    return means.select("class", l2_normalize(F.slice(F.array(*[F.col(f"m{k}") for k in range(longest)]), 1, F.col("_length"))).alias("weights"))


def class_blocks(centroids: DataFrame, limit: int = MAX_WEIGHTS) -> list[DataFrame]:
    """The classes in blocks of at most ``limit`` weights, each one row (heads: array of (class, weights)) to broadcast."""
    n, longest = centroids.agg(F.count("*"), F.coalesce(F.max(F.size("weights")), F.lit(1))).first()
    if longest > limit:
        raise ValueError("the weights of one class are too large to broadcast")
    size = max(1, limit // max(1, longest))
    ranked = ordered_rank(centroids.select("class", "weights"), [F.col("class")], "_n", "class-blocks") if n > size else centroids.withColumn("_n", F.lit(0))
    heads = F.sort_array(F.collect_list(F.struct("class", "weights"))).alias("heads")
    return [ranked.where(F.expr(f"_n div {size} = {k}")).agg(heads) for k in range(-(-n // size))]


def cosines_to_classes(embeddings: DataFrame, centroids: DataFrame, key: str, label: str = "label", vector: str = "embedding", limit: int = MAX_WEIGHTS) -> DataFrame:
    """Rows (key, label, class, cos) for every row and class, by blocks of classes of at most ``limit`` weights."""
    rows = embeddings.select(key, label, vector)
    parts = [rows.join(F.broadcast(heads)).select(key, label, vector, F.explode("heads").alias("h")) for heads in class_blocks(centroids, limit)]
    each = reduce(DataFrame.unionByName, parts) if parts else rows.withColumn("h", F.lit(None).cast(f"struct<class:{dict(centroids.dtypes)['class']},weights:array<double>>")).limit(0)
    return each.select(key, label, F.col("h.class").alias("class"), cosine(F.col(vector), F.col("h.weights")).alias("cos"))


def softmax_logit(cos: Column, scale: float = SCALE) -> Column:
    return F.lit(scale) * F.least(F.greatest(cos, F.lit(CLAMP - 1)), F.lit(1 - CLAMP))


def margin_logit(cos: Column, is_target: Column, scale: float = SCALE, margin: float = MARGIN) -> Column:
    """Additive angular margin on the target class; past the point where the angle would wrap, a linear penalty."""
    c = F.least(F.greatest(cos, F.lit(CLAMP - 1)), F.lit(1 - CLAMP))
    turned = c * math.cos(margin) - F.sqrt(1 - c * c) * math.sin(margin)
    target = F.when(c > math.cos(math.pi - margin), turned).otherwise(c - math.sin(math.pi - margin) * margin)
    return F.lit(scale) * F.when(is_target, target).otherwise(c)


#: Blocks whose joins stand in one plan.
BLOCKS_IN_PLAN = 8


def cross_entropy(embeddings: DataFrame, centroids: DataFrame, key: str, logit: Callable[[Column, Column], Column], label: str = "label", vector: str = "embedding", limit: int = MAX_WEIGHTS) -> DataFrame:
    """Rows (key, loss): minus the log softmax of each row's target class, ``logit`` of (cosine, whether it is the target).

    No table of rows and classes is made and no row is shuffled: each block of classes (``class_blocks``) is broadcast in
    turn, and what a row carries on is the greatest logit so far, the sum of exponentials below it and the target's logit.
    A row whose label is no class has a null loss.
    """
    scratch = Scratch(embeddings.sparkSession, "cross-entropy")
    rows = embeddings.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_v"), F.lit(-math.inf).alias("_m"), F.lit(0.0).alias("_s"), F.lit(None).cast("double").alias("_t"))
    for k, heads in enumerate(class_blocks(centroids, limit)):
        each = F.transform("heads", lambda h: F.struct((h["class"] == F.col("_label")).alias("own"), logit(cosine(F.col("_v"), h["weights"]), h["class"] == F.col("_label")).alias("l")))
        seen = rows.join(F.broadcast(heads)).withColumn("_h", each).withColumn("_p", F.greatest("_m", F.array_max(F.col("_h.l"))))
        total = F.aggregate("_h", F.col("_s") * F.exp(F.col("_m") - F.col("_p")), lambda s, h: s + F.exp(h["l"] - F.col("_p")))
        target = F.coalesce(F.get(F.filter("_h", lambda h: h["own"]), F.lit(0))["l"], F.col("_t"))
        rows = seen.select("_key", "_label", "_v", F.col("_p").alias("_m"), total.alias("_s"), target.alias("_t"))
        if (k + 1) % BLOCKS_IN_PLAN == 0:
            rows = scratch.keep(rows, "blocks")
    return rows.select(F.col("_key").alias(key), (F.log("_s") + F.col("_m") - F.col("_t")).alias("loss"))


def cosine_learning_rate(steps: DataFrame, horizon: int, base: float = 1e-3, floor: float = 0.1) -> DataFrame:
    """Rows (step, factor, learning_rate) for steps 0 to ``horizon``; a later step is an error."""
    s = F.when(F.col("step") > horizon, F.raise_error(F.lit("the step lies beyond the schedule"))).otherwise(F.col("step"))
    factor = F.lit(floor) + F.lit(1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), s / F.lit(float(max(1, horizon))))))
    return steps.select("step", factor.alias("factor")).withColumn("learning_rate", F.lit(base) * F.col("factor"))


def early_stopping(epochs: DataFrame, min_delta: float = 1e-4, patience: int = 2, *by: str) -> DataFrame:
    """Rows (``by``, best, best_epoch, stopped_epoch, epochs_run): a fold over each history in epoch order.

    An epoch improves if its ``value`` is less than the best by more than ``min_delta``; after ``patience`` epochs in a row
    without improvement training stops, and later epochs do not count.
    """
    history = epochs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("value").cast("double").alias("value")))).alias("h"))
    start = F.struct(F.lit(math.inf).alias("best"), F.lit(-1).alias("best_epoch"), F.lit(0).alias("bad"), F.lit(-1).alias("stopped"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        better = x["value"] < s["best"] - min_delta
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        on = F.struct(
            F.when(better, x["value"]).otherwise(s["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"), bad.alias("bad"), F.when(bad >= patience, x["epoch"]).otherwise(F.lit(-1)).alias("stopped"), (s["n"] + 1).alias("n")
        )
        return F.when(s["stopped"] >= 0, s).otherwise(on)

    folded = history.select(*by, F.aggregate("h", start, step).alias("s"))
    return folded.select(*by, F.col("s.best").alias("best"), F.col("s.best_epoch").alias("best_epoch"), F.col("s.stopped").alias("stopped_epoch"), F.col("s.n").alias("epochs_run"))


def generalization_gap(test: DataFrame, validation: DataFrame) -> DataFrame:
    """One row (gap): the test's equal error rate less the validation's."""
    return test.select(F.col("eer").alias("_t")).join(F.broadcast(validation.select(F.col("eer").alias("_v")))).select((F.col("_t") - F.col("_v")).alias("gap"))
