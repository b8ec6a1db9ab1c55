"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: More rounds than any graph that fits a cluster needs.
MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its greater neighbours to the least node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links itself and its lesser neighbours to the least of them; ``a > b`` in every link."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (a, b: long) but the least of each component.

    ``component`` is the least node that can be reached.  Loops and repeated links do no harm.  A round joins and
    aggregates the links alone and writes them to the scratch folder; no neighbourhood is ever gathered in one place.
    """
    current = scratch.keep(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        large = _large_star(current).distinct()
        after = scratch.keep(_small_star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct(), "links")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(current)
        current = after
        if seen == mark or not seen[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = seen
    raise RuntimeError("components did not settle")
