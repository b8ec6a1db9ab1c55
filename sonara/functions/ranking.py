"""Row numbers over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def digest_rank(rows: DataFrame, digest: str, *ties: str, name: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their 0-based place in the order of ``digest`` (hex), then ``ties``; within each ``by`` group if given.

    Digests are uniform, so their first three digits deal the rows evenly; the offsets of these buckets are 4096 numbers
    a group.  Those of a whole table are broadcast.  Those of groups are merged with the rows: Spark may size either for
    less than it is, as after an explode, and would send it to the driver.
    """
    keyed = rows.withColumn("_bucket", F.substring(F.col(digest), 1, 3))
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(digest, *ties)) - 1
    offsets = offsets.hint("merge") if by else F.broadcast(offsets)
    ranked = keyed.withColumn("_within", within).join(offsets, [*by, "_bucket"])
    return ranked.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_bucket", "_within", "_before")


def ordered_rank(rows: DataFrame, keys: list[Column], name: str = "rank", operator: str = "rank", helpers: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with their 0-based place in the order of ``keys``, which must be unique.

    Rows are range-partitioned, sorted and written once; each partition's count then gives the next one's offset.  A sort
    works out its expressions anew each time that it compares two rows, so keys that cost something are given as
    ``helpers``, columns that ``keys`` may name and that are dropped once the rows are sorted.
    """
    scratch, helpers = Scratch(rows.sparkSession, operator), helpers or {}
    keyed = rows.withColumns(helpers) if helpers else rows
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*helpers)
    place = F.monotonically_increasing_id()
    kept = scratch.keep(ordered.withColumns({"_part": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


#: Order values that are summed by one task.
STRETCH = 4096


def running_total(rows: DataFrame, value: Column, order: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their ``by`` group that come before them in ``order``.

    ``order`` holds whole numbers from 0, unique within a group.  Stretches of these are summed apart and then added up, so
    a task sees a stretch's rows, or a group's stretches, but never a whole group.
    """
    keyed = rows.withColumns({"_v": value.cast("long"), "_stretch": F.expr(f"`{order}` div {STRETCH}")})
    sums = keyed.groupBy(*by, "_stretch").agg(F.sum("_v").alias("_sum"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_stretch", F.coalesce(F.sum("_sum").over(before(*by).orderBy("_stretch")), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_v").over(before(*by, "_stretch").orderBy(order)), F.lit(0))
    return keyed.withColumn("_within", within).join(offsets, [*by, "_stretch"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_v", "_stretch", "_within", "_before")
