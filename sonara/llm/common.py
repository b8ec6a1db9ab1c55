"""Reading tables and shared scratch space of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_folder

__all__ = ["Scratch", "packed_rows", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_rows(rows: DataFrame, **more: Column) -> DataFrame:
    """Rows as one struct ``_row``, with further columns: no name of theirs can clash with one added later, and
    ``select("_row.*")`` gives them back."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), *[c.alias(k) for k, c in more.items()])
