"""The driver's tables in the shape that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One utterance for each event; the user is the speaker."""
    speaker = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(speaker.alias("speaker_id"), F.concat(speaker, F.lit("/"), F.col("event_id").cast("string"), F.lit(".wav")).alias("path"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One embedding for each vector; the label is the speaker."""
    speaker = F.col("label").cast("string")
    return table(spark, sf_dir, "embeddings").select(speaker.alias("speaker_id"), F.concat(speaker, F.lit("/"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), "vec_id", "label", "embedding")


def square(vector: Column) -> Column:
    """64 numbers as 8 rows of 8."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(vector, 8 * k + 1, F.lit(8)))
