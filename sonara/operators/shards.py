"""Fixed-size shards: positions, index, payloads, alignment and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import ordered_rank
from ..functions.text import numbered, numeric_aware_columns
from .contracts import all_of, duplicates, violations

#: Rows of a shard.
SHARD_SIZE = 512


def feature_index(manifest: DataFrame, size: int = SHARD_SIZE) -> DataFrame:
    """The manifest with ``manifest_row_index`` (within its split, by speaker in numeric-aware order, then path),
    ``shard_path`` and ``within_shard_index``."""
    keys = numeric_aware_columns(F.col("speaker_id"))
    ranked = ordered_rank(manifest, [F.col(k) for k in ("final_split", *keys, "relative_audio_path")], "_n", "feature-index", keys)
    first = ranked.groupBy("final_split").agg(F.min("_n").alias("_first"))
    placed = ranked.join(F.broadcast(first), "final_split").withColumn("manifest_row_index", F.col("_n") - F.col("_first"))
    shard = F.expr(f"manifest_row_index div {size}")
    return placed.select(
        "relative_audio_path", "speaker_id", "speaker_label", "final_split", "manifest_row_index",
        F.concat(F.col("final_split"), numbered("/shard_", shard, tail=".pt")).alias("shard_path"), (F.col("manifest_row_index") % size).cast("int").alias("within_shard_index"),
    )


def shard_totals(index: DataFrame) -> DataFrame:
    return index.groupBy("final_split", "shard_path").agg(F.count("*").alias("n_rows"), F.countDistinct("speaker_id").alias("n_speakers"), F.min("within_shard_index").alias("first"), F.max("within_shard_index").alias("last"))


def shard_payloads(index: DataFrame, features: DataFrame) -> DataFrame:
    """One row per shard with aligned arrays in offset order; ``features`` has relative_audio_path and ``fbank``."""
    row = F.struct("within_shard_index", "relative_audio_path", "speaker_id", "speaker_label", "fbank")
    packed = index.join(features, "relative_audio_path").groupBy("final_split", "shard_path").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return packed.select("final_split", "shard_path", F.col("r.relative_audio_path").alias("relative_audio_paths"), F.col("r.speaker_id").alias("speaker_ids"), F.col("r.speaker_label").alias("speaker_labels"), F.col("r.fbank").alias("features"))


def alignment_violations(index: DataFrame, size: int = SHARD_SIZE) -> DataFrame:
    """Rows whose shard and offset do not follow from their place in their split's file order."""
    expected = F.concat(F.col("final_split"), numbered("/shard_", F.expr(f"manifest_row_index div {size}"), tail=".pt"))
    key = F.col("relative_audio_path")
    return all_of(violations(index, "shard_of_row", key, F.col("shard_path") != expected), violations(index, "offset_of_row", key, F.col("within_shard_index") != F.col("manifest_row_index") % size))


def cache_violations(index: DataFrame, size: int = SHARD_SIZE) -> DataFrame:
    """Shards that are missing or have the wrong number of rows, and paths that occur twice."""
    rows = index.groupBy("final_split").agg(F.count("*").alias("_rows"), F.countDistinct("shard_path").alias("_shards"))
    totals = shard_totals(index).join(rows, "final_split").withColumn("_last", F.col("shard_path") == F.max("shard_path").over(Window.partitionBy("final_split")))
    wanted = F.when(F.col("_last"), (F.col("_rows") - 1) % size + 1).otherwise(F.lit(size))
    return all_of(
        violations(rows, "number_of_shards", F.col("final_split"), F.col("_shards") != F.ceil(F.col("_rows") / size)),
        violations(totals, "rows_of_shard", F.col("shard_path"), F.col("n_rows") != wanted),
        duplicates(index, "unique_path", F.col("relative_audio_path")),
    )


def lookup(index: DataFrame, stored: DataFrame) -> DataFrame:
    """Index rows joined with what is stored at their shard and offset, and ``agrees``: label, speaker and path all match."""
    found = stored.select("shard_path", "within_shard_index", *[F.col(c).alias(f"stored_{c}") for c in ("relative_audio_path", "speaker_id", "speaker_label")])
    same = [F.col(c).eqNullSafe(F.col(f"stored_{c}")) for c in ("relative_audio_path", "speaker_id", "speaker_label")]
    return index.join(found, ["shard_path", "within_shard_index"], "left").withColumn("agrees", same[0] & same[1] & same[2])


def normalised_index(*versions: DataFrame) -> DataFrame:
    """Index rows of all schema versions as one table; fields that a version lacks get their defaults."""
    both = versions[0]
    for v in versions[1:]:
        both = both.unionByName(v, allowMissingColumns=True)
    for column, default in (("filename_group", ""), ("duplicate_group", ""), ("manifest_version", ""), ("manifest_row_index", -1)):
        both = both.withColumn(column, F.coalesce(F.col(column), F.lit(default)) if column in both.columns else F.lit(default))
    return both
