"""Strict tables from CSV and JSON, and canonical, idempotent writing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.digests import canonical_json, table_identity
from . import versions

#: Schemas of the package's files.
MANIFEST = "audio_path string, speaker_id string, sample_rate int, num_channels int, num_samples int, duration_sec string"
PORTABLE = "relative_audio_path string, speaker_id string, speaker_label int, final_split string"
SPLIT = "speaker_id string, split string, ranking_sha256 string"
PROVENANCE = "relative_path string, speaker_id string"
INDEX_V3 = "relative_audio_path string, speaker_id string, speaker_label int, final_split string, shard_path string, within_shard_index int"
INDEX_V1 = "relative_audio_path string, feature_shard_path string, feature_index int, speaker_id string, speaker_label int, final_split string, filename_group string, feature_frames int, feature_dim int, feature_dtype string"
INDEX_V2 = "audio_path string, speaker_id string, label int, final_split string, shard_path string, within_shard_index int, feature_frames int, feature_bins int, feature_dtype string, manifest_row_index int, filename_group string, duplicate_group string, manifest_version string"
TRIALS = "trial_id string, left_audio_path string, right_audio_path string, left_speaker_id string, right_speaker_id string, target int"
LEGACY_TRIALS = "trial_id int, target int, left_relative_audio_path string, right_relative_audio_path string, left_speaker_id string, right_speaker_id string"
SCORES = "trial_id string, target int, score double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose header must be the schema's columns in order; a bad cell or header is an error when the rows are read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("escape", '"').csv(path)


def read_superset_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with at least the given columns, read as strings and cut down to them."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return rows.select(*columns)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file; anything that does not fit the schema is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_csv(rows: DataFrame, path: str, *order: Column) -> None:
    """CSV parts in one global order: ranges of the order, each sorted, with headers and LF line ends."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    ordered.write.option("header", True).option("lineSep", "\n").option("escape", '"').csv(path, mode="errorifexists")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Canonical JSON lines."""
    rows.select(canonical_json(*rows.columns).alias("value")).write.mode("errorifexists").text(path, lineSep="\n")


def exists(spark: SparkSession, path: str) -> bool:
    return versions.Store(spark, path).exists()


def write_exact(rows: DataFrame, path: str) -> str:
    """``created``, or ``unchanged`` if the same rows are there already; other rows there are an error.

    Rows are written beside ``path`` and moved there by one rename, so it holds all of them or is not there.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    store = versions.Store(rows.sparkSession, folder)
    if store.exists(name):
        if table_identity(rows.sparkSession.read.parquet(path)).first() != table_identity(rows).first():
            raise ValueError(f"{path} holds other rows")
        return "unchanged"
    staged = f"{name}.new-{uuid.uuid4().hex}"
    store.write_table(staged, rows)
    store.rename(staged, name)
    return "created"


def claim(spark: SparkSession, path: str, content: str) -> None:
    """Create a marker file that must not be there yet: what it stands for may be done once."""
    folder, _, name = path.rpartition("/")
    store = versions.Store(spark, folder)
    if store.exists(name):
        raise ValueError(f"{path} is taken: this was done before")
    store.create(name, content)


def prepare_plan(plan: dict[str, DataFrame], root: str) -> str:
    """``new``, ``resume`` or ``complete``: the state of a cache root for a plan (tables by name, such as the configuration
    and the indexes).  The plan of a new root is published; one that is there must be equal.  A root is complete when the
    table ``identity`` is there too; anything else below it but ``shards`` is an error."""
    spark = next(iter(plan.values())).sparkSession
    there = set(versions.Store(spark, root).names())
    if other := there - {"plan", "shards", "identity"}:
        raise ValueError(f"{root} holds unexpected entries: {sorted(other)}")
    if "plan" not in there and there:
        raise ValueError(f"{root} holds a cache without its plan")
    versions.publish(plan, f"{root.rstrip('/')}/plan")
    return "complete" if "identity" in there else "resume" if there else "new"
