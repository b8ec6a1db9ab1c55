"""Jobs: build a dataset package from WAV files, and report on scored trials."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import canonical_json, multiset_state, sha256, state_identity, table_identity
from ..operators import caches, contracts, metrics, scoring, shards, splits, trials
from ..scratch import Scratch
from ..sources import packs, tables, versions, wav


def package_tables(utterances: DataFrame, sizes: tuple[int, int, int] | None = None, seed: int = splits.SEED) -> dict[str, DataFrame]:
    """Split, labels, manifest and feature index of an utterance table."""
    split = splits.assign_splits(utterances, sizes, seed)
    labels = splits.train_labels(split)
    manifest = splits.portable_manifest(utterances, split, labels)
    return {"speaker_split": split, "speaker_to_label": labels, "manifest": manifest, "feature_index": shards.feature_index(manifest)}


def identities(built: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, n_rows, identity)."""
    return contracts.all_of(*[table_identity(rows).select(F.lit(name).alias("table"), "n_rows", "identity") for name, rows in built.items()])


def dataset_identity(files: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """One row (n_files, n_speakers, seconds, sample_rate, num_channels, listing_sha256, identity_sha256): what a tree of
    WAV files (as ``wav.discover`` lists them) is, whatever the order and times of its files.

    Files of different rates or channels are an error.  The listing's digest is of paths and sizes; the last column hashes
    the others.  ``heads`` are the files' headers if they were read already.
    """
    if heads is None:
        heads, files = wav.headers(files), wav.keep(files.select("path", "size"), "listing")
    mixed = F.raise_error(F.lit("the files differ in rate or channels"))
    one = lambda c: F.when(F.min(c) == F.max(c), F.max(c)).otherwise(mixed).alias(c)
    counts = heads.agg(F.count("*").alias("n_files"), F.countDistinct("speaker_id").alias("n_speakers"), F.coalesce(F.sum("num_samples"), F.lit(0)).alias("_samples"), one("sample_rate"), one("num_channels"))
    counts = counts.select("n_files", "n_speakers", (F.col("_samples") / F.col("sample_rate")).alias("seconds"), "sample_rate", "num_channels")
    listing = state_identity(multiset_state(files, "path", "size")).select(F.col("identity").alias("listing_sha256"))
    row = counts.join(F.broadcast(listing))
    return row.withColumn("identity_sha256", sha256(canonical_json(*row.columns)))


def create_package(spark: SparkSession, root: str, out: str, expected: int | None = None, sizes: tuple[int, int, int] | None = None) -> str:
    """Discover and check WAV files, build the package twice, compare, publish it with the dataset's identity, and see that
    no file changed meanwhile."""
    files = wav.discover(spark, root, expected)
    listed = wav.keep(files.select("path", "speaker_id", "size", "modified"), "listed")
    before, heads = wav.snapshot(listed).first(), wav.headers(files)
    contracts.require(contracts.audio_violations(heads))
    scratch = Scratch(spark, "create-package")
    utterances = listed.select("path", "speaker_id")
    contracts.require(contracts.utterance_violations(utterances))
    built = {name: scratch.keep(rows, name) for name, rows in package_tables(utterances, sizes).items()}
    contracts.require(contracts.manifest_violations(built["manifest"], built["speaker_split"], built["speaker_to_label"]))
    first = {r["table"]: r["identity"] for r in identities(built).collect()}
    again = {r["table"]: r["identity"] for r in identities(package_tables(utterances, sizes)).collect()}
    if first != again:
        raise RuntimeError("two builds of the package differ")
    built["dataset_identity"] = scratch.keep(dataset_identity(listed, heads), "dataset_identity")
    state = versions.publish(built, out)
    with wav.few_tasks(spark):
        after = wav.snapshot(wav.discover(spark, root, expected)).first()
    if after != before:
        raise RuntimeError("the dataset changed while the package was built")
    return state


def build_cache(manifest: DataFrame, features: DataFrame, config: DataFrame, out: str, shape: tuple[int, int] = contracts.FEATURE_SHAPE, size: int = shards.SHARD_SIZE) -> dict:
    """Build, or go on building, a feature cache below ``out``: its plan, its packed shards and its identity.

    ``manifest`` is a portable one, ``features`` has relative_audio_path and fbank, ``config`` one row.  Rows without
    features and features that break their contract are errors; so is a root that was begun with another plan.  Gives the
    state that was found (new, resume or complete) and the numbers of shards reused and written.
    """
    spark = manifest.sparkSession
    scratch = Scratch(spark, "build-cache")
    index = scratch.keep(shards.feature_index(manifest, size), "index")
    contracts.require(contracts.all_of(shards.alignment_violations(index, size), shards.cache_violations(index, size)))
    state = tables.prepare_plan({"index": index, "config": config}, out)
    rows = index.join(features.select("relative_audio_path", "fbank"), "relative_audio_path", "left")
    contracts.require(contracts.all_of(contracts.violations(rows, "missing_features", F.col("relative_audio_path"), F.col("fbank").isNull()), contracts.feature_violations(rows.where("fbank is not null"), shape)))
    found = packs.write(rows, f"{out}/shards")
    contracts.require(packs.file_violations(spark, f"{out}/shards"))
    tables.write_exact(caches.cache_identity(index, config), f"{out}/identity")
    return {"state": state, **found}


def evaluation_report(trial_rows: DataFrame, embeddings: DataFrame, digits: int | None = None) -> DataFrame:
    """One row: the equal error rate, summaries of genuine and impostor scores, and the identities of the scored trials and
    of the embeddings they were scored with.

    Scores are rounded to ``digits`` places if given.  A trial without an embedding is an error.
    """
    scored = scoring.score_trials(trial_rows, embeddings)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    scored = Scratch(trial_rows.sparkSession, "evaluation-report").keep(scored, "scored")
    rate = metrics.equal_error_rate(scored)
    summary = metrics.numeric_summary(scored, "score", "target")
    of = lambda t, name: summary.where(F.col("target") == t).select(F.struct(*[c for c in summary.columns if c != "target"]).alias(name))
    bound = table_identity(scored.select("left_audio_path", "right_audio_path", "target")).select(F.col("identity").alias("trials_identity"))
    vectors = state_identity(multiset_state(embeddings, "path", "embedding")).select(F.col("identity").alias("embeddings_identity"))
    report = rate.join(F.broadcast(of(1, "genuine"))).join(F.broadcast(of(0, "impostor"))).join(F.broadcast(bound)).join(F.broadcast(vectors))
    return report.withColumn("report_sha256", sha256(F.to_json(F.struct("eer", "genuine", "impostor", "trials_identity", "embeddings_identity"))))


def saved_embeddings(rows: DataFrame, function: Callable[[np.ndarray], np.ndarray], path: str, binding: str, dimension: int, key: str = "path", vector: str = "features") -> DataFrame:
    """Embeddings of ``rows`` by ``function``: those saved at ``path`` if they are whole and of the same ``binding`` (say, a
    digest of the model and the index), else computed in batches and saved.  Saved ones that do not fit are an error."""
    spark = rows.sparkSession
    if not tables.exists(spark, path):
        tables.write_exact(caches.infer(rows, function, key, vector).withColumn("binding", F.lit(binding)), path)
    saved = spark.read.parquet(path)
    contracts.require(caches.artifact_violations(saved, rows.select(key), binding, dimension, key))
    return saved.select(key, "embedding")


def save_checkpoint(checkpoint: DataFrame, path: str, batches: int, config_sha256: str, seed: int) -> None:
    """Replace the checkpoint at ``path`` by a valid one, in one step; the one before can be rolled back to."""
    contracts.require(caches.checkpoint_violations(checkpoint, batches, config_sha256, seed))
    versions.publish({"checkpoint": checkpoint}, path, replace=True)
    versions.prune(checkpoint.sparkSession, path)


def load_checkpoint(spark: SparkSession, path: str, batches: int, config_sha256: str, seed: int) -> DataFrame:
    """The checkpoint at ``path``, if it belongs to this experiment."""
    found = versions.open_tables(spark, path, check=True)["checkpoint"]
    contracts.require(caches.checkpoint_violations(found, batches, config_sha256, seed))
    return found


def resumable_cursor(cursors: DataFrame, batches: int) -> DataFrame:
    """The latest valid checkpoint cursor (epoch, position, steps)."""
    contracts.require(contracts.cursor_violations(cursors, batches))
    return cursors.orderBy(F.desc("steps")).limit(1)


def final_evaluation(trial_rows: DataFrame, embeddings: DataFrame, out: str, check: bool = False) -> DataFrame | None:
    """The report on the final test, which may be made once: a marker beside ``out`` is claimed before anything is
    scored.  With ``check`` inputs are checked and nothing is scored or claimed."""
    spark = trial_rows.sparkSession
    contracts.require(scoring.embedding_violations(trial_rows, embeddings))
    if check:
        return None
    tables.claim(spark, f"{out.rstrip('/')}.claimed", table_identity(trial_rows).first()["identity"])
    tables.write_exact(evaluation_report(trial_rows, embeddings), out)
    return spark.read.parquet(out)
