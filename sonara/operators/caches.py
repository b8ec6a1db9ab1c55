"""Feature caches: index rules of all schema versions, shard contracts, plans, identities and artifacts.

Everything is a table of violations or of states per shard, so a check costs one pass and its joins, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import canonical_json, sha256, table_identity
from ..functions.ranking import ordered_rank
from ..functions.text import numbered, parent_name, safe_path, strip
from ..functions.vectors import all_finite
from .contracts import FEATURE_SHAPE, all_of, duplicates, feature_violations, row_violations, violations
from .shards import SHARD_SIZE
from .splits import NO_LABEL, SPLITS


class IndexSchema(NamedTuple):
    """Names of a version's columns, and which rules it has; absent columns are None."""

    path: str
    shard: str
    offset: str
    label: str
    frames: str | None = None
    bins: str | None = None
    row: str | None = None
    version: str | None = None
    aligned: bool = True


#: Columns of the three index versions, file-name groups and the feature type.
SCHEMAS = {
    1: IndexSchema("relative_audio_path", "feature_shard_path", "feature_index", "speaker_label", "feature_frames", "feature_dim", aligned=False),
    2: IndexSchema("audio_path", "shard_path", "within_shard_index", "label", "feature_frames", "feature_bins", "manifest_row_index", "v2"),
    3: IndexSchema("relative_audio_path", "shard_path", "within_shard_index", "speaker_label"),
}
GROUPS = ("train", "train_small")
FEATURE_TYPE = "float32"
PLAN_STATES = ("new", "resume", "complete")


def _shard_name(split: Column, row: Column, size: int) -> Column:
    return F.concat(split, numbered("/shard_", F.floor(row / size), tail=".pt"))


def index_violations(index: DataFrame, version: int, n_labels: int, size: int = SHARD_SIZE, groups: tuple[str, ...] = GROUPS, shape: tuple[int, int] = FEATURE_SHAPE, expected: dict[str, int] | None = None) -> DataFrame:
    """All rows of a version's feature index (all splits at once) that break one of its rules.

    A file's rows have no order of their own here: a row's number is its column where the version has one, and otherwise
    its shard's number times the size plus its offset, which must then run from 0 without gaps in each split.
    ``expected``: rows of each split.
    """
    s = SCHEMAS[version]
    path, shard, offset, label = (F.col(c) for c in s[:4])
    split, speaker = F.trim(F.col("final_split")), strip(F.col("speaker_id"))
    in_train = split == SPLITS[0]
    number = F.regexp_extract(shard, r"shard_([0-9]+)\.pt$", 1).try_cast("bigint")
    rows = index.withColumn("_row", F.col(s.row).cast("bigint") if s.row else number * size + offset)
    rules = [
        ("safe_path", ~safe_path(strip(path), None, colons=True)),
        ("safe_shard_path", ~safe_path(strip(shard), None, colons=True)),
        ("empty_speaker", F.length(speaker) == 0),
        ("known_split", ~split.isin(*SPLITS)),
        ("offset_range", (offset < 0) | (offset >= size)),
        ("label_range", F.when(in_train, (label < 0) | (label >= n_labels)).otherwise(label != NO_LABEL)),
    ]
    if s.frames:
        metadata = (F.col(s.frames) != shape[0]) | (F.col(s.bins) != shape[1]) | (strip(F.col("feature_dtype")) != FEATURE_TYPE)
        rules += [("file_name_group", ~strip(F.col("filename_group")).isin(*groups)), ("feature_metadata", metadata)]
    if s.version:
        rules.append(("manifest_version", strip(F.col("manifest_version")) != s.version))
    if s.aligned:
        rules += [
            ("shard_of_row", shard != _shard_name(split, F.col("_row"), size)),
            ("offset_of_row", offset != F.col("_row") % size),
            ("parent_is_speaker", parent_name(strip(path)) != speaker),
        ]
    found = [row_violations(rows, path, *rules)]
    if s.aligned:
        counts = rows.groupBy("final_split").agg(F.count("*").alias("n"), F.countDistinct("_row").alias("d"), F.min("_row").alias("lo"), F.max("_row").alias("hi"))
        labels = index.where(in_train).agg(F.countDistinct(F.when((label >= 0) & (label < n_labels), label)).alias("n"))
        found += [
            violations(counts, "gapless_rows", F.col("final_split"), (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n"))),
            violations(labels, "label_coverage", F.lit(SPLITS[0]), F.col("n") != n_labels, F.col("n")),
            duplicates(index, "unique_path", path),
        ]
    if expected is not None:
        wanted = index.sparkSession.createDataFrame(list(expected.items()), "final_split string, wanted long")
        counted = wanted.join(index.groupBy("final_split").agg(F.count("*").alias("n")), "final_split", "left")
        found.append(violations(counted, "number_of_rows", F.col("final_split"), F.coalesce("n", F.lit(0)) != F.col("wanted"), F.col("n")))
    return all_of(*found)


def payload_violations(payloads: DataFrame, size: int = SHARD_SIZE, shape: tuple[int, int] | None = FEATURE_SHAPE) -> DataFrame:
    """Shards (final_split, shard_path, relative_audio_paths, speaker_ids, speaker_labels, features) that break their
    contract: 1 to ``size`` rows, arrays of one length, features of one shape with finite numbers alone, no empty
    identifiers, and a split that is the path's first part.  ``shape`` None: features are vectors of any one length."""
    key, n = F.col("shard_path"), F.size("features")
    columns = ("relative_audio_paths", "speaker_ids", "speaker_labels")
    if shape is None:
        square, finite = F.size(F.array_distinct(F.transform("features", F.size))) == 1, F.forall("features", all_finite)
    else:
        square = F.forall("features", lambda f: (F.size(f) == shape[0]) & F.forall(f, lambda x: F.size(x) == shape[1]))
        finite = F.forall("features", lambda f: F.forall(f, all_finite))
    return all_of(
        row_violations(
            payloads, key,
            ("rows_of_shard", (n < 1) | (n > size), n),
            ("aligned_arrays", F.greatest(*[F.abs(F.size(c) - n) for c in columns]) != 0),
            ("feature_shape", ~square),
            ("finite_features", ~finite),
            ("identifiers", F.exists("speaker_ids", lambda x: x.isNull() | (x == "")) | F.exists("relative_audio_paths", lambda x: x.isNull() | (x == ""))),
            ("labels", F.exists("speaker_labels", lambda x: x.isNull())),
            ("split_of_shard", F.split(key, "/")[0] != F.col("final_split")),
        ),
    )


def shard_states(planned: DataFrame, stored: DataFrame, shard: str = "shard_path") -> DataFrame:
    """Rows (shard, planned, stored, state): ``valid`` if both hold the same rows, else ``missing``, ``different`` or
    ``unexpected``.  A shard has few rows, whose digests are compared."""
    columns = sorted(c for c in planned.columns if c != shard)

    def digest(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(F.col(shard).cast("string").alias("shard"), F.sha2(canonical_json(*columns), 256).alias("_d"))
        return rows.groupBy("shard").agg(F.count("*").alias(name), F.sha2(F.array_join(F.sort_array(F.collect_list("_d")), "\n"), 256).alias(f"_{name}"))

    both = digest(planned, "planned").join(digest(stored.select(shard, *columns), "stored"), "shard", "full")
    state = F.when(F.col("stored").isNull(), "missing").when(F.col("planned").isNull(), "unexpected").when(F.col("_planned") == F.col("_stored"), "valid").otherwise("different")
    return both.select("shard", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("stored", F.lit(0)).alias("stored"), state.alias("state"))


def plan_state(states: DataFrame) -> DataFrame:
    """One row (total, valid, missing, conflicts, plan): ``new`` without any stored shard, ``complete`` if all are valid,
    else ``resume``; shards that differ or that nobody planned are conflicts, and the plan is null."""
    of = lambda *s: F.count_if(F.col("state").isin(*s))
    counts = states.agg(of("valid", "missing", "different").alias("total"), of("valid").alias("valid"), of("missing").alias("missing"), of("different", "unexpected").alias("conflicts"))
    plan = F.when(F.col("conflicts") > 0, F.lit(None)).when((F.col("total") > 0) & (F.col("missing") == 0), PLAN_STATES[2]).when(F.col("valid") > 0, PLAN_STATES[1]).otherwise(PLAN_STATES[0])
    return counts.withColumn("plan", plan)


def concat_shards(stored: DataFrame, shard: str = "shard_path", offset: str = "within_shard_index") -> DataFrame:
    """``stored`` with ``position``: all shards laid end to end in the order of their names and offsets."""
    return ordered_rank(stored, [F.col(shard), F.col(offset)], "position", "concat-shards")


def _self_hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("identity_sha256", sha256(canonical_json(*rows.columns)))


def cache_identity(index: DataFrame, config: DataFrame, kind: str = "fbank-cache") -> DataFrame:
    """One row for each split (kind, final_split, n_rows, n_shards, n_speakers, index_identity, config_sha256,
    identity_sha256) that binds an index to the configuration it was built with; the last column hashes the others.

    ``config`` has one row.
    """
    counts = index.groupBy("final_split").agg(F.count("*").alias("n_rows"), F.countDistinct("shard_path").alias("n_shards"), F.countDistinct("speaker_id").alias("n_speakers"))
    parts = [table_identity(index.where(F.col("final_split") == s)).select(F.lit(s).alias("final_split"), F.col("identity").alias("index_identity")) for s in SPLITS]
    bound = config.select(sha256(canonical_json(*config.columns)).alias("config_sha256"))
    rows = counts.join(all_of(*parts), "final_split").join(F.broadcast(bound))
    return _self_hashed(rows.select(F.lit(kind).alias("kind"), "final_split", "n_rows", "n_shards", "n_speakers", "index_identity", "config_sha256"))


def trial_identity(trials: DataFrame, utterances: DataFrame, kind: str = "verification-trials") -> DataFrame:
    """One row (kind, genuine, impostor, n_speakers, least and most endpoints of a speaker, trials and manifest
    identities, identity_sha256)."""
    columns = ("left_audio_path", "right_audio_path", "left_speaker_id", "right_speaker_id", "target")
    counts = trials.agg(F.count_if(F.col("target") == 1).alias("genuine"), F.count_if(F.col("target") == 0).alias("impostor"))
    ends = trials.select(F.explode(F.array("left_speaker_id", "right_speaker_id")).alias("speaker_id")).groupBy("speaker_id").agg(F.count("*").alias("n"))
    spread = ends.agg(F.count("*").alias("n_speakers"), F.min("n").alias("least_endpoints"), F.max("n").alias("most_endpoints"))
    identity = lambda rows, name: rows.select(F.col("identity").alias(name))
    rows = counts.join(F.broadcast(spread)).join(F.broadcast(identity(table_identity(trials, *columns), "trials_identity"))).join(F.broadcast(identity(table_identity(utterances, "path", "speaker_id"), "manifest_identity")))
    return _self_hashed(rows.select(F.lit(kind).alias("kind"), *rows.columns))


def identity_violations(identity: DataFrame, expected: dict[str, object], key: str = "kind") -> DataFrame:
    """Identities whose fields differ from what the configuration says, or whose own hash does not fit."""
    own = [c for c in identity.columns if c != "identity_sha256"]
    fields = [(f"field_{c}", ~F.col(c).eqNullSafe(F.lit(v))) for c, v in expected.items()]
    return row_violations(identity, F.col(key), *fields, ("self_hash", F.col("identity_sha256") != sha256(canonical_json(*own))))


def score_violations(scores: DataFrame, trials: DataFrame) -> DataFrame:
    """A score table (trial_id, target, score) against the trials it claims to score: every trial once, none besides,
    the same targets, finite scores in [-1, 1] give or take rounding."""
    declared = trials.select("trial_id", F.col("target").alias("_target"))
    joined = scores.join(declared, "trial_id", "left")
    key = F.col("trial_id")
    return all_of(
        duplicates(scores, "unique_score", key),
        violations(trials.select("trial_id").join(scores.select("trial_id"), "trial_id", "left_anti"), "missing_score", key, F.lit(True)),
        row_violations(
            joined, key,
            ("known_trial", F.col("_target").isNull()),
            ("target_of_trial", F.col("_target").isNotNull() & ~F.col("target").eqNullSafe(F.col("_target"))),
            ("finite_score", F.isnan("score") | (F.abs("score") > 1.000001)),
        ),
    )


def input_violations(rows: DataFrame, dimension: int, n_labels: int, key: str = "path") -> DataFrame:
    """Rows (``key``, embedding, speaker_label, relative_length) that a training step must refuse: embeddings of another
    length or with numbers that are not finite, labels outside 0 to ``n_labels`` - 1, lengths outside (0, 1]."""
    k = F.col(key)
    return all_of(
        row_violations(
            rows, k,
            ("embedding_dimension", F.size("embedding") != dimension, F.size("embedding")),
            ("finite_embedding", ~all_finite(F.col("embedding"))),
            ("label_range", (F.col("speaker_label") < 0) | (F.col("speaker_label") >= n_labels), F.col("speaker_label")),
            ("relative_length", (F.col("relative_length") <= 0) | (F.col("relative_length") > 1)),
        ),
    )


def first_batch_violations(features: DataFrame, split: str, order: str = "manifest_row_index", size: int = 4, shape: tuple[int, int] = FEATURE_SHAPE) -> DataFrame:
    """The feature contract on a split's first ``size`` rows (relative_audio_path, final_split, fbank, ``order``): a quick
    look before the whole cache is read."""
    first = features.where(F.col("final_split") == split).orderBy(order).limit(size)
    count = first.agg(F.count("*").alias("n"))
    return all_of(feature_violations(first, shape), violations(count, "first_batch", F.lit(split), F.col("n") != size, F.col("n")))


#: Fixed values of early stopping that a checkpoint must carry.
PATIENCE, MIN_IMPROVEMENT = 2, 1e-4


def checkpoint_violations(checkpoints: DataFrame, batches: int, config_sha256: str, seed: int) -> DataFrame:
    """Checkpoints (schema, version, configuration_sha256, next_epoch, position, optimizer_steps, scheduler_steps,
    sampler_seed, sampler_epoch, patience, min_improvement, final_test_accesses) that do not belong to this experiment, or
    whose cursor, scheduler, sampler and stopping rule do not agree."""
    key = F.concat_ws("/", "next_epoch", "position")
    c = F.col
    return all_of(
        row_violations(
            checkpoints, key,
            ("configuration", c("configuration_sha256") != config_sha256),
            ("final_test_untouched", c("final_test_accesses") != 0),
            ("cursor_steps", c("optimizer_steps") != c("next_epoch") * batches + c("position")),
            ("cursor_range", (c("next_epoch") < 0) | (c("position") < 0) | (c("position") > batches)),
            ("scheduler_steps", c("optimizer_steps") != c("scheduler_steps")),
            ("sampler_state", (c("sampler_seed") != seed) | (c("sampler_epoch") != c("next_epoch"))),
            ("stopping_rule", (c("patience") != PATIENCE) | (c("min_improvement") != MIN_IMPROVEMENT)),
        ),
    )


def infer(rows: DataFrame, function: Callable[[np.ndarray], np.ndarray], key: str, vector: str, batch: int = 32) -> DataFrame:
    """Rows (``key``, embedding): ``function`` on fixed-size slices of equally long vectors, an array [n, length] in and
    [n, dimension] out.

    Slices never cross partitions, so each partition's last one may be shorter.  A function that gives another number of
    rows, or numbers that are not finite, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in batches:
            for at in range(0, records.num_rows, batch):
                part = records.slice(at, batch)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                out = np.asarray(function(values), np.float32)
                if out.ndim != 2 or len(out) != part.num_rows or not np.isfinite(out).all():
                    raise ValueError("inference gave a wrong shape or numbers that are not finite")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(out), pa.list_(pa.float32()))], names=[key, "embedding"])

    return rows.select(key, vector).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, embedding array<float>")


def artifact_violations(saved: DataFrame, wanted: DataFrame, binding: str, dimension: int, key: str = "path") -> DataFrame:
    """Saved embeddings (``key``, embedding, binding) that may not be reused for ``wanted`` keys under ``binding``."""
    k = F.col(key)
    return all_of(
        row_violations(
            saved, k,
            ("binding", F.col("binding") != binding),
            ("embedding_dimension", F.size("embedding") != dimension, F.size("embedding")),
            ("finite_embedding", ~all_finite(F.col("embedding"))),
        ),
        duplicates(saved, "unique_embedding", k),
        violations(wanted.select(key).join(saved.select(key), key, "left_anti"), "missing_embedding", k, F.lit(True)),
        violations(saved.select(key).join(wanted.select(key), key, "left_anti"), "unexpected_embedding", k, F.lit(True)),
    )
