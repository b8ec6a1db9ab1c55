"""Fail-closed contracts as tables of violations.

Each rule adds rows (rule, key, detail) for what breaks it, so a caller sees all violations at once; ``require`` raises
if there are any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name, parent_name, safe_path
from ..functions.vectors import all_finite
from .splits import NO_LABEL, SPLITS

#: Fixed values of the audio contract.
AUDIO = {"sample_rate": 16000, "num_channels": 1, "num_samples": 48000, "sample_width": 2, "compression": 1}
#: Fixed values of a feature: frames and bins.
FEATURE_SHAPE = (301, 80)
SHARD_NAME = r"^train/shard_[0-9]{5,}\.pt$"


class ContractError(ValueError):
    """A table breaks its contract."""


def violations(rows: DataFrame, rule: str, key: Column, broken: Column, detail: Column | None = None) -> DataFrame:
    """Rows for which ``broken`` is true, or null: what cannot be decided fails."""
    return rows.where(F.coalesce(broken, F.lit(True))).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail).cast("string").alias("detail"))


def row_violations(rows: DataFrame, key: Column, *rules: tuple) -> DataFrame:
    """The same for several rules (name, broken[, detail]) over one table, in one pass over its rows."""
    found = [
        F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (detail[0] if detail else F.lit("")).cast("string").alias("detail")))
        for rule, broken, *detail in rules
    ]
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.*")


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(found: DataFrame) -> None:
    first = found.take(5)
    if first:
        raise ContractError("; ".join(f"{r['rule']}: {r['key']} {r['detail']}".strip() for r in first))


def duplicates(rows: DataFrame, rule: str, key: Column) -> DataFrame:
    """Keys that occur more than once."""
    counted = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    return counted.select(F.lit(rule).alias("rule"), F.col("k").cast("string").alias("key"), F.col("n").cast("string").alias("detail"))


def case_collisions(rows: DataFrame, key: str) -> DataFrame:
    """Rows (folded, n_rows, n_spellings) of keys that several rows have when case is ignored."""
    return rows.groupBy(F.lower(key).alias("folded")).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_spellings")).where("n_rows > 1")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (key, side) of one-column tables' keys that only one of them has: ``missing`` from the right, or ``extra``."""
    l, r = left.toDF("key").distinct(), right.toDF("key").distinct()
    return l.join(r, "key", "left_anti").withColumn("side", F.lit("missing")).unionByName(r.join(l, "key", "left_anti").withColumn("side", F.lit("extra")))


def audio_violations(headers: DataFrame) -> DataFrame:
    """One row for each file that breaks the audio contract; the detail names every broken field."""
    wrong = [F.when(~F.col(c).eqNullSafe(F.lit(v)), F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("?")))) for c, v in AUDIO.items()]
    detail = F.concat_ws(", ", *wrong)
    return violations(headers, "audio_contract", F.col("path"), detail != "", detail)


def utterance_violations(utterances: DataFrame) -> DataFrame:
    path, speaker = F.col("path"), F.col("speaker_id")
    return all_of(
        row_violations(
            utterances, path,
            ("portable_path", ~safe_path(path)),
            ("parent_is_speaker", parent_name(path) != speaker),
            ("wav_suffix", ~F.lower(file_name(path)).endswith(".wav")),
            ("empty_speaker", F.length(speaker) == 0),
        ),
        duplicates(utterances, "unique_path", path),
        duplicates(utterances.groupBy(F.lower(path).alias("folded"), path.alias("p")).count(), "unique_path_ignoring_case", F.col("folded")),
    )


def manifest_violations(manifest: DataFrame, split: DataFrame, labels: DataFrame) -> DataFrame:
    """Package invariants: one split for each speaker, labels of train speakers alone, contiguous from 0, same speakers."""
    path, speaker, label = F.col("relative_audio_path"), F.col("speaker_id"), F.col("speaker_label")
    joined = manifest.join(split.select("speaker_id", "split"), "speaker_id", "left").join(labels, "speaker_id", "left")
    span = labels.agg(F.count("*").alias("n"), F.countDistinct("label").alias("d"), F.coalesce(F.min("label"), F.lit(0)).alias("lo"), F.coalesce(F.max("label"), F.lit(-1)).alias("hi"))
    train = F.col("split") == SPLITS[0]
    return all_of(
        row_violations(
            joined, path,
            ("known_split", ~F.col("final_split").isin(*SPLITS)),
            ("row_split_is_speaker_split", F.col("final_split") != F.col("split")),
            ("label_of_train_speaker", F.when(train, label != F.col("label")).otherwise(label != NO_LABEL)),
        ),
        duplicates(split, "one_split_per_speaker", speaker),
        duplicates(manifest, "unique_path", path),
        violations(span, "contiguous_labels", F.lit("labels"), (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n"))),
        violations(set_difference(split.select("speaker_id"), manifest.select("speaker_id")), "same_speakers", F.col("key"), F.lit(True), F.col("side")),
    )


def provenance_violations(provenance: DataFrame) -> DataFrame:
    """Provenance rows (relative_path, speaker_id): safe paths below their speaker, unique also when case is ignored."""
    path = F.col("relative_path")
    return all_of(
        row_violations(provenance, path, ("safe_path", ~safe_path(path)), ("parent_is_speaker", parent_name(path) != F.col("speaker_id"))),
        duplicates(provenance, "unique_path", path),
        duplicates(provenance.groupBy(F.lower(path).alias("folded"), path.alias("p")).count(), "unique_path_ignoring_case", F.col("folded")),
    )


def lineage_violations(manifest: DataFrame, provenance: DataFrame, summary: dict[str, int], checks: dict[str, bool]) -> DataFrame:
    """A manifest (path, speaker_id) against the provenance it comes from: the same paths, the rows and speakers that a
    summary declares, and every external check (by name) passed."""
    spark = manifest.sparkSession
    counts = manifest.agg(F.count("*").alias("rows"), F.countDistinct("speaker_id").alias("speakers"))
    declared = [violations(counts, f"declared_{k}", F.lit(k), F.col(k) != v, F.col(k)) for k, v in summary.items()]
    flags = spark.createDataFrame(list(checks.items()) or [("none", True)], "name string, passed boolean")
    return all_of(
        violations(set_difference(provenance.select("relative_path"), manifest.select("path")), "same_paths", F.col("key"), F.lit(True), F.col("side")),
        *declared,
        violations(flags, "external_check", F.col("name"), ~F.col("passed")),
    )


def feature_violations(features: DataFrame, shape: tuple[int, int] = FEATURE_SHAPE) -> DataFrame:
    """Rows whose ``fbank`` (array of frames) has not the shape or an entry that is not finite."""
    frames = F.col("fbank")
    square = (F.size(frames) == shape[0]) & F.forall(frames, lambda f: F.size(f) == shape[1])
    key = F.col("relative_audio_path")
    return all_of(violations(features, "feature_shape", key, ~square), violations(features, "finite_features", key, ~F.forall(frames, all_finite)))


def train_only_violations(index: DataFrame, n_labels: int) -> DataFrame:
    """Rows that training must not see: other splits, shard paths outside ``train/``, labels out of range."""
    key = F.col("relative_audio_path")
    return all_of(
        row_violations(
            index, key,
            ("train_split", F.col("final_split") != SPLITS[0]),
            ("train_shard_path", ~F.col("shard_path").rlike(SHARD_NAME)),
            ("train_label", (F.col("speaker_label") < 0) | (F.col("speaker_label") >= n_labels)),
        ),
    )


def sampler_violations(index: DataFrame) -> DataFrame:
    """Speakers and labels match one to one and labels are contiguous from 0."""
    speakers = index.groupBy("speaker_id").agg(F.countDistinct("speaker_label").alias("n")).where("n > 1")
    labels = index.groupBy("speaker_label").agg(F.countDistinct("speaker_id").alias("n"))
    span = labels.agg(F.count("*").alias("n"), F.min("speaker_label").alias("lo"), F.max("speaker_label").alias("hi"))
    return all_of(
        violations(speakers, "one_label_per_speaker", F.col("speaker_id"), F.lit(True)),
        violations(labels.where("n > 1"), "one_speaker_per_label", F.col("speaker_label"), F.lit(True)),
        violations(span, "contiguous_labels", F.lit("labels"), (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)),
    )


def bound_file_violations(files: DataFrame, bindings: DataFrame) -> DataFrame:
    """Files (path, content) against their bound (path, sha256): both sets alike, hashes equal, no path of a test set.  A file
    without content, and one that is bound to no hash, differ."""
    hashed = files.select("path", F.sha2("content", 256).alias("_found"))
    joined = bindings.join(hashed, "path", "left")
    parts = F.split(F.lower("path"), "/")
    return all_of(
        violations(joined, "bound_hash", F.col("path"), F.coalesce(F.col("sha256") != F.col("_found"), F.lit(True))),
        violations(hashed.join(bindings, "path", "left_anti"), "bound_names", F.col("path"), F.lit(True)),
        row_violations(
            bindings, F.col("path"),
            ("no_final_test", F.exists(parts, lambda p: F.contains(p, F.lit("final")) | (p == "test"))),
            ("safe_path", ~safe_path(F.col("path"), None)),
        ),
    )


def config_violations(config: DataFrame, expected: dict[str, object]) -> DataFrame:
    """One row for each setting of a parsed configuration that differs from its fixed value."""
    return all_of(*[violations(config, "config", F.lit(c), ~F.col(c).eqNullSafe(F.lit(v)), F.col(c).cast("string")) for c, v in expected.items()])


def absolute_root_violations(documents: DataFrame, text: str, root: str) -> DataFrame:
    """Serialized metadata that mentions the dataset's absolute root."""
    return violations(documents, "no_absolute_root", F.substring(F.sha2(text, 256), 1, 12), F.contains(F.col(text), F.lit(root)))


def cursor_violations(cursors: DataFrame, batches: int) -> DataFrame:
    """Checkpoint cursors (epoch, position, steps): steps = epoch * batches + position, position within the epoch."""
    key = F.concat_ws("/", "epoch", "position")
    return all_of(
        row_violations(
            cursors, key,
            ("cursor_steps", F.col("steps") != F.col("epoch") * batches + F.col("position")),
            ("cursor_range", (F.col("epoch") < 0) | (F.col("position") < 0) | (F.col("position") > batches)),
        ),
    )
