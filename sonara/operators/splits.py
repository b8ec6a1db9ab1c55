"""Speaker-disjoint splits, labels and portable manifests.

An utterance table has ``path`` and ``speaker_id``; the speaker is the name of the file's directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import ranking_digest
from ..functions.ranking import digest_rank, ordered_rank
from ..functions.text import numeric_aware_columns

#: Split names in order of their ranks, and the label of speakers that are not trained on.
SPLITS = ("train", "validation", "final_test")
NO_LABEL = -1
SEED = 2026


def split_sizes(speakers: int, shares: tuple[int, int, int] = (8, 1, 1)) -> tuple[int, int, int]:
    """Speakers of each split for whole-number shares; what is left over goes to the first."""
    _, v, t = (speakers * s // sum(shares) for s in shares)
    return speakers - v - t, v, t


def assign_splits(utterances: DataFrame, sizes: tuple[int, int, int] | None = None, seed: int = SEED) -> DataFrame:
    """Rows (speaker_id, split, ranking_sha256): speakers in the order of their digest fill the splits in turn."""
    speakers = utterances.select("speaker_id").distinct().withColumn("ranking_sha256", ranking_digest(seed, F.col("speaker_id")))
    ranked = digest_rank(speakers, "ranking_sha256", "speaker_id")
    if sizes is None:
        sizes = split_sizes(speakers.count())
    split = F.when(F.col("rank") < sizes[0], SPLITS[0]).when(F.col("rank") < sizes[0] + sizes[1], SPLITS[1]).otherwise(SPLITS[2])
    return ranked.select("speaker_id", split.alias("split"), "ranking_sha256")


def train_labels(split: DataFrame) -> DataFrame:
    """Rows (speaker_id, label): train speakers numbered from 0 in numeric-aware order."""
    train = split.where(F.col("split") == SPLITS[0]).select("speaker_id")
    keys = numeric_aware_columns(F.col("speaker_id"))
    return ordered_rank(train, [F.col(k) for k in keys], "label", "labels", keys).select("speaker_id", "label")


def portable_manifest(utterances: DataFrame, split: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (relative_audio_path, speaker_id, speaker_label, final_split); only train speakers carry a label."""
    return (
        utterances.join(split.select("speaker_id", "split"), "speaker_id")
        .join(labels, "speaker_id", "left")
        .select(F.col("path").alias("relative_audio_path"), "speaker_id", F.when(F.col("split") == SPLITS[0], F.col("label")).otherwise(F.lit(NO_LABEL)).cast("int").alias("speaker_label"), F.col("split").alias("final_split"))
    )


def split_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("final_split").agg(F.count("*").alias("n_rows"), F.countDistinct("speaker_id").alias("n_speakers"))


def split_overlap(manifest: DataFrame) -> DataFrame:
    """One row (shared_speakers, shared_paths): how many lie in more than one split."""
    several = lambda c: manifest.groupBy(c).agg(F.countDistinct("final_split").alias("n")).where("n > 1").agg(F.count("*").alias(f"shared_{c}"))
    return several("speaker_id").join(several("relative_audio_path")).select(F.col("shared_speaker_id").alias("shared_speakers"), F.col("shared_relative_audio_path").alias("shared_paths"))


def duration_totals(rows: DataFrame, by: str = "final_split", duration: str = "duration_sec") -> DataFrame:
    """Rows (``by``, n_rows, total): seconds with one decimal, as text."""
    return rows.groupBy(by).agg(F.count("*").alias("n_rows"), F.format_string("%.1f", F.coalesce(F.sum(F.col(duration).cast("double")), F.lit(0.0))).alias("total"))
