"""Embedding lookup and cosine scores of trials."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import all_of, duplicates, violations


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; 0 where a vector is zero."""
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return np.divide((a * b).sum(1), size, out=np.zeros(len(a)), where=size > 0)


def embedding_violations(trials: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Duplicate paths among the embeddings, and paths of trials without one."""
    ends = trials.select(F.explode(F.array("left_audio_path", "right_audio_path")).alias("path")).distinct()
    return all_of(duplicates(embeddings, "unique_embedding", F.col("path")), violations(ends.join(embeddings.select("path"), "path", "left_anti"), "missing_embedding", F.col("path"), F.lit(True)))


def score_trials(trials: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``trials`` with ``score``; embeddings are rows (path, embedding) of one length.  A trial whose path has no embedding
    is an error; ``embedding_violations`` lists such paths."""
    names = trials.columns
    left = embeddings.select(F.col("path").alias("left_audio_path"), F.col("embedding").alias("_a"))
    right = embeddings.select(F.col("path").alias("right_audio_path"), F.col("embedding").alias("_b"))
    known = lambda v, path: F.when(F.col(v).isNull(), F.raise_error(F.concat(F.lit("no embedding of "), F.coalesce(path, F.lit("a null path"))))).otherwise(F.col(v)).alias(v)
    joined = trials.join(left, "left_audio_path", "left").join(right, "right_audio_path", "left").select(*names, known("_a", F.col("left_audio_path")), known("_b", F.col("right_audio_path")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trials.schema) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1)) for k in (-2, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(cosines(a, b))], names=[*names, "score"])

    return joined.mapInArrow(run, schema)
