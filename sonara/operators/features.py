"""Filterbank features of waveforms.

The front end is a plain short-time spectrum: centred frames, Hamming window, power spectrum, triangular mel filters,
decibels with a floor below the loudest bin of the utterance.  Arrow batches of waveforms are transformed by numpy inside
tasks; an utterance never needs another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import ordered_rank
from ..scratch import Scratch

#: Entries of means that are broadcast; as many of deviations go with them.
MAX_MEANS = 4_000_000
#: Fixed values of the front end.
SAMPLE_RATE, N_FFT, WINDOW, HOP, MELS, LOW_HZ, HIGH_HZ, TOP_DB = 16000, 400, 400, 160, 80, 0.0, 8000.0, 80.0


def mel_filters(n_fft: int = N_FFT, mels: int = MELS, rate: int = SAMPLE_RATE, low: float = LOW_HZ, high: float = HIGH_HZ) -> np.ndarray:
    """Triangles on the mel scale: one row for each filter, one column for each bin of the spectrum."""
    to_mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(low), to_mel(high), mels + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    rise = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall))


def fbank(waves: np.ndarray) -> np.ndarray:
    """Features [n, samples // hop + 1, mels] of equally long waveforms [n, samples]."""
    padded = np.pad(waves, ((0, 0), (N_FFT // 2, N_FFT // 2)))
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW, axis=1)[:, ::HOP] * np.hamming(WINDOW + 1)[:-1]
    power = np.abs(np.fft.rfft(frames, N_FFT)) ** 2
    decibels = 10 * np.log10(np.maximum(power @ mel_filters().T, 1e-10))
    return np.maximum(decibels, decibels.max((1, 2), keepdims=True) - TOP_DB).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def fbank_udf(waves: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in waves:
        out: list = [None] * len(batch)
        sizes = batch.map(len).to_numpy() if len(batch) else np.zeros(0, int)
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            for at in range(0, len(rows), 32):
                part = rows[at : at + 32]
                for k, x in zip(part, fbank(np.stack([batch.iloc[k] for k in part]).astype(np.float64))):
                    out[k] = list(x)
        yield pd.Series(out)


@F.pandas_udf(T.StructType().add("frames", T.IntegerType()).add("bins", T.IntegerType()).add("whole", T.BooleanType()))
def shape_udf(features: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Frames, bins of the first one, and whether all frames have ``MELS`` bins that are finite."""
    for batch in features:
        rows = [(None,) * 3 if x is None else (len(x), len(x[0]) if len(x) else None, all(len(y) == MELS for y in x) and bool(np.isfinite(np.asarray([*x], np.float64)).all())) for x in batch]
        yield pd.DataFrame({c: pd.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate((("frames", "Int32"), ("bins", "Int32"), ("whole", "boolean")))})


#: Groups whose states a task holds before it hands them on, and parts in which a group's states are merged first.
HELD_GROUPS, PARTS = 10_000, 64


def _merge(a: tuple, b: tuple) -> tuple:
    """Moments (n, mean, M2) of two sets of vectors together."""
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + step * step * (a[0] * b[0] / n)


def _merged(states: pa.Table, width: int) -> pa.Table:
    """One row of a group's rows (``width`` keys, n, mean, m2)."""
    total = None
    for n, mean, m2 in zip(*(states.column(c).to_pylist() for c in ("n", "mean", "m2"))):
        own = n, np.array(mean), np.array(m2)
        if total and len(total[1]) != len(own[1]):
            raise ValueError("the vectors of a group are of different lengths")
        total = _merge(total, own) if total else own
    kind = pa.list_(pa.float64())
    return states.slice(0, 1).select(range(width)).append_column("n", pa.array([total[0]], pa.int64())).append_column("mean", pa.array([total[1].tolist()], kind)).append_column("m2", pa.array([total[2].tolist()], kind))


def moments(rows: DataFrame, vector: str, *by: str) -> DataFrame:
    """Rows (``by``, n, mean, m2): number, means and sums of squared deviations, per dimension, of each group's vectors.

    Whole vectors are added up in Arrow batches where they are read; only states are shuffled, first to one of ``PARTS``
    parts of their group, so a common group costs a few arrays a task.  Null vectors do not count; groups of null keys are
    groups; vectors of different lengths in a group are an error.
    """
    keys = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], types[i]) for i in range(len(keys))]
            kind = pa.list_(pa.float64())
            states = [pa.array([s[0] for s in held.values()], pa.int64()), *[pa.array([s[i].tolist() for s in held.values()], kind) for i in (1, 2)]]
            return pa.RecordBatch.from_arrays([*columns, *states], names=[*keys, "n", "mean", "m2"])

        for batch in batches:
            types = [c.type for c in batch.columns[:-1]]
            values, whose = batch.column(len(keys)), list(zip(*(c.to_pylist() for c in batch.columns[:-1]))) if keys else [()] * batch.num_rows
            flat, offsets = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64), values.offsets.to_numpy() - values.offsets[0].as_py()
            of: dict = {}
            for k, key in enumerate(whose):
                of.setdefault((key, int(offsets[k + 1] - offsets[k])), []).append(k)
            for (key, size), places in of.items():
                x = flat[offsets[places][:, None] + np.arange(size)]
                mean = x.mean(0)
                own = len(x), mean, ((x - mean) ** 2).sum(0)
                if key in held and len(held[key][1]) != size:
                    raise ValueError("the vectors of a group are of different lengths")
                held[key] = _merge(held[key], own) if key in held else own
            if len(held) >= HELD_GROUPS:
                yield flush()
                held = {}
        if held:
            yield flush()

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "n long, mean array<double>, m2 array<double>"])
    states = rows.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("_v")).mapInArrow(run, schema)
    parted = states.withColumn("_part", F.spark_partition_id() % PARTS)
    first = parted.groupBy(*keys, "_part").applyInArrow(lambda t: _merged(t.select([*keys, "n", "mean", "m2"]), len(keys)), schema)
    return first.groupBy(*keys).applyInArrow(lambda t: _merged(t, len(keys)), schema)


def _beside_moments(rows: DataFrame, vector: str, by: tuple[str, ...]) -> DataFrame:
    """Rows with ``_mean`` and ``_m2`` and ``_n`` of their group.  Few groups' states are broadcast, so that a common group is
    not gathered; more of them are joined."""
    found = moments(rows, vector, *by).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("m2").alias("_m2"))
    found = Scratch(rows.sparkSession, "moments").keep(found, "moments")
    if found.agg(F.coalesce(F.sum(F.size("_mean")), F.lit(0))).first()[0] <= MAX_MEANS:
        found = F.broadcast(found)
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(found, same).drop(*[f"_by_{c}" for c in by])


def mean_norm(rows: DataFrame, vector: str, *by: str) -> DataFrame:
    """Rows with ``normalized``: vectors less the mean, per dimension, of their group."""
    return _beside_moments(rows, vector, by).withColumn("normalized", F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m)).drop("_n", "_mean", "_m2")


def mean_var_norm(rows: DataFrame, vector: str, *by: str, epsilon: float = 1e-10) -> DataFrame:
    """Rows with ``normalized``: vectors less their group's mean, over the root of its variance plus ``epsilon``."""
    scale = F.transform("_m2", lambda m2: F.sqrt(m2 / F.col("_n") + epsilon))
    centred = F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m)
    return _beside_moments(rows, vector, by).withColumn("normalized", F.zip_with(centred, scale, lambda x, s: x / s)).drop("_n", "_mean", "_m2")


def sentence_norm(frames: Column) -> Column:
    """Frames less their own utterance's mean frame."""
    n = F.size(frames)
    zero = F.transform(frames[0], lambda x: F.lit(0.0))
    total = F.aggregate(frames, zero, lambda s, f: F.zip_with(s, f, lambda a, b: a + b.cast("double")))
    return F.transform(frames, lambda f: F.zip_with(f, total, lambda x, t: x.cast("double") - t / n))


def frame_means(samples: DataFrame, by: str, order: str, value: str, size: int, hop: int) -> DataFrame:
    """Rows (``by``, frame, n, mean) of the complete frames of ``size`` samples, every ``hop`` samples, of each series.

    Samples are ranked over all series at once, so a long series spreads over tasks.  A sample is counted into each of the
    frames that hold it, so frames need no window as long as they are.  ``order`` is unique within a series.
    """
    ranked = ordered_rank(samples.select(by, order, value), [F.col(by), F.col(order)], "_n", "frame-means")
    begin = ranked.groupBy(F.col(by).alias("_by")).agg(F.min("_n").alias("_begin"))
    placed = ranked.join(begin, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_p", F.col("_n") - F.col("_begin"))
    last = F.expr(f"_p div {hop}")
    first = F.greatest(F.lit(0), F.ceil((F.col("_p") - (size - 1)) / hop))
    each = placed.select(by, F.col(value).alias("_v"), F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("frame"))
    return each.groupBy(by, "frame").agg(F.count("*").alias("n"), F.avg("_v").alias("mean")).where(F.col("n") == size)
