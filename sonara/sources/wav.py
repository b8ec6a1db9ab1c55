"""WAV files: discovery, headers, samples, snapshots of a directory tree, writing."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Iterator
from contextlib import AbstractContextManager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import merged_state, multiset_state
from ..functions.text import parent_name
from ..scratch import Scratch, settings


#: Tasks that list folders.
LISTERS = 200
#: Bytes that opening a file counts for when files are dealt to tasks.  Spark's 4 MB give a task 32 small files, and to start
#: it takes longer than to read them.
OPEN_COST = 64 << 10
#: Bytes of files that a task reads of a tree that tasks have listed, and bytes of them that it hands on at once.
TASK_BYTES, READ_BYTES = 128 << 20, 4 << 20
#: Entries of a folder that are handed on at once.
ENTRIES = 10_000
#: First bytes of a file, which tell all if its ``fmt`` chunk is a plain one and its data follow.
HEAD = 44


def discover(spark: SparkSession, root: str, expected: int | None = None) -> DataFrame:
    """Rows (path, speaker_id, size, modified, content) of all ``.wav`` files below ``root``, whatever the case of the suffix.

    ``path`` is relative; content is only read by queries that use it.  With ``expected`` another number is an error.

    A folder that driver and executors share as a local one is listed by tasks, level by level, and its list is a table, so
    the driver never holds it.  In other stores Spark's file source lists it, which keeps the list in the driver.
    """
    base = root.rstrip("/")
    if (folder := _local_folder(spark, base)) is not None:
        return _listed(spark, folder, base, expected)
    # Folders are listed by tasks; left alone, Spark makes a task for each of up to 10,000 of them.
    with settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(LISTERS)}):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(base)
    path = F.element_at(F.split("path", f"\\Q{base.removeprefix('file://')}\\E/", 2), -1)
    found = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content").withColumn("speaker_id", parent_name(F.col("path")))
    if expected is not None:
        _as_expected(found.select("path").count(), expected)
    return found


def _as_expected(n: int, expected: int | None) -> None:
    if expected is not None and n != expected:
        raise ValueError(f"{n} WAV files where {expected} are expected")


def _local_folder(spark: SparkSession, root: str) -> str | None:
    """The path of a root that is a folder of the local file system; None for patterns and whatever else Spark may read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file" or not store.exists(path) or not store.getFileStatus(path).isDirectory():
        return None
    return store.makeQualified(path).toUri().getPath()


def _hidden(name: str) -> bool:
    """Whether Spark's file sources pass over a name."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))


def _listed(spark: SparkSession, folder: str, root: str, expected: int | None) -> DataFrame:
    schema = pa.schema([("path", pa.string()), ("inner", pa.bool_()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for inner in batch.column(0).to_pylist():
                with os.scandir(f"{folder}/{inner}") as found:
                    for e in found:
                        name = f"{inner}/{e.name}" if inner else e.name
                        if _hidden(e.name):
                            continue
                        if e.is_dir():
                            rows.append((name, True, None, None))
                        elif e.name[-4:].lower() == ".wav" and (stat := e.stat()).st_size:  # Spark's file sources pass over empty files
                            rows.append((name, False, stat.st_size, stat.st_mtime_ns // 1000))
                        if len(rows) == ENTRIES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    scratch, cores = Scratch(spark, "wav-listing"), spark.sparkContext.defaultParallelism
    folders, levels = spark.range(1, numPartitions=1).select(F.lit("").alias("path")), []
    while not levels or folders.take(1):
        levels.append(scratch.keep(folders.mapInArrow(entries, "path string, inner boolean, size long, modified timestamp"), "entries"))
        folders = levels[-1].where("inner").select("path").repartition(2 * cores)
    files = reduce(DataFrame.unionByName, levels).where("not inner").select("path", "size", "modified")
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    _as_expected(n, expected)
    dealt = files.repartition(max(1, min(n, max(cores, -(-total // TASK_BYTES)))))

    @F.pandas_udf("binary")
    def read(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in paths:
            out, held = [], 0
            for path in batch:
                with open(f"{folder}/{path}", "rb") as f:
                    out.append(f.read())
                if (held := held + len(out[-1])) >= READ_BYTES:
                    yield pd.Series(out, dtype=object)
                    out, held = [], 0
            if out:
                yield pd.Series(out, dtype=object)

    found = dealt.withColumn("content", read("path")).withColumn("speaker_id", parent_name(F.col("path")))
    found._wav_folder = folder
    return found


def few_tasks(spark: SparkSession) -> AbstractContextManager:
    """While the block runs, files are dealt to tasks by their bytes rather than their number."""
    return settings(spark, {"spark.sql.files.openCostInBytes": str(OPEN_COST)})


def keep(rows: DataFrame, name: str) -> DataFrame:
    """Rows that are made of many files, worked out once by few tasks and kept."""
    with few_tasks(rows.sparkSession):
        return Scratch(rows.sparkSession, "wav").keep(rows, name)


def headers(files: DataFrame) -> DataFrame:
    """Rows (path, speaker_id, sample_rate, num_channels, num_samples, sample_width, compression) from the files' headers.

    The numbers of an unreadable file are null; ``compression`` is 1 for plain PCM.  The files are read once, at once.
    """
    folder = getattr(files, "_wav_folder", None)

    def header(data: bytes | None) -> tuple:
        try:
            with wave.open(io.BytesIO(data), "rb") as w:
                return (w.getframerate(), w.getnchannels(), w.getnframes(), w.getsampwidth(), 1 if w.getcomptype() == "NONE" else 0)
        except (wave.Error, EOFError, TypeError):
            return (None,) * 5

    def opened(path: str) -> tuple:
        with open(f"{folder}/{path}", "rb") as f:
            data = f.read(HEAD)
            return header(data if data[12:20] == b"fmt \x10\0\0\0" and data[36:40] == b"data" and len(data) == HEAD else data + f.read())

    one = opened if folder else header

    @F.pandas_udf("sample_rate int, num_channels int, num_samples int, sample_width int, compression int")
    def read(given: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in given:
            yield pd.DataFrame([one(x) for x in batch], columns=["sample_rate", "num_channels", "num_samples", "sample_width", "compression"], dtype="Int32")

    if folder:
        return keep(files.withColumn("_h", read("path")).select("path", "speaker_id", "_h.*"), "headers")
    # Files that are not plain go to Python whole.
    plain = (F.substring("content", 13, 8) == F.lit(b"fmt \x10\0\0\0")) & (F.substring("content", 37, 4) == F.lit(b"data")) & (F.octet_length("content") >= HEAD)
    return keep(files.withColumn("_h", read(F.when(plain, F.substring("content", 1, HEAD)).otherwise(F.col("content")))).select("path", "speaker_id", "_h.*"), "headers")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def samples(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """PCM16 samples in [-1, 1) of mono files; null for anything else."""
    for batch in content:
        out = []
        for data in batch:
            try:
                with wave.open(io.BytesIO(data), "rb") as w:
                    fits = w.getnchannels() == 1 and w.getsampwidth() == 2
                    out.append((np.frombuffer(w.readframes(w.getnframes()), "<i2") / 32768).astype(np.float32) if fits else None)
            except (wave.Error, EOFError, TypeError):
                out.append(None)
        yield pd.Series(out)


@F.pandas_udf(T.StructType().add("n", T.IntegerType()).add("total", T.LongType()))
def sample_totals(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Number of samples, and their sum as 16-bit numbers."""
    for batch in values:
        rows = [(None, None) if x is None else (len(x), int(np.rint(np.asarray(x, np.float64) * 32768).sum())) for x in batch]
        yield pd.DataFrame(rows, columns=["n", "total"], dtype="Int64")


def snapshot(files: DataFrame) -> DataFrame:
    """One row (n_rows, lane0 to lane3): the state of the tree's paths, sizes and times of change.  Equal states mean equal
    trees; what was added or removed since can be worked in without the rest (``updated_snapshot``)."""
    return multiset_state(files, "path", "size", "modified")


def updated_snapshot(before: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The snapshot after files (path, size, modified) were added and others, as they were, removed."""
    return merged_state(before, *([snapshot(added)] if added else []), removed=(snapshot(removed),) if removed else ())


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (path, change) between two listings: ``added``, ``removed`` or ``modified``."""
    b = before.select("path", F.struct("size", "modified").alias("_b"))
    a = after.select("path", F.struct("size", "modified").alias("_a"))
    both = b.join(a, "path", "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def write(waves: DataFrame, root: str) -> DataFrame:
    """Write rows (path, rate, samples: array of 16-bit numbers) as mono WAV files below ``root``; rows (path, size).

    Files are written where the rows are, each in one go, so a task that runs again puts the same file in place of its own.
    The result is kept, so reading it again writes nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root.rstrip("/"))
        for batch in batches:
            sizes, values = [], batch.column(2)
            for k, (path, rate) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:2]))):
                samples = values[k].values.to_numpy(zero_copy_only=False)
                if samples.size and not (-32768 <= samples.min() and samples.max() <= 32767):  # false for a null too, which is NaN
                    raise ValueError(f"{path}: samples must be 16-bit numbers")
                body = io.BytesIO()
                with wave.open(body, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(rate)
                    w.writeframes(samples.astype("<i2").tobytes())
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(body.getvalue())
                sizes.append(len(body.getvalue()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])

    return Scratch(waves.sparkSession, "wav-write").keep(waves.select("path", F.col("rate").cast("int"), F.col("samples").cast("array<int>")).mapInArrow(run, "path string, size long"), "written")
