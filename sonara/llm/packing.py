"""Sum-of-squares packing of token pieces into fixed-length training sequences.

Documents are encoded and cut into pieces where they are read.  The pieces (a few numbers each) are then dealt by hash
into groups of bounded size, and each group is packed by one task, longest pieces first: a piece goes where the sum over
residual gaps of the squared number of open sequences becomes smallest, be that an open sequence or a new one.
Sequences that stay clearly short are packed again as pieces, in ever fewer groups, so that the loss does not grow with
the number of groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch
from .tokens import TOKEN_CHUNK_BYTES, WordTokenizer

#: Pieces packed by one task.
GROUP_PIECES = 20_000
#: Sequences filled less than this take part in another round.
SHORT_FILL = 0.97


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, text: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids with the end id, cut only where they exceed
    ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = WordTokenizer.of(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for chunk in K.chunks(batch.column(1), TOKEN_CHUNK_BYTES):
                ids, offsets = tokenizer.encode(chunk)
                sizes = np.diff(offsets) + 1
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = K.ragged(np.zeros(len(sizes), np.int64), pieces)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                body, at = ids.astype("<u4").tobytes(), offsets.tolist()
                crc = [
                    zlib.crc32(end, zlib.crc32(body[4 * (at[d] + s) : 4 * (at[d] + s + n - 1)])) if s + n == size else zlib.crc32(body[4 * (at[d] + s) : 4 * (at[d] + s + n)])
                    for d, s, n, size in zip(doc.tolist(), start.tolist(), length.tolist(), sizes[doc].tolist())
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + chunk.first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col(text).cast("string").alias("_text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, pieces being placed in the order given.

    Each goes where the sum over gaps of the squared number of open sequences with that gap ends up smallest; opening a
    sequence is one of the choices, and full ones are not open.  Ties go to the least gap left, a new sequence last; of
    sequences with one gap the latest is taken.
    """
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    used: list[int] = []
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        # What the sum changes by: a gap g that becomes g - n, one that is filled, and a new one of capacity - n.
        gaps = count[n:]
        change = np.where(gaps > 0, 2 * (count[: capacity + 1 - n] - gaps) + 2, 2 * len(lengths) + 3)
        change[0] -= 1
        best = int(change.argmin())
        new = 2 * int(count[capacity - n]) + 1 if n < capacity else 0
        if gaps[best] > 0 and change[best] <= new:
            gap = best + n
            at = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, at = capacity, len(used)
            used.append(0)
        sequence[k], offset[k] = at, used[at]
        used[at] += n
        if gap - n:
            open_at[gap - n].append(at)
            count[gap - n] += 1
    return sequence, offset


def _pack(items: DataFrame, scratch: Scratch, capacity: int, name: str, total: int | None = None) -> tuple[DataFrame, int]:
    """``items`` (item, length) with ``bin`` and ``bin_offset``; and the number of groups."""
    total = items.count() if total is None else total
    groups = max(1, -(-total // GROUP_PIECES))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("item", "ascending")])
        sequence, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        return table.select(["item", "length"]).append_column("bin", pa.array(sequence * groups + table.column("_group").to_numpy())).append_column("bin_offset", pa.array(offset))

    dealt = items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("_group"))
    packed = dealt.groupBy("_group").applyInArrow(run, "item long, length long, bin long, bin_offset long")
    return scratch.keep(packed, name), groups


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one and holds the end id alone.  Null and repeated ids keep a row for each of their pieces;
    ties in length are placed in the order of an internal number.  An empty table gives an empty result; other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(cut_pieces(docs, vocabulary, capacity, end_id, text).withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed, groups = _pack(pieces.select("item", "length"), scratch, capacity, "placed")
    for step in range(3):
        fills = placed.groupBy("bin").agg(F.sum("length").alias("length"))
        short = scratch.keep(fills.where(F.col("length") <= int(SHORT_FILL * capacity)).select(F.col("bin").alias("item"), "length"), "short")
        left = short.count()
        if left < 2:
            break
        merged, groups = _pack(short, scratch, capacity, "merged", left)
        moves = merged.select(F.col("item").alias("_from"), (-1 - F.col("bin")).alias("_to"), F.col("bin_offset").alias("_shift"))
        placed = scratch.keep(
            placed.join(moves, F.col("bin") == F.col("_from"), "left").select(
                "item", "length",
                F.when(F.col("_from").isNull(), F.col("bin")).otherwise(F.col("_to") - F.lit(1 << 40) * step).alias("bin"),
                (F.col("bin_offset") + F.coalesce("_shift", F.lit(0))).alias("bin_offset"),
            ),
            "placed",
        )
        if groups == 1:
            break
    where = placed.select(F.col("item").alias("_item"), F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    return pieces.join(where, F.col("item") == F.col("_item")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
