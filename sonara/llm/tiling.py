"""Benchmark decontamination by greedy string tiling.

Texts are compared as sequences of words without case (of ASCII and Latin-1 letters) and ASCII punctuation.  Runs of ``min_match`` words that a
document shares with a test item are the seeds; only (document, item) pairs whose seeds could cover enough of the item
are tiled.  Tiling marks the longest matches first, found by Karp-Rabin hashes at falling search lengths, and never
uses a word of either side twice, so passages count in whatever order they come.  An item's coverage is the share of
its words in tiles.

The test items are broadcast in slices of bounded size and coverage depends on one document and one item only, so any
number of items is handled by more passes; documents are never shuffled and no group of them meets in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, packed_rows

#: Words of test items broadcast at once.
SLICE_WORDS = 2_000_000

#: Bytes after folding ASCII case; ASCII punctuation and control characters separate words.
FOLD = K._LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def fold(data: np.ndarray) -> np.ndarray:
    """Texts' bytes with the case of ASCII and Latin-1 letters folded and ASCII punctuation blanked."""
    out = FOLD[data]
    if len(data) > 1:
        second = data[1:]
        upper = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        out[1:][upper] += 0x20
    return out


def folded_words(chunk: K.Chunk) -> K.Words:
    return K.words(K.Chunk(chunk.first, fold(chunk.data), chunk.offsets))


class ItemSlice:
    """Test items as word hashes, with their seeds sorted for lookup."""

    def __init__(self, ids: list, texts: list[str | None], min_match: int) -> None:
        self.min_match, self.ids, self.items = min_match, [], []
        hashes, owner, place = [], [], []
        for chunk in K.chunks(pa.array(texts, pa.string())):
            w = folded_words(chunk)
            for d in range(len(w.bounds) - 1):
                item = w.hash[w.bounds[d] : w.bounds[d + 1]]
                if len(item) < min_match:
                    continue
                first = np.arange(len(item) - min_match + 1)
                hashes.append(K.run_hash(item, first, first + min_match))
                owner.append(np.full(len(first), len(self.items)))
                place.append(first)
                self.ids.append(ids[chunk.first + d])
                self.items.append(item)
        if self.items:
            seeds = np.concatenate(hashes)
            order = np.argsort(seeds, kind="stable")
            self.seeds, self.owner, self.place = seeds[order], np.concatenate(owner)[order], np.concatenate(place)[order]

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexes into ``hashes``, items and places in them, of all shared seeds."""
        lo = np.searchsorted(self.seeds, hashes, side="left")
        hit = np.flatnonzero(self.seeds[np.minimum(lo, len(self.seeds) - 1)] == hashes)
        lo = lo[hit]
        n = np.searchsorted(self.seeds, hashes[hit], side="right") - lo
        at = K.ragged(lo, n)
        return np.repeat(hit, n), self.owner[at], self.place[at]


def tile(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, words) of two word-hash sequences."""
    tiles: list[tuple[int, int, int]] = []
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)

    def windows(free: np.ndarray, n: int) -> np.ndarray:
        """Starts of the n-word windows without a marked word."""
        if len(free) < n:
            return np.zeros(0, np.int64)
        taken = np.r_[0, np.cumsum(~free)]
        return np.flatnonzero(taken[n:] == taken[:-n])

    search = max(min_match, len(item))
    while True:
        mine, theirs = windows(free_item, search), windows(free_text, search)
        found = []
        if len(mine) and len(theirs):
            ours, other = K.run_hash(item, mine, mine + search), K.run_hash(text, theirs, theirs + search)
            order = np.argsort(ours, kind="stable")
            lo, hi = np.searchsorted(ours[order], other, "left"), np.searchsorted(ours[order], other, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                for i in mine[order[lo[k] : hi[k]]].tolist():
                    j, n = int(theirs[k]), search
                    if not np.array_equal(item[i : i + n], text[j : j + n]):
                        continue
                    while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_item[i + n] and free_text[j + n]:
                        n += 1
                    found.append((n, i, j))
        # Longest first.  A match that a tile has cut comes back with its free beginning; a free end has an entry of its own.
        heap = [(-n, i, j) for n, i, j in found]
        heapq.heapify(heap)
        while heap:
            n, i, j = heapq.heappop(heap)
            free = free_item[i : i - n] & free_text[j : j - n]
            if free.all():
                free_item[i : i - n] = free_text[j : j - n] = False
                tiles.append((i, j, -n))
            elif (left := int(free.argmin())) >= search:
                heapq.heappush(heap, (-left, i, j))
        if search == min_match:
            return tiles
        search = max(min_match, search // 2)


def _coverages(chunk: K.Chunk, items: ItemSlice, threshold: float) -> list[tuple[int, int, int, int]]:
    """(document, item, tiles, words in tiles) of the pairs of a chunk that reach the threshold."""
    w, m = folded_words(chunk), items.min_match
    first, doc = K.window_starts(w.bounds, m)
    at, owner, place = items.hits(K.run_hash(w.hash, first, first + m))
    out: list[tuple[int, int, int, int]] = []
    if not len(at):
        return out
    order = np.lexsort((first[at], owner, doc[at]))
    at, owner, place = at[order], owner[order], place[order]
    cut = np.flatnonzero(np.r_[True, (doc[at][1:] != doc[at][:-1]) | (owner[1:] != owner[:-1])])
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
        d, item = int(doc[at[lo]]), items.items[owner[lo]]
        reach = np.zeros(len(item), bool)
        reach[(place[lo:hi, None] + np.arange(m)).ravel()] = True
        if reach.sum() < threshold * len(item):
            continue
        seeds = np.unique(first[at[lo:hi]])
        # Only words in seeds can be in tiles; a gap between runs of seeds becomes one word that matches nothing.
        used = np.unique((seeds[:, None] + np.arange(m)).ravel())
        runs = np.split(w.hash[used], np.flatnonzero(np.diff(used) > 1) + 1)
        text = np.concatenate([x for run in runs for x in (run, np.zeros(1, np.uint64))])
        tiles = tile(item, text, m)
        words = sum(n for _, _, n in tiles)
        if words >= threshold * len(item):
            out.append((d, int(owner[lo]), len(tiles), words))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, coverage, n_tiles) of the pairs whose tiles cover ``threshold`` of the item or more.

    Null and empty texts match nothing, nor do items of under ``min_match`` words; each of several equal documents or
    items gets rows of its own; an empty table gives an empty result; other columns are ignored.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    arrow = docs.select("doc_id").limit(0).toArrow().schema.field(0).type, benchmark.select("item_id").limit(0).toArrow().schema.field(0).type
    schema = f"doc_id {kind}, item_id {item_kind}, coverage double, n_tiles int"
    spark, scratch, found = docs.sparkSession, Scratch(docs.sparkSession, "tiling"), []

    def search(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: ItemSlice = shared.value
            for batch in batches:
                rows = [(chunk.first + d, *x) for chunk in K.chunks(batch.column(1)) for d, *x in _coverages(chunk, known, threshold)]
                if rows:
                    d, item, tiles, words = map(np.array, zip(*rows))
                    share = words / np.array([len(known.items[k]) for k in item])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(d)).cast(arrow[0]), pa.array([known.ids[k] for k in item], arrow[1]), pa.array(share), pa.array(tiles.astype(np.int32))],
                        names=["doc_id", "item_id", "coverage", "n_tiles"],
                    )

        return docs.select("doc_id", F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)

    def slices() -> Iterator[ItemSlice]:
        ids, texts, size = [], [], 0
        for r in benchmark.select("item_id", "text").toLocalIterator():
            if size >= SLICE_WORDS:
                yield ItemSlice(ids, texts, min_match)
                ids, texts, size = [], [], 0
            ids.append(r[0])
            texts.append(r[1])
            size += len((r[1] or "").split())
        yield ItemSlice(ids, texts, min_match)

    # One slice is out at a time: all but the last are searched, and their broadcasts destroyed, before the next one is made.
    last = None
    for items in slices():
        if not items.items:
            continue
        if last is not None:
            found = found + [scratch.keep(search(last), "found")]
            last.destroy()
        last = spark.sparkContext.broadcast(items)
    found += [search(last)] if last is not None else []
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a contaminated pair, all columns unchanged, whatever their names.

    Null and empty texts stay, as do all documents if there are no items; rows of one id go together; an empty table
    gives an empty result.
    """
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_bad")).distinct()
    return packed_rows(docs, _id=F.col("doc_id")).join(bad, F.col("_id").eqNullSafe(F.col("_bad")), "left_anti").select("_row.*")
