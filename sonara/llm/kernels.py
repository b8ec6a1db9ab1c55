"""Vectorised text kernels shared by the corpus operators.

Every kernel works on one bounded chunk of documents at a time: the UTF-8 bytes of whole texts laid end to end plus
an offset per document.  Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; a null text counts as empty.
Hashes are 64 bits wide: bytes are folded with an odd multiplier (so that any substring's hash is a difference of
prefix sums) and then passed through an avalanche step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer document is handled alone.
CHUNK_BYTES = 1 << 19

_LIBC = ctypes.CDLL(None)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD_BYTE = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

#: Another value for each byte, for hashes that confirm the first ones.
_OTHER = np.random.default_rng(20240301).permutation(256).astype(np.uint8)

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64: kept for a chunk of usual size, made anew for a longer one."""

    def __init__(self, base: int) -> None:
        self._bases = [np.uint64(base), np.uint64(_inverse(base))]
        self._kept: list[np.ndarray] | None = None

    def _tables(self, size: int) -> list[np.ndarray]:
        tables = [np.full(size, base, np.uint64) for base in self._bases]
        for table in tables:
            table[0] = 1
            np.multiply.accumulate(table, out=table)
        return tables

    def upto(self, n: int) -> list[np.ndarray]:
        if n > CHUNK_BYTES:
            return self._tables(n + 1)
        if self._kept is None:
            self._kept = self._tables(CHUNK_BYTES + 1)
        return self._kept


_BYTE_POWERS = _Powers(_BYTE_BASE)
_WORD_POWERS = _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche step on 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Called when a batch is done: modules that keep tables in the worker let go of those that are no longer used.
WHEN_BATCH_DONE: list[Callable[[], None]] = []


def release_memory() -> None:
    """Give freed memory back to the system: Python workers stay alive between tasks, beside the executor's heap."""
    for call in WHEN_BATCH_DONE:
        call()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


class Chunk(NamedTuple):
    """Documents ``first`` to ``first + n - 1`` of a batch: their bytes and n + 1 offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Word k spans bytes ``start[k]:end[k]``; document d owns words ``bounds[d]:bounds[d + 1]``."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column of texts into chunks of whole documents of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Chunk(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    release_memory()


def words(chunk: Chunk, lower: bool = False) -> Words:
    """The words of a chunk with their hashes; ``lower`` folds A-Z first."""
    data, offsets = chunk.data, chunk.offsets
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD_BYTE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1]] = False
    start = np.flatnonzero(inside & ~before)
    after = inside[1:].copy()
    cuts = offsets[1:-1]
    after[cuts[(cuts > 0) & (cuts < len(data))] - 1] = False
    end = np.flatnonzero(inside[:-1] & ~after) + 1
    bounds = np.searchsorted(start, offsets)
    return Words(start, end, bounds, span_hash(data, start, end))


def second_hash(chunk: Chunk, w: Words) -> np.ndarray:
    """A hash of each word that is independent of ``w.hash``."""
    return span_hash(_OTHER[chunk.data], w.start, w.end)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span."""
    return span_hashes(data, start, [end])[0]


def span_hashes(data: np.ndarray, start: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of byte spans with the same starts and several ends."""
    power, inverse = _BYTE_POWERS.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=sums[1:])
    return [mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)) for end in ends]


def run_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run ``hashes[start:end]`` of word hashes, whatever its length."""
    power, inverse = _WORD_POWERS.upto(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def window_starts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all k-word windows that lie inside one document, and the document of each."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(len(doc)) - begin[doc] + bounds[:-1][doc], doc


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indexes ``start[i] .. start[i] + count[i] - 1`` of all i, laid end to end."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(start - begin, count)
