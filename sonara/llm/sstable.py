"""Token ids in sorted-string-table shards: documents keyed by id, found by binary search.

One shard file holds one range of document ids in ascending order::

    block*  index  bloom  footer

    block   zstd of entries (shared, unshared, value bytes, key suffix, value); numbers are LEB128, ``shared`` counts the
            key bytes taken over from the entry before, values are ids of 2 or 4 little-endian bytes each
    index   per block: length of its first key, the key, offset, bytes stored, bytes unpacked (little-endian 64-bit)
    bloom   bits set for every key
    footer  struct ``FOOTER``: offsets and sizes of index and bloom, blocks, entries, ids, hashes, id bytes, magic

A key is the id as eight big-endian bytes with the sign bit flipped, so bytes sort as ids do; a null id has the empty
key.  Shards are written by tasks to the shared folder under names of their own attempt; only the files that successful
tasks report are ever read, so lost and repeated tasks do no harm.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch
from .tokens import TOKEN_CHUNK_BYTES, WordTokenizer

MAGIC = b"SNSST001"
FOOTER = struct.Struct("<QQQQQQQII8s")
_PLACE = struct.Struct("<QQQ")
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
_SIGN = 1 << 63


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + _SIGN).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - _SIGN if key else None


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a * 0x9E3779B97F4A7C15 + k * b * 0xD1342543DE82EF95 >> 13) % bits for k in range(hashes)]


class ShardWriter:
    """Writes entries, given in ascending key order, to an open stream."""

    def __init__(self, stream, id_bytes: int) -> None:
        self.stream, self.id_bytes = stream, id_bytes
        self.offset = self.ids = 0
        self.block, self.last = bytearray(), b""
        self.first: bytes | None = None
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must come in ascending order")
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _number(shared) + _number(len(key) - shared) + _number(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.first is None:
            return
        packed = pa.compress(bytes(self.block), codec="zstd", asbytes=True)
        self.stream.write(packed)
        self.index.append((self.first, self.offset, len(packed), len(self.block)))
        self.offset += len(packed)
        self.block, self.first, self.last = bytearray(), None, b""

    def close(self) -> None:
        self._flush()
        index = b"".join(_number(len(k)) + k + _PLACE.pack(*place) for k, *place in self.index)
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_bloom_places(key, bits, BLOOM_HASHES)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.stream.write(index)
        self.stream.write(packed)
        self.stream.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), len(packed), len(self.index), len(self.keys), self.ids, BLOOM_HASHES, self.id_bytes, MAGIC))


class ShardReader:
    """Looks up single documents, or reads all of them block by block."""

    def __init__(self, path: str) -> None:
        store, inner = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        at, index_bytes, bloom_at, bloom_bytes, blocks, self.entries, self.ids, self.hashes, self.id_bytes, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        raw, pos = self._at(at, index_bytes), 0
        self.first_keys: list[bytes] = []
        self.places: list[tuple[int, int, int]] = []
        for _ in range(blocks):
            n, pos = _read_number(raw, pos)
            self.first_keys.append(raw[pos : pos + n])
            self.places.append(_PLACE.unpack_from(raw, pos + n))
            pos += n + _PLACE.size
        self._bloom = (bloom_at, bloom_bytes)

    def _at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, stored, size = self.places[k]
        data = pa.decompress(self._at(offset, stored), size, codec="zstd", asbytes=True)
        at, key, kind = 0, b"", np.dtype(f"<u{self.id_bytes}")
        while at < size:
            shared, at = _read_number(data, at)
            own, at = _read_number(data, at)
            n, at = _read_number(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, kind, n // self.id_bytes, at).astype("<u4")
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.places)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def may_contain(self, key: bytes) -> bool:
        offset, n = self._bloom
        return all(self._at(offset + p // 8, 1)[0] >> p % 8 & 1 for p in _bloom_places(key, n * 8, self.hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key; empty if there is none."""
        key = key_of(doc_id)
        if not self.entries or not self.may_contain(key):
            return []
        found = []
        for k in range(max(0, bisect.bisect_left(self.first_keys, key) - 1), len(self.places)):
            if self.first_keys[k] > key:
                break
            found += [ids for other, ids in self._block(k) if other == key]
        return found

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, text: str = "text") -> DataFrame:
    """Encode every text and write shards in ascending id order; rows (shard, path, n_docs, n_ids), one per file.

    A null text counts as empty, so it has the end id alone.  Repeated ids all get entries, ordered by their texts;
    null ids come first.  An empty table writes no file.  Columns besides the id and the text are not stored.
    """
    scratch = Scratch(docs.sparkSession, "sstable")
    folder = folder or f"{scratch.root}/shards"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, writer = WordTokenizer.of(vocabulary), None
        wide = max(end_id + 1, len(tokenizer.ends_word)) > 1 << 16
        kind = np.dtype("<u4" if wide else "<u2")
        end = np.array([end_id], kind).tobytes()
        shard = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                path = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.sst"
                store, inner = fs.FileSystem.from_uri(path)
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                stream = store.open_output_stream(inner)
                writer = ShardWriter(stream, kind.itemsize)
            keys = batch.column(0).to_pylist()
            for chunk in K.chunks(batch.column(1), TOKEN_CHUNK_BYTES):
                ids, offsets = tokenizer.encode(chunk)
                body, at = ids.astype(kind).tobytes(), (offsets * kind.itemsize).tolist()
                for k in range(len(at) - 1):
                    writer.add(key_of(keys[chunk.first + k]), body[at[k] : at[k + 1]] + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (path, pa.string()), (len(writer.keys), pa.int64()), (writer.ids, pa.int64()))], names=["shard", "path", "n_docs", "n_ids"])

    ordered = docs.select("doc_id", F.col(text).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.keep(ordered.mapInArrow(run, "shard int, path string, n_docs long, n_ids long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of all shards; ``start`` counts the ids of all documents before."""
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):  # one small row per file
        rows.append((r["path"], start))
        start += r["n_ids"]
    placed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns)):
                reader, out = ShardReader(path), []
                for doc_id, ids in reader:
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                reader.close()
                yield _rows(out)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
