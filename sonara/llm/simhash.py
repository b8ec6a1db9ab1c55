"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A document's fingerprint has a bit set where more than half of its shingles' XXH64 values have it.  Two fingerprints link
if at most four of their 64 bits differ, so at least four of their eight bytes are equal at the same position: that is the
guaranteed minimum of matches.

*Index.*  Equal fingerprints are one class, represented by its least document.  Each class is posted under every three of
its first seven positional bytes, since four equal positions of eight leave three among those.  Where a posting list is
longer than ``SHORT_LISTS`` its entries are posted anew with each further byte behind the three, up to the four that are
guaranteed.

*Count filter.*  Within a list, a pair's shared positional bytes are tallied; it is a candidate if the tally reaches four
and the list is the one of the first bytes that the pair shares, so every pair comes up once.  Candidates are verified on
all bits.

*Dense lists.*  Lists that are still too long after four bytes hold fingerprints of great likeness, whose pairs would grow
with the square of a group.  They are linked without pairs, and exactly: two fingerprints differ in at most four bits if
and only if some value lies within two bits of both.  Every member is posted under the 2081 values within two bits of it,
and the members under one value, 2081 at most, are linked to the least of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch
from .components import components

BYTES, BITS = 8, 64
#: Bits in which linked fingerprints may differ, and the bytes that they share at least.
MOST_BITS = 4
LEAST_SHARED = BYTES - MOST_BITS
#: Longest posting lists whose pairs are formed, by the number of bytes in their keys.
SHORT_LISTS = {3: 64, 4: 512}
#: Hashes whose bits are counted at once.
SLICE = 1 << 15
SEED = 42


def fingerprints(chunk: K.Chunk, n: int) -> np.ndarray:
    """The fingerprint of each document of a chunk: over all its ``n``-word shingles, repeats included; a text of fewer
    words has its whole sequence as one, and a text without words the fingerprint zero."""
    from xxhash import xxh64_intdigest

    w = K.words(chunk, lower=True)
    body, counts = K._LOWER[chunk.data].tobytes(), np.diff(w.bounds)
    # Words laid end to end with one space between, so that every shingle is a span of bytes.
    joined = b" ".join(b" ".join(body[a:b].split()) for (a, b), c in zip(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist()), counts.tolist()) if c)
    end = np.cumsum(w.end - w.start + 1) - 1
    start = end - (w.end - w.start)
    shingles = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), shingles)
    first = K.ragged(w.bounds[:-1], shingles)
    last = first + np.minimum(n, counts)[doc] - 1
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist())], np.uint64)
    votes = np.zeros((len(counts), BITS), np.int64)
    for lo in range(0, len(hashes), SLICE):
        part, own = hashes[lo : lo + SLICE], doc[lo : lo + SLICE]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1)
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        votes[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > shingles[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _with_fingerprints(docs: DataFrame, n: int, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                prints = fingerprints(chunk, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(prints)), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("_text")).mapInArrow(run, "doc_id long, print long")


def _byte(p: Column | int) -> Column:
    """A fingerprint's byte at position p; a column for the position asks for the SQL function."""
    return F.expr(f"shiftrightunsigned(print, {8 * p}) & 255") if isinstance(p, int) else F.call_function("shiftrightunsigned", F.col("print"), p * 8).bitwiseAND(F.lit(255))


def _posted(classes: DataFrame, width: int = 3) -> DataFrame:
    """Rows (key, upto, print, node): each class under ``width`` of its first bytes.

    A key is the set of positions, as bits, before the bytes there; ``upto`` has the bits of all positions up to the last.
    """
    lists = []
    for places in combinations(range(BYTES - LEAST_SHARED + width), width):
        key = reduce(lambda k, p: F.shiftleft(k, 8).bitwiseOR(_byte(p)), places, F.lit(sum(1 << p for p in places)).cast("long"))
        lists.append(F.struct(key.alias("key"), F.lit((2 << places[-1]) - 1).alias("upto")))
    return classes.select("print", "node", F.explode(F.array(*lists)).alias("l")).select("l.key", "l.upto", "print", "node")


def _lengthened(entries: DataFrame, width: int) -> DataFrame:
    """Entries of lists of ``width`` bytes under each further byte behind these."""
    further = F.sequence(F.length(F.bin("upto")), F.lit(BYTES - LEAST_SHARED + width).cast("int"))
    each = entries.where(F.col("upto") < (1 << BYTES) - 1).select("key", "print", "node", F.explode(further).alias("p")).withColumn("p", F.col("p").cast("int"))
    places = F.shiftrightunsigned("key", 8 * width).bitwiseOR(F.expr("shiftleft(1L, p)"))
    bytes_of = F.shiftleft(F.col("key").bitwiseAND(F.lit((1 << 8 * width) - 1)), 8).bitwiseOR(_byte(F.col("p")))
    return each.select(F.shiftleft(places, 8 * width + 8).bitwiseOR(bytes_of).alias("key"), F.expr("shiftleft(2, p) - 1").alias("upto"), "print", "node")


def _pairs(entries: DataFrame, width: int) -> DataFrame:
    """Links (a, b) within lists: tallied, retained at the guaranteed minimum, verified."""
    other = entries.select(F.col("key").alias("_key"), F.col("print").alias("_print"), F.col("node").alias("_node"))
    differ = "(print ^ _print)"
    equal = " + ".join(f"if({differ} & {0xFF << 8 * p if p < 7 else '-72057594037927936L'} = 0, {1 << p}, 0)" for p in range(BYTES))
    tally = f"({equal})"
    first = f"{tally} & upto = shiftrightunsigned(key, {8 * width})"
    met = entries.hint("merge").join(other, F.expr(f"key = _key and print < _print and bit_count({differ}) <= {MOST_BITS} and {first} and bit_count({tally}) >= {LEAST_SHARED}"))
    return met.select(F.col("node").alias("a"), F.col("_node").alias("b"))


def _balls(members: DataFrame) -> DataFrame:
    """Links (a, b) of members (print, node) by the values within half of ``MOST_BITS`` bits of them."""
    masks = [sum(1 << k for k in bits) for r in range(MOST_BITS // 2 + 1) for bits in combinations(range(BITS), r)]
    signed = F.from_json(F.lit(json.dumps(np.array(masks, np.uint64).view(np.int64).tolist())), "array<long>")
    spread = members.select("node", "print", F.explode(signed).alias("m"))
    met = spread.groupBy(F.col("print").bitwiseXOR(F.col("m")).alias("value")).agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)  # a ball's size at most
    return met.select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b")).where("a != b").distinct()


def links(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between classes (print, node) that differ in at most ``MOST_BITS`` bits: every pair of short lists, and
    for members of dense lists enough of theirs to reach whatever they link with."""
    found, width = [], LEAST_SHARED - 1
    entries = _posted(classes, width)
    while True:
        sizes = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select(F.col("key").alias("_key"), "m")
        # Spark sizes exploded rows by those they come from, some tenths of what they are, and would send them to the driver.
        shared = scratch.keep(entries.hint("merge").join(sizes, F.col("key") == F.col("_key")).drop("_key"), "postings")
        found.append(_pairs(shared.where(F.col("m") <= SHORT_LISTS[width]).drop("m"), width))
        left = shared.where(F.col("m") > SHORT_LISTS[width]).drop("m")
        if width == LEAST_SHARED:
            break
        entries, width = _lengthened(left, width), width + 1
    found.append(_balls(left.select("print", "node").distinct()))
    return reduce(DataFrame.unionByName, found)


def near_duplicate_components(docs: DataFrame, n: int = 4, text: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) of all documents.

    ``fingerprint`` is in 16 hex digits; ``component_id`` is the least id reachable by links, the document's own included.
    Null, empty and wordless texts have the fingerprint zero, which links like any other.  Rows with the same id are one
    node: what either links with, both reach.  A row without an id has a null component and is nobody's link.  An empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(_with_fingerprints(docs, n, text), "fingerprints")
    classes = scratch.keep(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node")), "classes")
    classed = prints.join(classes.withColumnRenamed("print", "_print"), F.col("print") == F.col("_print"), "left").drop("_print")
    # Rows of one id in several classes tie these together.
    several = classed.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select(F.col("doc_id").alias("_id"))
    tied = classed.join(several, F.col("doc_id") == F.col("_id"), "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    of_node = components(links(classes, scratch).unionByName(tied), scratch).withColumnRenamed("node", "_node")
    named = classes.join(of_node, F.col("node") == F.col("_node"), "left").select(F.col("print").alias("_print"), F.coalesce("component", "node").alias("component"))
    rows = prints.join(named, F.col("print") == F.col("_print"), "left")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
