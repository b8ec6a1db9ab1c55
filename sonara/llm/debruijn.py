"""Substring deduplication by De Bruijn compaction.

Every ``span`` consecutive words are an edge of the De Bruijn graph over a corpus, from the node of its first
``span - 1`` words to that of its last ones.  An edge is *repeated* if its word sequence starts at two places or more,
and every word under a repeated edge is to go.  Counting all edges would move the whole corpus many times over, so
documents are first cut into runs of edges: consecutive edges that have the same minimizer (the least hash among the
short k-mers inside an edge, leftmost on ties).  A minimizer depends on the edge's words alone, so equal edges always
lie in runs of the same minimizer, and one run has at most ``span - seed + 1`` edges, no two of them equal.  Then, by
joins:

1. runs whose minimizer occurs once in the corpus cannot hold a repeated edge and drop out;
2. equal runs become one unit of the graph with a multiplicity; from two on, all their edges are repeated;
3. where a minimizer has different runs, one of each is opened into its edges, which are units of one edge, and counted;
4. repeated units are joined at their nodes: a node that one unit enters and one leaves is not branching, and paths over
   such nodes are contracted by pointer doubling, each unit finding the head of its path and its place behind it;
5. a path's units go back to their source coordinates (document, first word) and come out as one span each time it occurs.

Whether runs or edges are equal is decided on three 64-bit hashes of the words at their coordinates: the minimizer's, the
whole sequence's, and one over other word hashes that confirms it.  Documents with the same text are compacted before
all that: each of their edges is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, packed_rows

SPAN = 35
SEED = 10
_KEY = ["_doc", "_h1"]


def runs_of(w: K.Words, second: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, ...]:
    """(document, minimizer, hash, confirming hash, first word in the document, edges) of every run of a chunk."""
    first, doc = K.window_starts(w.bounds, span)
    if not len(first):
        empty = np.zeros(0, np.int64)
        return empty, *[empty.view(np.uint64)] * 3, empty, empty
    n = len(w.start)
    at = np.arange(n - seed + 1)
    value, place = K.run_hash(w.hash, at, at + seed), at
    width, seeds = 1, span - seed + 1
    while width < seeds:
        step = min(width, seeds - width)
        later = value[step:] < value[:-step]
        value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    value, place = value[first], place[first]
    cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    edges = np.diff(np.r_[cut, len(first)])
    begin = first[cut]
    end = begin + edges + span - 1
    return doc[cut], value[cut], K.run_hash(w.hash, begin, end), K.run_hash(second, begin, end), begin - w.bounds[doc[cut]], edges


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _identified(docs: DataFrame, text: str) -> DataFrame:
    """Documents with hashes and size of their texts."""
    t = F.col(text).cast("string")
    return docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(t).alias("_h1"), F.hash(t).alias("_h2"), F.coalesce(F.octet_length(t), F.lit(-1)).alias("_size"), t.alias("_text"))


def _scan(identified: DataFrame, span: int, seed: int) -> DataFrame:
    """Per document its words, the digest of all of them, and its runs as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(4)):
                w = K.words(chunk)
                doc, least, whole, check, begin, edges = runs_of(w, K.second_hash(chunk, w), span, seed)
                n = len(chunk.offsets) - 1
                bounds = np.searchsorted(doc, np.arange(n + 1))
                body = chunk.data.tobytes()
                digest = [hashlib.sha256(b" ".join(body[a:b].split())).hexdigest() for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(chunk.first, n) for c in batch.columns[:4]), pa.array(np.diff(w.bounds)), pa.array(digest),
                        _lists(least.view(np.int64), bounds, pa.int64()), _lists(whole.view(np.int64), bounds, pa.int64()), _lists(check.view(np.int64), bounds, pa.int64()), _lists(begin.astype(np.int32), bounds, pa.int32()), _lists(edges.astype(np.int32), bounds, pa.int32()),
                    ],
                    names=["_doc", "_h1", "_h2", "_size", "n_words", "digest", "least", "whole", "check", "begin", "edges"],
                )

    kind = dict(identified.dtypes)["_doc"]
    return identified.mapInArrow(run, f"_doc {kind}, _h1 long, _h2 int, _size int, n_words long, digest string, least array<long>, whole array<long>, check array<long>, begin array<int>, edges array<int>")


def _units(picked: DataFrame, identified: DataFrame, span: int) -> DataFrame:
    """Units of the graph from one run of each kind (least, whole, check, _doc, _h1, begin, edges, times, branches).

    Repeated kinds are units as they are, and branching ones are opened into their edges.  Rows (is_run, least, unit,
    check, source, target, n, times, _doc, _h1, at): ``source`` and ``target`` are the hashes of the nodes.
    """
    names = ["least", "whole", "check", "begin", "edges", "times", "branches"]
    wanted = picked.groupBy(*_KEY).agg(F.collect_list(F.struct(*names)).alias("runs"))
    texts = _join(identified.select(*_KEY, "_text"), wanted).select(*_KEY, "_text", *[f"runs.{c}" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[3:]]
            counts = np.diff(batch.column(3).offsets.to_numpy())
            starts = np.r_[0, np.cumsum(counts)]
            for chunk in K.chunks(batch.column(2)):
                w = K.words(chunk)
                second = K.second_hash(chunk, w)
                n_docs = len(chunk.offsets) - 1
                own = slice(starts[chunk.first], starts[chunk.first + n_docs])
                least, whole, check, begin, edges, times, branches = (x[own] for x in flat)
                doc = np.repeat(np.arange(n_docs), counts[chunk.first : chunk.first + n_docs])
                begin, edges = begin.astype(np.int64), edges.astype(np.int64)
                kept, opened = np.flatnonzero(times > 1), np.flatnonzero(branches)
                of = np.r_[kept, np.repeat(opened, edges[opened])]
                at, n = np.r_[begin[kept], K.ragged(begin[opened], edges[opened])], np.ones(len(of), np.int64)
                n[: len(kept)] = edges[kept]
                is_run = np.arange(len(of)) < len(kept)
                first = at + w.bounds[:-1][doc[of]]
                end = first + n + span - 1
                unit, confirm = K.run_hash(w.hash, first, end), K.run_hash(second, first, end)
                if not (np.array_equal(unit[is_run].view(np.int64), whole[kept]) and np.array_equal(confirm[is_run].view(np.int64), check[kept])):
                    raise RuntimeError("a run is not what was read at its coordinates before")
                nodes = [K.run_hash(w.hash, x, x + span - 1).view(np.int64) for x in (first, first + n)]
                row = pa.array(doc[of] + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(is_run), pa.array(least[of], pa.int64()), pa.array(unit.view(np.int64)), pa.array(confirm.view(np.int64)), *map(pa.array, nodes), pa.array(n.astype(np.int32)), pa.array(times[of], pa.int64()), batch.column(0).take(row), batch.column(1).take(row), pa.array(at.astype(np.int32))],
                    names=["is_run", "least", "unit", "check", "source", "target", "n", "times", "_doc", "_h1", "at"],
                )

    kind = dict(identified.dtypes)["_doc"]
    return texts.mapInArrow(run, f"is_run boolean, least long, unit long, check long, source long, target long, n int, times long, _doc {kind}, _h1 long, at int")


def contract_paths(units: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, head, behind) of the units (id, source, target, n) that lie behind others on a nonbranching path:
    ``head`` is the path's first unit, ``behind`` the number of edges before this one.

    A unit follows another at a node that no other unit enters or leaves.  Each round doubles how far back units see, so
    the number of rounds is the logarithm of the longest path.  Units on a closed path have no head and no row.
    """
    ends = units.select(F.col("source").alias("node"), F.lit(1).alias("leave"), F.lit(0).alias("enter")).unionByName(units.select(F.col("target").alias("node"), F.lit(0).alias("leave"), F.lit(1).alias("enter")))
    plain = ends.groupBy("node").agg(F.sum("leave").alias("leave"), F.sum("enter").alias("enter")).where("leave = 1 and enter = 1").select("node")
    before = units.select(F.col("target").alias("node"), F.col("id").alias("head"), F.col("n").cast("long").alias("behind"))
    after = units.select(F.col("source").alias("node"), "id")
    current = scratch.keep(plain.join(before, "node").join(after, "node").where("id != head").select("id", "head", "behind", F.lit(True).alias("moved")), "paths")
    settled, left = [], None
    while True:
        # Units whose head did not move are done; the others look up where their head's own one is.
        rows = reduce(DataFrame.unionByName, [*settled, current])
        further = rows.select(F.col("id").alias("_id"), F.col("head").alias("_head"), F.col("behind").alias("_behind"))
        seen = current.where("moved").join(further, F.col("head") == F.col("_id"), "left")
        settled.append(current.where("not moved"))
        current = scratch.keep(seen.select("id", F.coalesce("_head", "head").alias("head"), (F.col("behind") + F.coalesce("_behind", F.lit(0))).alias("behind"), F.col("_id").isNotNull().alias("moved")), "paths")
        before_this, left = left, current.where("moved").count()
        if left in (0, before_this):  # on open paths fewer units move each time
            break
    # What still moves goes round in circles.
    return scratch.keep(reduce(DataFrame.unionByName, [*settled, current.where("not moved")]).select("id", "head", "behind"), "contracted")


def _join(left: DataFrame, right: DataFrame, keys: list[str] = _KEY, how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the right side's keys go."""
    other = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r{k}"))
        on = same if on is None else on & same
    return left.join(other, on, how).drop(*[f"_r{k}" for k in keys])


class Repeats:
    """Where the repeated edges of ``docs`` lie.

    ``scanned``: _doc, _h1, _h2, _size, n_words, digest per row.  ``copied``: _h1, _h2, _size of texts that several rows
    have.  ``paths``: id, head and edges behind it of the repeated units on compacted paths.  ``spans``: _doc, _h1, and ``spans`` (first edge, edges) for the other rows that have repeated edges; such a
    row is the only one with its text.
    """

    def __init__(self, docs: DataFrame, span: int = SPAN, seed: int = SEED, text: str = "text") -> None:
        if not 0 < seed < span:
            raise ValueError("a minimizer is shorter than a span")
        self.span = span
        self.identified = _identified(docs, text)
        scratch = Scratch(docs.sparkSession, "debruijn")
        whole = ["_h1", "_h2", "_size"]
        scanned = scratch.keep(_scan(self.identified, span, seed), "runs")
        self.scanned = scanned.select("_doc", *whole, "n_words", "digest")
        copied = scratch.keep(scanned.groupBy(*whole).agg(F.count("*").alias("times"), F.min("_doc").alias("_source")).where("times > 1"), "copied")
        self.copied = copied.select(*whole)

        run = ["least", "whole", "check"]
        arrays = scanned.where(F.size("least") > 0).select("_doc", *whole, F.arrays_zip(*run, "begin", "edges").alias("runs"))
        sources = _join(arrays, copied, whole, "left").where("times is null or _doc <=> _source")
        runs = sources.select(*_KEY, F.coalesce("times", F.lit(1)).alias("times"), F.explode("runs").alias("r")).select(*_KEY, "times", "r.*")

        buckets = runs.groupBy("least").agg(F.sum("times").alias("total"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("total > 1")
        buckets = scratch.keep(buckets, "buckets")  # a plain table, so that Spark can split a minimizer that is very common
        again = scratch.keep(runs.join(buckets.select("least", (F.col("low") != F.col("high")).alias("branches")), "least"), "again")
        kinds = again.groupBy(*run).agg(F.sum("times").alias("times"), F.first("branches").alias("branches"), *[F.first(c).alias(c) for c in (*_KEY, "begin", "edges")])
        units = scratch.keep(_units(scratch.keep(kinds.where("branches or times > 1"), "kinds"), self.identified, span), "units")

        # Repeated units: runs of several places, and edges that several runs hold.
        key = ["least", "unit", "check"]
        same = [F.col(c) == F.col(f"_{c}") for c in key]
        edges = units.where("not is_run")
        often = edges.groupBy(*key).agg(F.sum("times").alias("total")).where("total > 1").select(*[F.col(c).alias(f"_{c}") for c in key])
        opened = scratch.keep(edges.where("times = 1").join(scratch.keep(often, "often"), same, "left_semi"), "opened")
        equal = units.where("is_run")
        identity = F.xxhash64(*key, "is_run").alias("id")
        marked = again.where("times = 1").withColumnRenamed("whole", "unit").join(equal.select(*[F.col(c).alias(f"_{c}") for c in key]), same, "left_semi")
        places = marked.select(*_KEY, F.col("begin").alias("at"), F.col("edges").alias("n"), F.xxhash64(*key, F.lit(True)).alias("id")).unionByName(opened.select(*_KEY, "at", "n", identity))

        graph = equal.select(identity, "source", "target", "n").unionByName(opened.select(identity, "source", "target", "n").dropDuplicates(["id"]))
        self.paths = contract_paths(scratch.keep(graph, "graph"), scratch)
        on_path = places.join(self.paths.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
        begun = on_path.groupBy(*_KEY, F.coalesce("head", "id").alias("head"), (F.col("at") - F.coalesce("behind", F.lit(0))).alias("begin"))
        extent = F.max(F.col("at") + F.col("n")) - F.min("at")
        found = begun.agg(F.min("at").alias("first"), extent.alias("extent"), F.sum("n").alias("n"), F.collect_list(F.struct(F.col("at").alias("first"), F.col("n").alias("edges"))).alias("parts"))
        unbroken = F.array(F.struct("first", F.col("extent").cast("int").alias("edges")))
        spans = found.select(*_KEY, F.explode(F.when(F.col("extent") == F.col("n"), unbroken).otherwise(F.col("parts"))).alias("s"))
        self.spans = scratch.keep(spans.groupBy(*_KEY).agg(F.collect_list("s").alias("spans")), "spans")
        scratch.drop(again, units, opened)

    def cleaned(self) -> DataFrame:
        """_doc, _h1, n_removed, digest and kept text of the rows in ``spans``: the kept words joined by one space."""
        span = self.span
        rows = _join(self.identified.select(*_KEY, "_text"), self.spans).select(*_KEY, "_text", "spans.first", "spans.edges")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[3:]]
                starts = batch.column(3).offsets.to_numpy()
                starts = starts - starts[0]
                for chunk in K.chunks(batch.column(2)):
                    removed, kept = [], []
                    body = chunk.data.tobytes()
                    for d in range(len(chunk.offsets) - 1):
                        words = body[chunk.offsets[d] : chunk.offsets[d + 1]].split()
                        own = slice(starts[chunk.first + d], starts[chunk.first + d + 1])
                        first, edges = flat[0][own], flat[1][own]
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, first, 1)
                        np.add.at(change, first + edges + span - 1, -1)
                        gone = np.cumsum(change[:-1]) > 0
                        removed.append(int(gone.sum()))
                        kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()]).decode())
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(chunk.first, len(kept)) for c in batch.columns[:2]), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept]), pa.array(kept, pa.string())],
                        names=["_doc", "_h1", "n_removed", "kept_digest", "kept_text"],
                    )

        kind = dict(self.identified.dtypes)["_doc"]
        return rows.mapInArrow(run, f"_doc {kind}, _h1 long, n_removed long, kept_digest string, kept_text string")


def _all_removed(span: int) -> Column:
    return F.col("_copied").isNotNull() & (F.col("n_words") >= span)


def removal_digest(docs: DataFrame, span: int = SPAN, seed: int = SEED, text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256) of all documents.

    Null and empty texts have no words and lose none; texts of under ``span`` words lose none; a text that several rows
    have loses all words, repeated rows included; an empty table gives an empty result; other columns are ignored.
    """
    found = Repeats(docs, span, seed, text)
    rows = _join(found.scanned, found.copied.withColumn("_copied", F.lit(True)), ["_h1", "_h2", "_size"], "left")
    rows = _join(rows, found.cleaned().drop("kept_text"), _KEY, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        F.col("_doc").alias("doc_id"),
        "n_words",
        F.when(_all_removed(span), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(_all_removed(span), F.lit(nothing)).otherwise(F.coalesce("kept_digest", "digest")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, span: int = SPAN, seed: int = SEED, text: str = "text") -> DataFrame:
    """``docs`` with every word under a repeated edge removed: the kept words joined by one space where any went, else
    the text as it was.

    Rows left without a word by this stay, with an empty text; null, empty and short texts stay as they are; a text that
    several rows have, with one id or more, is emptied in each if it has ``span`` words; an empty table gives an empty
    result.  All columns come back in order, whatever their names; only ``text`` changes.
    """
    found = Repeats(docs, span, seed, text)
    whole = ["_h1", "_h2", "_size"]
    emptied = _join(found.scanned.where(F.col("n_words") >= span), found.copied.withColumn("_copied", F.lit(True)), whole).select(*_KEY, F.lit("").alias("kept_text"))
    changed = found.cleaned().select(*_KEY, "kept_text").unionByName(emptied.distinct())
    t = F.col(text).cast("string")
    rows = _join(packed_rows(docs, _doc=F.col("doc_id"), _h1=F.xxhash64(t)), changed, _KEY, "left")
    own = [F.coalesce("kept_text", F.col(f"_row.`{c}`")).alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns]
    return rows.select(*own)
