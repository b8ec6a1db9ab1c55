"""Merkle manifest of a table of documents, by time-forward processing.

Each row is a leaf; the leaves of a language, in the order of their ids, are the bottom of a tree in which every 8
consecutive nodes have one parent, and the languages' subroots are the leaves of a last tree with the root.

*Up.*  A node's label is (level, place), so every node comes after its children.  A node sends its digest to its parent's
label through a priority queue; a sweep takes the least label's messages, hashes them and sends the result on.

*Down.*  The reversed sweep starts at the top: a node hands each child the proof suffix it was handed itself, with the
digests of the child's siblings in front.  What arrives at a leaf is its proof.

The queue is external on both scales.  Blocks of 4096 aligned leaves (four levels) are swept by one task each, whose queue
spills sorted runs once it is full; messages between blocks are tables that Spark's shuffle sorts to the blocks of their
receivers.  A pass over the blocks divides the number of nodes by 4096, so ten billion leaves take three, and no task, lone
language or driver ever holds more than a block.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Children of a node, and levels of a block.
ARITY = 8
BLOCK_LEVELS = 4
BLOCK = ARITY**BLOCK_LEVELS
#: Messages a queue holds in memory.
QUEUE_MESSAGES = 1 << 16
#: More passes than any table needs.
MAX_PASSES = 12

_LEVELS = "array<struct<before:string,after:string>>"


def hashed(*parts: str) -> str:
    """Lower-case hex SHA-256 of the parts laid end to end."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class MessageQueue:
    """Priority queue of (label, content) that spills: beyond ``limit`` messages in memory, they are written as a sorted run
    to an unnamed temporary file, and the runs are merged as messages are taken.

    ``label`` and ``content`` are JSON values; labels are unique, and no message may come before one already taken.
    """

    def __init__(self, limit: int = QUEUE_MESSAGES) -> None:
        self.limit, self.memory = limit, []
        self.runs: list[tuple[list, int]] = []  # least messages of the runs on disk, with the run's number
        self.files: list = []

    def push(self, label: tuple, content) -> None:
        heapq.heappush(self.memory, (label, content))
        if len(self.memory) > self.limit:
            run = tempfile.TemporaryFile("w+")  # noqa: SIM115 - without a name, so it goes with the process
            for label, content in sorted(self.memory):
                run.write(json.dumps([label, content]) + "\n")
            run.seek(0)
            self.memory = []
            self.files.append(run)
            self._next(len(self.files) - 1)

    def _next(self, k: int) -> None:
        line = self.files[k].readline()
        if line:
            label, content = json.loads(line)
            heapq.heappush(self.runs, (tuple(label), k, content))
        else:
            self.files[k].close()

    def peek(self) -> tuple | None:
        """The least label."""
        heads = [x[0][0] for x in (self.memory, self.runs) if x]
        return min(heads) if heads else None

    def pop(self) -> tuple[tuple, object]:
        if not self.runs or self.memory and self.memory[0][0] < self.runs[0][0]:
            return heapq.heappop(self.memory)
        label, k, content = heapq.heappop(self.runs)
        self._next(k)
        return label, content


def levels_above(n: int) -> int:
    """Levels between ``n`` nodes and the one at their top."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def sweep_up(leaves: list[tuple[int, str]], levels: int, limit: int = QUEUE_MESSAGES) -> Iterator[tuple[int, int, list[str]]]:
    """(level, place, digests of the children) of every node above ``leaves`` (place, digest), up to ``levels``; every node
    comes after its children."""
    queue = MessageQueue(limit)
    for place, digest in leaves:
        queue.push((1, place // ARITY, place % ARITY), digest)
    while (least := queue.peek()) is not None:
        level, place, _ = least
        children = []
        while (head := queue.peek()) is not None and head[:2] == (level, place):
            children.append(queue.pop()[1])
        yield level, place, children
        if level < levels:
            queue.push((level + 1, place // ARITY, place % ARITY), hashed(*children))


def sweep_down(leaves: list[tuple[int, str]], levels: int, suffix: list, limit: int = QUEUE_MESSAGES) -> Iterator[tuple[int, list]]:
    """(place, proof) of every leaf: pairs of the digests before and after it among its siblings, level by level, and then
    ``suffix``.  The labels are those of ``sweep_up`` in reverse."""
    families = {(level, place): children for level, place, children in sweep_up(leaves, levels, limit)}
    queue = MessageQueue(limit)
    top = max(families)
    queue.push((-top[0], -top[1]), suffix)
    while queue.peek() is not None:
        (level, place), own = queue.pop()
        children = families.pop((-level, -place))
        for k in range(len(children)):
            child, proof = -place * ARITY + k, [("".join(children[:k]), "".join(children[k + 1 :])), *own]
            if level == -1:
                yield child, proof
            else:
                queue.push((level + 1, -child), proof)


def _field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column, doc_id: str = "doc_id") -> Column:
    """Digest of doc_id, source, lang, n_chars and text."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in (doc_id, "source", "lang", "n_chars")], _field(text)), 256)


def _placed(rows: DataFrame, tree: str, order: list[Column], scratch: Scratch, ranges: list[Column] | None = None) -> DataFrame:
    """``rows`` with ``place``, their 0-based place in their tree, and ``n``, the tree's size.

    Rows are sorted by ranges and written; a row's place is that in its range, less its tree's first one there, plus the
    tree's rows in earlier ranges.  ``ranges``: what ranges are cut by, if not ``order`` itself; a sample of it goes to the
    driver, so it is short.
    """
    first = F.col(tree).asc_nulls_first()
    ordered = rows.repartitionByRange(first, *(ranges or order)).sortWithinPartitions(first, *order)
    at = F.monotonically_increasing_id()
    kept = scratch.keep(ordered.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    counts = kept.groupBy("_part", F.col(tree).alias("_tree")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy("_tree")  # a row for each range that a tree lies in
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_range"), "_tree", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    joined = kept.join(offsets, (F.col("_part") == F.col("_range")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_range", "_at", "_tree", "_shift")


def _climb(nodes: DataFrame, kind: str, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The nodes (tree, n, place, digest) of each pass, from ``nodes`` on, and the trees' roots (tree, digest)."""

    def run(block: pa.Table) -> pa.Table:
        n = block.column("n")[0].as_py()
        levels = min(BLOCK_LEVELS, levels_above(n))
        leaves = sorted(zip(block.column("place").to_pylist(), block.column("digest").to_pylist()))
        digest, place, left = leaves[0][1], leaves[0][0] // BLOCK, n
        for _, _, children in sweep_up(leaves, levels) if levels else ():
            digest = hashed(*children)
        for _ in range(levels):
            left = -(-left // ARITY)
        return pa.table({"tree": block.column("tree").slice(0, 1), "n": pa.array([left], pa.int64()), "place": pa.array([place], pa.int64()), "digest": pa.array([digest])})

    passes = [nodes]
    for _ in range(MAX_PASSES):
        blocks = passes[-1].withColumn("_block", F.expr(f"place div {BLOCK}"))
        above = scratch.keep(blocks.groupBy("tree", "_block").applyInArrow(run, f"tree {kind}, n long, place long, digest string"), "nodes")
        if not above.where("n > 1").take(1):
            return passes, above.select("tree", "digest")
        passes.append(above)
    raise RuntimeError("the trees did not come to an end")


_ARROW_LEVELS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _descend(passes: list[DataFrame], suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of the lowest pass with ``proof``; ``suffixes`` (tree, place, proof): what the roots were handed."""

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("place").drop_columns("_block")
        if not block.num_rows:
            return block.append_column("proof", pa.array([], _ARROW_LEVELS))
        levels = min(BLOCK_LEVELS, levels_above(block.column("n")[0].as_py()))
        suffix = [(x["before"], x["after"]) for x in above.column("proof")[0].as_py()]
        places = block.column("place").to_pylist()
        found = dict(sweep_down(list(zip(places, block.column("digest").to_pylist())), levels, suffix)) if levels else {places[0]: suffix}
        proofs = [found[k] for k in places]
        pairs = [x for proof in proofs for x in proof]
        offsets = pa.array([0, *itertools.accumulate(map(len, proofs))], pa.int32())
        siblings = pa.StructArray.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.string())], names=["before", "after"])
        return block.append_column("proof", pa.ListArray.from_arrays(offsets, siblings))

    for nodes in reversed(passes):
        schema = ", ".join(f"{name} {kind}" for name, kind in [*nodes.dtypes, ("proof", _LEVELS)])
        blocks = nodes.withColumn("_block", F.expr(f"place div {BLOCK}")).groupBy("tree", "_block")
        above = suffixes.select("tree", F.col("place").alias("_block"), "proof").groupBy("tree", "_block")
        suffixes = blocks.cogroup(above).applyInArrow(run, schema)
        if nodes is not passes[0]:
            suffixes = scratch.keep(suffixes, "proofs")
    return suffixes


def manifest(docs: DataFrame, altered: Column | None = None, text: str = "text") -> DataFrame:
    """Rows (doc_id, leaf, altered_leaf, subroot, root, proof) of all documents.

    ``proof`` holds, level by level, the digests of a node's siblings ``before`` and ``after`` it, laid end to end (both
    empty for a run of one).  ``altered``: another text for each row, whose leaf is ``altered_leaf`` (the leaf itself where
    it is not given).  Leaves with null ids come first, and equal ids are ordered by their leaves; null languages are a
    language of their own, before all others; null values are ``-``.  A lone leaf is its language's subroot, and a lone
    subroot the root, with an empty proof.  An empty table gives an empty manifest; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    body = F.col(text).cast("string")
    leaves = docs.select("doc_id", F.col("lang").cast("string").alias("tree"), leaf_digest(body).alias("digest"), leaf_digest(body if altered is None else altered).alias("altered_leaf"))
    id_order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("altered_leaf")]
    ranges = [F.col("doc_id").asc_nulls_first(), F.substring("digest", 1, 6)]  # an id that many rows have is cut too
    placed = scratch.keep(_placed(scratch.keep(leaves, "leaves"), "tree", id_order, scratch, ranges), "placed")
    passes, subroots = _climb(placed.select("tree", "n", "place", "digest"), "string", scratch)

    languages = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("lang"), "digest")
    named = scratch.keep(_placed(languages, "tree", [F.col("lang").asc_nulls_first()], scratch), "languages")
    top, roots = _climb(named.select("tree", "n", "place", "digest"), "int", scratch)
    root = roots.first()  # one row
    empty = F.from_json(F.lit("[]"), _LEVELS)
    to_languages = _descend([named, *top[1:]], roots.select("tree", F.lit(0).cast("long").alias("place"), empty.alias("proof")), scratch)
    handed = scratch.keep(to_languages.select(F.col("lang"), F.col("digest").alias("subroot"), "proof"), "handed")
    to_leaves = _descend([placed, *passes[1:]], handed.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("place"), "proof"), scratch)
    subroot = handed.select(F.col("lang").alias("_lang"), "subroot")
    rows = to_leaves.join(subroot, F.col("tree").eqNullSafe(F.col("_lang")))
    return rows.select("doc_id", F.col("digest").alias("leaf"), "altered_leaf", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all of a proof's digests laid end to end."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def tampered(text: Column, doc_id: Column, every: int = 3) -> Column:
    """The text with A-Z lower-cased where ``every`` divides the CRC-32 of the id's digits; the text itself elsewhere and
    for null ids."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % every == 0
    return F.when(hit, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def verification(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every leaf's proof, folded from the leaf of a
    copy of the table in which some texts were tampered with.  Edge cases are those of ``manifest``."""
    found = manifest(docs, tampered(F.col(text).cast("string"), F.col("doc_id")), text)
    rows = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("altered_leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
