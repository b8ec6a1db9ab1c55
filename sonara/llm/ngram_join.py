"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles; two link if their Jaccard similarity reaches a threshold.  Equal sets are one
class, represented by its least document, and everything below works on representatives.

*Order.*  One pass over all documents counts how many share each shingle (in 2**32 hash cells; a cell can only
overestimate).  A shingle is unique, light or heavy by that count, and every set is ordered so: unique ones, light ones,
then heavy ones by count, ties by hash.  Of the counts, a bitmap of shared cells and a list of the heaviest cells are
broadcast; both have fixed bounds.  Beyond them the order is less sharp but still one order for all documents, which is
all that correctness needs.

*Parities.*  Beside its prefix a document carries the parities of its shared shingles in 256 classes.  Unique shingles and
classes of different parity bound from below how much two sets differ, so that of a group of near copies only the pairs
around the threshold and above are formed.

*Adaptive prefixes.*  If x and y link, they have at least l shingles in common among the first ``|x| - ceil(t |x|) + l``
of x and as many of y, for every l.  Each document takes the l for which the estimated cost (posting entries read plus
candidates, at most entries / l, times the cost of verifying one) is least, and a pair is verified only if its
prefixes share as many shingles as the lesser l of the two.  Unique shingles fill prefix places but match nothing.

*No pairs within groups.*  First each document is verified against one leader only, the likeliest among those it shares
prefix shingles with, and linked ones are merged; those left over meet the leader of the component around them.  Then candidates are formed only between different components, the
largest component of each posting list never against itself, so a group of near copies costs a star and not a square.

*Size bands.*  A posting list is cut into bands of set sizes, each as wide as the ratio of sizes that may link.  An entry
meets its own band and those beside it that hold sizes in its reach, so the join never visits pairs of sizes far apart.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, packed_rows
from .components import components

#: Shingles gathered by a task before their cells are written.
FLUSH_SHINGLES = 4_000_000
#: Shingles whose cells are counted by one group.
RANGE_SHINGLES = 1 << 21
#: Most bits of the broadcast bitmap, and most heavy cells that are broadcast.
MAX_BITS = 28
MAX_HEAVY = 1 << 20
#: Documents from which on a shingle is heavy.
HEAVY = 32
#: Estimated documents of a light shingle, cost of verifying a candidate against reading an entry, and greatest l.
LIGHT_COUNT = 4
VERIFY_COST = 50
MAX_MATCHES = 8
#: Columns with the parities of a set.
PARITIES = ("b0", "b1", "b2", "b3")
#: Times that documents are verified against leaders before other pairs are formed.
LEADER_ROUNDS = 2
#: Least width of a band of set sizes, as a logarithm.
MIN_BAND = 0.01


def shingle_sets(chunk: K.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents of a chunk end to end, and their n + 1 offsets.

    A text of fewer than ``n`` words has its whole word sequence as one shingle; one without words has none.
    """
    w = K.words(chunk, lower=True)
    first, doc = K.window_starts(w.bounds, n)
    counts = np.diff(w.bounds)
    short = np.flatnonzero((counts > 0) & (counts < n))
    start, end = np.r_[first, w.bounds[:-1][short]], np.r_[first + n, w.bounds[1:][short]]
    doc = np.r_[doc, short]
    hashes = K.run_hash(w.hash, start, end)
    if len(short):
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    offsets = np.searchsorted(doc, np.arange(len(counts) + 1))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.r_[0, np.cumsum(new)][offsets]


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each set."""
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(K.mix(hashes ^ np.uint64(salt)), out=total[1:])
        sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return sums[0], sums[1]


def _pack_cells(cells: np.ndarray) -> tuple[bytes, bool]:
    """Sorted cells as differences of 16 bits, or as they are if one is greater."""
    steps = np.diff(cells, prepend=cells[:1])
    if len(cells) and int(steps.max()) < 1 << 16:
        return cells[:1].tobytes() + steps[1:].astype(np.uint16).tobytes(), False
    return cells.tobytes(), True


def _unpack_cells(data: bytes | pa.Buffer, wide: bool) -> np.ndarray:
    if wide:
        return np.frombuffer(data, np.uint32)
    return np.cumsum(np.r_[np.frombuffer(data, np.uint32, 1), np.frombuffer(data, np.uint16, offset=4)], dtype=np.uint32)


def _scan(docs: DataFrame, n: int, range_bits: int) -> DataFrame:
    """Rows of documents (doc_id, size, fp1, fp2) and rows of cells (cell_range, cells, wide)."""
    names = ["doc_id", "size", "fp1", "fp2", "cell_range", "cells", "wide"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]

    def rows(columns: list, length: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) if c is not None else pa.nulls(length, k) for c, k in zip(columns, kinds)], names=names)

    def cells_of(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(held))
        cuts = np.searchsorted(cells, np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(32 - range_bits))
        packed = [(k, *_pack_cells(part)) for k, part in enumerate(np.split(cells, cuts[1:])) if len(part)]
        return rows([None, None, None, None, *zip(*packed)], len(packed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                hashes, offsets = shingle_sets(chunk, n)
                a, b = fingerprints(hashes, offsets)
                sizes = np.diff(offsets)
                yield rows([batch.column(0).slice(chunk.first, len(sizes)), sizes, a, b, None, None, None], len(sizes))
                _, firsts = np.unique(a, return_index=True)
                held.append((hashes[K.ragged(offsets[:-1][firsts], sizes[firsts])] >> np.uint64(32)).astype(np.uint32))
                count += len(held[-1])
                if count >= FLUSH_SHINGLES:
                    yield cells_of(held)
                    held, count = [], 0
        if count:
            yield cells_of(held)

    return docs.mapInArrow(run, "doc_id long, size long, fp1 long, fp2 long, cell_range int, cells binary, wide boolean")


class CellCounts:
    """What is broadcast of the counts: a bitmap of cells in two sets or more, and heavy cells with log2 of their counts."""

    def __init__(self, bits: int, bitmap: np.ndarray, heavy: np.ndarray, level: np.ndarray) -> None:
        self.bits, self.bitmap, self.heavy, self.level = bits, bitmap, heavy, level

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """0: unique; 1: light; else log2 of the count."""
        cells = (hashes >> np.uint64(32)).astype(np.uint32)
        at = cells >> np.uint32(32 - self.bits)
        out = (self.bitmap[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & np.uint8(1)
        if len(self.heavy):
            shared = np.flatnonzero(out)
            place = np.minimum(np.searchsorted(self.heavy, cells[shared]), len(self.heavy) - 1)
            hit = self.heavy[place] == cells[shared]
            out[shared[hit]] = self.level[place[hit]]
        return out


def _count_cells(cell_rows: DataFrame, range_bits: int, bits: int) -> CellCounts:
    per_range = max(1, MAX_HEAVY >> range_bits)

    def run(table: pa.Table) -> pa.Table:
        packed = zip(table.column("cells"), table.column("wide").to_pylist())
        cells = np.sort(np.concatenate([_unpack_cells(c.as_buffer(), w) for c, w in packed]))
        cut = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        count, cells = np.diff(np.r_[cut, len(cells)]), cells[cut]
        span = 1 << (bits - range_bits)
        flags = np.zeros(max(8, span), bool)
        flags[(cells[count > 1] >> np.uint32(32 - bits)) & np.uint32(span - 1)] = True
        often = np.flatnonzero(count >= HEAVY)
        often = np.sort(often[np.argsort(-count[often], kind="stable")[:per_range]])
        return pa.table({
            "cell_range": table.column("cell_range").slice(0, 1), "bitmap": [zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)],
            "heavy": [cells[often].tobytes()], "level": [np.log2(count[often]).astype(np.uint8).tobytes()],
        })

    counted = cell_rows.groupBy("cell_range").applyInArrow(run, "cell_range int, bitmap binary, heavy binary, level binary")
    bitmap, heavy, level = np.zeros(1 << bits - 3, np.uint8), [], []
    width = 1 << (bits - range_bits - 3)
    for r in counted.toLocalIterator():  # all of it together has the bounds above
        part = np.frombuffer(zlib.decompress(r["bitmap"]), np.uint8)
        bitmap[r["cell_range"] * width : (r["cell_range"] + 1) * width] = part
        heavy.append((r["cell_range"], np.frombuffer(r["heavy"], np.uint32)))
        level.append((r["cell_range"], np.frombuffer(r["level"], np.uint8)))
    join = lambda parts, kind: np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])]) if parts else np.zeros(0, kind)
    return CellCounts(bits, bitmap, join(heavy, np.uint32), join(level, np.uint8))


def choose_matches(levels: np.ndarray, unique: int, base: int, most: int) -> tuple[int, int]:
    """(l, length of the prefix without its unique part) of least estimated cost.

    ``levels``: of the shared shingles in order; ``unique``: how many come before them; ``base``: prefix length at l = 1.
    """
    best, choice = math.inf, (1, 0)
    costs = np.r_[0, np.cumsum(np.where(levels == 1, LIGHT_COUNT, np.exp2(levels.astype(np.float64))))]
    for l in range(1, most + 1):
        length = min(max(0, base + l - 1 - unique), len(levels))
        entries = costs[length]
        cost = entries + VERIFY_COST * entries / l
        if cost < best:
            best, choice = cost, (l, length)
    return choice


def _prefixes(docs: DataFrame, n: int, percent: int, shared: Broadcast) -> DataFrame:
    """Rows (node, size, fp1, fp2, matches, before, weight, b0 to b3, tokens) of documents whose prefix has shared shingles.

    ``weight`` is the mean level of all shingles: in a group of near copies it is greatest for the one they derive from.
    ``b0`` to ``b3`` are the parities of the numbers of shared shingles in 256 classes of hashes: two sets differ in as
    many shared shingles as their parities differ in classes, at least.  A document with so many unique shingles that
    the rest cannot reach the threshold with anything has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: CellCounts = shared.value
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                hashes, offsets = shingle_sets(chunk, n)
                a, b = fingerprints(hashes, offsets)
                levels = known.levels(hashes)
                unique = np.r_[0, np.cumsum(levels == 0)]
                out = []
                for d in range(len(offsets) - 1):
                    lo, hi = int(offsets[d]), int(offsets[d + 1])
                    size, alone = hi - lo, int(unique[hi] - unique[lo])
                    need = -(-percent * size // 100)
                    base = size - need + 1
                    most = min(MAX_MATCHES, need)
                    if size == 0 or alone >= base:
                        continue
                    own, level = hashes[lo:hi], levels[lo:hi]
                    keep = np.flatnonzero(level)
                    order = keep[np.argsort(level[keep], kind="stable")]
                    matches, length = choose_matches(level[order], alone, base, most)
                    if length:
                        parity = np.packbits(np.bincount((own[keep] & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1).view(np.int64)
                        out.append((chunk.first + d, size, a[d], b[d], matches, alone, float(level.mean()), parity, own[order[:length]].view(np.int64)))
                if out:
                    row, size, fa, fb, matches, alone, weight, parity, tokens = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(size, pa.int32()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(matches, pa.int32()), pa.array(alone, pa.int32()), pa.array(weight, pa.float64()), *map(pa.array, np.stack(parity, 1)), pa.array(tokens, pa.list_(pa.int64()))],
                        names=["node", "size", "fp1", "fp2", "matches", "before", "weight", *PARITIES, "tokens"],
                    )

    return docs.mapInArrow(run, "node long, size int, fp1 long, fp2 long, matches int, before int, weight double, b0 long, b1 long, b2 long, b3 long, tokens array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                hashes, offsets = shingle_sets(chunk, n)
                parts = [hashes[x:y].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(parts)), pa.array(parts, pa.binary())], names=["node", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if common and 100 * common >= percent * (len(both) - common):
                    good.append(k)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(good, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    nodes = pairs.select(F.col("a").alias("_node")).union(pairs.select("b")).distinct()
    wanted = docs.join(nodes, F.col("doc_id") == F.col("_node"), "left_semi")
    found = wanted.mapInArrow(sets, "node long, shingles binary")
    left = found.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = found.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def size_band(size: str | Column, percent: int) -> Column:
    """The band of a set size.  Bands are a trifle wider than the ratio of sizes that link, whatever logarithms round to, so
    sets that link lie in one band or in two that touch."""
    width = max(math.log(100 / percent), MIN_BAND) * (1 + 1e-9)
    return F.floor(F.log(F.greatest(F.col(size) if isinstance(size, str) else size, F.lit(1)).cast("double")) / width).cast("int")


def bands_in_reach(size: str, percent: int) -> Column:
    """The bands of all sizes that a set of ``size`` may link with: two or three."""
    own = F.col(size).cast("long")
    least, most = F.ceil(own * percent / 100), F.floor(own * 100 / percent)
    return F.sequence(size_band(least, percent), size_band(most, percent))


def _candidates(pairs: DataFrame, lesser: str, overlap: str) -> DataFrame:
    """Rows (a, b) of the pairs with enough common prefix tokens; of several texts of one id the least demanding decides."""
    return (
        pairs.groupBy(F.least("_node", "node").alias("a"), F.greatest("_node", "node").alias("b"))  # which side is minor varies with the token
        .agg(F.count("*").alias("shared"), F.min(F.expr(lesser)).alias("needed"), F.max(F.expr(f"place <= size - {overlap} and _place <= _size - {overlap}")).alias("early"))
        .where("shared >= needed and early")
        .select("a", "b")
    )


def near_duplicate_components(docs: DataFrame, n: int = 5, percent: int = 75, text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of all documents.

    ``component_id`` is the least id reachable by links, the document's own included.  Null, empty and wordless texts
    have no shingles and no links.  Rows with the same id are one node: what either links with, both reach.  A row
    without an id keeps its count and has a null component.  An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    volume = (docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // 6 + 1
    bits = min(MAX_BITS, max(16, volume.bit_length() + 3))
    range_bits = min(bits - 3, 13, max(6, (volume // RANGE_SHINGLES).bit_length()))

    scanned = scratch.keep(_scan(docs, n, range_bits), "scan")
    sets = scanned.where("cell_range is null").select("doc_id", "size", "fp1", "fp2")
    counts = _count_cells(scanned.where("cell_range is not null").select("cell_range", "cells", "wide"), range_bits, bits)

    key = ["fp1", "fp2", "size"]
    classes = scratch.keep(sets.where("size > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("node"), F.count("*").alias("members")).where("members > 1").select(*key, "node"), "classes")
    shared = spark.sparkContext.broadcast(counts)
    first = _prefixes(docs.where("doc_id is not null"), n, percent, shared)
    reps = first.join(classes.withColumnRenamed("node", "_first"), key, "left").where("_first is null or _first = node").drop("_first")
    prefixes = scratch.keep(reps.dropDuplicates(["node", "fp1", "fp2"]), "prefixes")
    shared.destroy()
    entries = prefixes.select("node", "size", "matches", "before", "weight", *PARITIES, F.posexplode("tokens").alias("place", "token")).withColumn("place", F.col("place") + F.col("before"))

    # In each posting list the document of greatest weight leads; every other one is verified against its likeliest leader.
    # Once more, those still apart from the list's largest component against that component's leader.
    links, labels, placed, shares = None, None, entries.withColumns({"component": F.col("node")}), None
    for _ in range(LEADER_ROUNDS):
        leaders = placed if links is None else placed.join(shares, "token").where("component = major")
        leading = leaders.groupBy("token").agg(F.max_by("node", "weight").alias("leader"), F.max_by("size", "weight").alias("leader_size"), F.count("*").alias("length"))
        led = placed if links is None else placed.join(shares, "token").where("component != major")
        led = led.join(leading.where("length > 1") if links is None else leading, "token").where(f"node != leader and 100L * least(size, leader_size) >= {percent}L * greatest(size, leader_size)")
        star = led.groupBy("node", "leader").agg(F.count("*").alias("shared")).groupBy("node").agg(F.max_by("leader", "shared").alias("b")).select(F.col("node").alias("a"), "b")
        found = scratch.keep(_verified(scratch.keep(star, "star"), docs, n, percent).distinct(), "star-links")
        # A linked document takes its leader's label; a label joins linked documents only, and need not join all of them.
        of_leader = found if labels is None else labels
        joined = found.select("a", "b").join(of_leader.select(F.col("a").alias("_a"), F.col("b").alias("_b")), F.col("b") == F.col("_a"), "left").select("a", F.coalesce("_b", "b").alias("b"))
        labels = scratch.keep(joined if labels is None else joined.unionByName(labels.join(joined.select("a"), "a", "left_anti")), "labels")
        links = found if links is None else links.unionByName(found)
        placed = entries.join(labels.select(F.col("a").alias("_node"), F.col("b").alias("component")), F.col("node") == F.col("_node"), "left").drop("_node").withColumn("component", F.coalesce("component", "node"))
        placed = scratch.keep(placed.select("token", "node", "size", "matches", "before", "weight", *PARITIES, "place", "component"), "placed")
        shares = placed.groupBy("token", "component").agg(F.count("*").alias("members")).groupBy("token").agg(F.max_by("component", "members").alias("major"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
        shares = scratch.keep(shares, "shares")

    # Candidates between different components; a posting list is met band by band.
    mixed = placed.join(shares, "token").withColumn("band", size_band("size", percent))
    minor = mixed.where("component != major").select("token", F.explode(bands_in_reach("size", percent)).alias("band"), *[F.col(c).alias(f"_{c}") for c in ("node", "size", "matches", "before", *PARITIES, "place", "component")])
    # A pair with both sides outside the major component is taken once; overlap is the least that links the two sizes, and
    # a document whose unique shingles alone exceed what it may lack links with nothing of that size.  Unique shingles of
    # both sides and classes whose parities differ count shingles that are in one set only.
    overlap = f"ceil(({percent}L * size + {percent}L * _size) / {100 + percent})"
    lesser = "least(matches, _matches)"
    pairs = minor.join(mixed, ["token", "band"]).where(
        f"_component != component and (component = major or _node < node) and 100L * least(size, _size) >= {percent}L * greatest(size, _size)"
        f" and place < size - {overlap} + {lesser} and _place < _size - {overlap} + {lesser}"
        f" and before <= size - {overlap} and _before <= _size - {overlap}"
        f" and before + _before + {' + '.join(f'bit_count({c} ^ _{c})' for c in PARITIES)} <= size + _size - 2 * {overlap}"
    )
    candidates = _candidates(pairs, lesser, overlap)
    more = scratch.keep(_verified(scratch.keep(candidates, "candidates"), docs, n, percent).distinct(), "more-links")

    # Rows of one id in several classes tie these together.
    classed = sets.where("size > 0 and doc_id is not null").join(classes, key, "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"))
    several = classed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select(F.col("doc_id").alias("_id"))
    tied = classed.join(several, F.col("doc_id") == F.col("_id"), "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    final = components(links.select("a", "b").unionByName(more.select("a", "b")).unionByName(tied), scratch)
    scratch.drop(placed, prefixes)

    named = sets.join(classes, key, "left").withColumn("node", F.coalesce("node", "doc_id"))
    linked = named.join(final.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    return linked.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def keep_one_per_component(docs: DataFrame, n: int = 5, percent: int = 75, text: str = "text") -> DataFrame:
    """One document of each component, the one with the least id, all columns unchanged, whatever their names.

    Rows without an id stay.  Rows of one id are one document: where one of them links with a lesser id, all go, and where
    several rows have the least id, each of their texts stays once; of rows that share
    both, the one whose columns come first as JSON.  Null, empty and wordless texts link with nothing and stay; an empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    joined = scratch.keep(near_duplicate_components(docs, n, percent, text).where("doc_id is not null"), "joined")
    gone = joined.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    repeated = scratch.keep(joined.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("c")).where("n > 1 and c = doc_id").select(F.col("doc_id").alias("_gone")), "repeated")
    rows = packed_rows(docs, _id=F.col("doc_id").cast("long"), _text=F.col(text).cast("string"))
    single = rows.join(gone.unionByName(repeated), F.col("_id") == F.col("_gone"), "left_anti")
    several = rows.join(repeated, F.col("_id") == F.col("_gone"), "left_semi")
    first = F.row_number().over(Window.partitionBy("_id", F.xxhash64("_text"), F.hash("_text"), F.length("_text")).orderBy(F.to_json("_row")))
    return single.select("_row.*").unionByName(several.withColumn("_first", first).where("_first = 1").select("_row.*"))
