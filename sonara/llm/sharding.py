"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

Every key falls on an arc of the ring, which belongs to the next virtual node clockwise.  A shard takes keys up to its
bound; keys that reach a full shard continue clockwise to the next virtual node of a shard with room.  With a load
factor of 1 the bounds add up to the number of keys, so shard counts differ by one at most.

Only the number of keys on each arc (shards x virtual nodes rows, whatever the input) reaches the driver.  It works out
how many keys of each arc each virtual node admits; keys then find their shard and slot from their rank on their arc.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions on the ring are the first 52 bits of an MD5 digest.
_HEX_DIGITS = 13
#: Most virtual nodes on a ring: what the driver handles and broadcasts.
MAX_NODES = 100_000


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order."""
    if shards < 1 or virtual_nodes < 1 or shards * virtual_nodes > MAX_NODES:
        raise ValueError(f"a ring has 1 to {MAX_NODES} virtual nodes")
    place = lambda s, v: int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:_HEX_DIGITS], 16)
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def bounds(total: int, shards: int, load_factor: float = 1.0) -> list[int]:
    """Most keys for each shard; at factor 1 they add up to ``total`` and differ by one at most."""
    if load_factor < 1:
        raise ValueError("the load factor is at least 1")
    if load_factor == 1:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [math.ceil(load_factor * total / shards)] * shards


def flows(nodes: list[tuple[int, int]], counts: dict[int, int], limits: list[int]) -> list[tuple[int, int, int, int]]:
    """Rows (arc, first rank, end rank, shard): which keys of each arc each shard admits.

    Keys move in rounds: all that wait at a virtual node are admitted in the order of their arcs until the shard is full,
    virtual nodes in ring order; the others go on to the next virtual node of a shard with room.
    """
    room, taken = list(limits), []
    waiting = {a: [(a, 0, n)] for a, n in sorted(counts.items()) if n}
    while waiting:
        moved = defaultdict(list)
        for at in sorted(waiting):
            shard = nodes[at][1]
            for arc, lo, hi in waiting[at]:
                n = min(room[shard], hi - lo)
                if n:
                    taken.append((arc, lo, lo + n, shard))
                    room[shard] -= n
                if lo + n < hi:
                    moved[at].append((arc, lo + n, hi))
        open_nodes = [k for k, (_, s) in enumerate(nodes) if room[s]]
        waiting = defaultdict(list)
        for at, left in sorted(moved.items()):
            k = bisect.bisect_right(open_nodes, at)
            waiting[open_nodes[k % len(open_nodes)]] += left
    return taken


def shard_documents(
    docs: DataFrame, shards: int = 40, virtual_nodes: int = 64, load_factor: float = 1.0, key: str = "doc_id", text: str = "text", overhead: int = 16
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 length of the text plus ``overhead`` (null text: no bytes); slots count from 0 without gaps in
    each shard.  The law is ``rows``: counts differ by one at most at factor 1.  Null and repeated keys are keys like
    any other (all copies of one key share an arc); an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    nodes = ring(shards, virtual_nodes)
    places = [p for p, _ in nodes]
    position = F.conv(F.substring(F.md5(F.concat(F.lit("key-"), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, _HEX_DIGITS), 16, 10).cast("long")
    # Binary search over the ring in an expression: an equi-join on the leading bits would still need the residue.
    grid = spark.range(1).select(F.from_json(F.lit(json.dumps([{"arc": k, "place": p} for k, p in enumerate(places)])), "array<struct<arc:int,place:long>>").alias("nodes")).selectExpr("inline(nodes)")
    coarse = 1 << (4 * _HEX_DIGITS - 12)
    spans = (
        grid.withColumn("low", F.coalesce(F.lag("place").over(Window.orderBy("place")), F.lit(-1)))
        .withColumn("cell", F.explode(F.sequence(F.floor((F.col("low") + 1) / coarse).cast("int"), F.floor(F.col("place") / coarse).cast("int"))))
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list(F.struct("place", "arc"))).alias("near"))
    )
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        position.alias("_position"),
    ).withColumn("cell", F.floor(F.col("_position") / coarse).cast("int"))
    placed = rows.join(F.broadcast(spans), "cell", "left").withColumn(
        "_arc", F.coalesce(F.expr("get(filter(near, x -> x.place >= _position), 0).arc"), F.lit(0))
    )

    counts = {r["_arc"]: r["n"] for r in placed.select("_arc").groupBy("_arc").agg(F.count("*").alias("n")).collect()}
    limits = bounds(sum(counts.values()), shards, load_factor)
    base, used = [], [0] * shards
    for arc, lo, hi, shard in flows(nodes, counts, limits):
        base.append({"_arc": arc, "lo": lo, "hi": hi, "shard": shard, "base": used[shard] - lo})
        used[shard] += hi - lo
    admitted = spark.range(1).select(F.from_json(F.lit(json.dumps(base)), "array<struct<_arc:int,lo:long,hi:long,shard:int,base:long>>").alias("flows")).selectExpr("inline(flows)")
    by_arc = admitted.groupBy("_arc").agg(F.collect_list(F.struct("lo", "hi", "shard", "base")).alias("flows"))
    rank = F.row_number().over(Window.partitionBy("_arc").orderBy("_position", "doc_id", "text_crc32", "size")) - 1
    ranked = placed.select("doc_id", "size", "text_crc32", "_arc", "_position").withColumn("_rank", rank.cast("long"))
    found = ranked.join(F.broadcast(by_arc), "_arc").withColumn("flow", F.expr("get(filter(flows, x -> x.lo <= _rank and _rank < x.hi), 0)"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("flow.shard").alias("shard"), (F.col("flow.base") + F.col("_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
