"""Packed shard store: many small shards laid end to end in few large files, with an offset index.

Below a root::

    data/generation=<id>/pack=<n>/    one Parquet file of consecutive shards, sorted by shard and offset
    index/                            versioned root with the table ``index``: shard -> generation, pack, first row, rows, digest

Files are never changed: a run writes new packs, reads them back, and publishes an index that names them.  Whatever no
index names does not exist for readers.  Rows of a shard lie together, so a point read touches its row groups alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.digests import canonical_json
from ..functions.ranking import ordered_rank
from ..operators.contracts import all_of, violations
from ..scratch import Scratch
from . import versions

#: Shards of a file, and files that are written before the index is published.
SHARDS_PER_PACK = 4096
PACKS_PER_COMMIT = 64
#: Bytes of a row group.
ROW_GROUP_BYTES = 8 << 20

_PLACE = ("generation", "pack")
_INDEX = "shard string, generation string, pack int, first_row long, n_rows long, digest string"


def shard_digests(rows: DataFrame, shard: str) -> DataFrame:
    """Rows (shard, n_rows, digest); a shard has few rows, whose digests are hashed together in their order."""
    columns = sorted(c for c in rows.columns if c not in (shard, *_PLACE))
    each = rows.select(F.col(shard).cast("string").alias("shard"), F.sha2(canonical_json(*columns), 256).alias("_d"))
    return each.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.sort_array(F.collect_list("_d")), "\n"), 256).alias("digest"))


def index(spark: SparkSession, root: str) -> DataFrame:
    """The published index; an empty one for a root without."""
    if versions.manifest(spark, f"{root}/index") is None:
        return spark.createDataFrame([], _INDEX)
    return versions.open_tables(spark, f"{root}/index")["index"]


def _data(spark: SparkSession, root: str, generations: list[str]) -> DataFrame:
    """The rows of whole generations with the columns generation and pack."""
    data = f"{root}/data"
    return spark.read.option("basePath", data).parquet(*[f"{data}/generation={g}" for g in generations])


def write(planned: DataFrame, root: str, shard: str = "shard_path", offset: str = "within_shard_index", shards_per_pack: int = SHARDS_PER_PACK, packs_per_commit: int = PACKS_PER_COMMIT) -> dict[str, int]:
    """Bring the store to the plan: ``{"total", "reused", "written"}`` shards.

    Shards whose rows are as planned are reused, others and missing ones are written into new packs, and what was written
    is read back and compared before it is published.  A run that breaks off keeps what it has published, after every
    ``packs_per_commit`` files.  A stored shard that is not planned is an error.
    """
    spark, root = planned.sparkSession, root.rstrip("/")
    scratch = Scratch(spark, "write-packs")
    wanted = scratch.keep(shard_digests(planned, shard), "planned")
    stored = index(spark, root)
    if unexpected := stored.join(wanted, "shard", "left_anti").take(5):
        raise ValueError(f"{root} holds shards that are not planned: {[r['shard'] for r in unexpected]}")
    missing = wanted.join(stored.select("shard", "n_rows", "digest"), ["shard", "n_rows", "digest"], "left_anti")
    todo = scratch.keep(ordered_rank(missing, [F.col("shard")], "_n", "write-packs").withColumn("pack", F.expr(f"_n div {shards_per_pack}").cast("int")), "todo")
    total, written = wanted.count(), todo.count()
    packs = -(-written // shards_per_pack)
    for lo in range(0, packs, packs_per_commit):
        generation, now = f"g-{uuid.uuid4().hex}", todo.where(F.col("pack").between(lo, lo + packs_per_commit - 1))
        rows = planned.join(now.select(F.col("shard").alias("_shard"), "pack"), F.col(shard).cast("string") == F.col("_shard")).drop("_shard")
        placed = rows.repartition(min(packs - lo, packs_per_commit), "pack").sortWithinPartitions("pack", shard, offset)
        placed.write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("pack").parquet(f"{root}/data/generation={generation}")
        back = shard_digests(_data(spark, root, [generation]), shard)
        if bad := now.join(back, ["shard", "n_rows", "digest"], "left_anti").take(5):
            raise ValueError(f"shards did not read back as written: {[r['shard'] for r in bad]}")
        before = Window.partitionBy("pack").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a pack's shards
        added = now.select("shard", F.lit(generation).alias("generation"), "pack", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first_row"), "n_rows", "digest")
        kept = index(spark, root).join(added.select("shard"), "shard", "left_anti")
        versions.publish({"index": scratch.keep(kept.unionByName(added), "index")}, f"{root}/index", replace=True)
    return {"total": total, "reused": total - written, "written": written}


def read(spark: SparkSession, root: str, names: list[str] | None = None, shard: str = "shard_path", check: bool = True) -> DataFrame:
    """Rows of the named shards, or of all.  A name that is not a safe relative path, or that no shard has, is an error;
    with ``check`` so is a shard whose rows are not those that were published."""
    root = root.rstrip("/")
    known = index(spark, root)
    if names is not None:
        if bad := [n for n in names if not n or n.startswith("/") or "\\" in n or ".." in n.split("/")]:
            raise ValueError(f"shard names leave the root: {bad[:5]}")
        known = known.where(F.col("shard").isin(*names))
        if missing := sorted(set(names) - {r["shard"] for r in known.select("shard").collect()}):
            raise ValueError(f"{root} lacks shards: {missing[:5]}")
    places = [r["generation"] for r in known.select("generation").distinct().collect()]  # one for each commit
    if not places:
        raise ValueError(f"{root} holds no shards")
    rows = _data(spark, root, places)
    if names is not None:
        packs = [r["pack"] for r in known.select("pack").distinct().collect()]
        rows = rows.where(F.col("pack").isin(*packs) & F.col(shard).isin(*names))
    on = [F.col(shard).cast("string") == F.col("_shard"), *[F.col(c) == F.col(f"_{c}") for c in _PLACE]]
    found = rows.join(known.select(F.col("shard").alias("_shard"), *[F.col(c).alias(f"_{c}") for c in _PLACE]), on, "left_semi")
    if check and (bad := known.join(shard_digests(found, shard), ["shard", "n_rows", "digest"], "left_anti").take(5)):
        raise ValueError(f"{root}: shards are not what was published: {[r['shard'] for r in bad]}")
    return found.drop(*_PLACE)


def files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (generation, pack, path, bytes, rows) of the data files that the index names."""
    root = root.rstrip("/")
    known = index(spark, root)
    places = [r["generation"] for r in known.select("generation").distinct().collect()]
    if not places:
        return spark.createDataFrame([], "generation string, pack int, path string, bytes long, rows long")
    there = _data(spark, root, places).select("generation", "pack", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    return there.join(known.select(*_PLACE).distinct(), list(_PLACE), "left_semi").groupBy(*_PLACE, "path", "bytes").agg(F.count("*").alias("rows"))


def totals(spark: SparkSession, root: str) -> DataFrame:
    """One row (n_shards, n_rows, n_files, bytes) of the whole store."""
    counts = index(spark, root).agg(F.count("*").alias("n_shards"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    sizes = files(spark, root).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return counts.join(F.broadcast(sizes))


def file_violations(spark: SparkSession, root: str) -> DataFrame:
    """Packs of the index without a file, and those whose file has fewer rows than the index has for them."""
    wanted = index(spark, root).groupBy(*_PLACE).agg(F.sum("n_rows").alias("_wanted"))
    both = wanted.join(files(spark, root), list(_PLACE), "left")
    key = F.concat_ws("/", *_PLACE)
    return all_of(violations(both, "pack_file", key, F.col("rows").isNull()), violations(both.where("rows is not null"), "pack_rows", key, F.col("rows") < F.col("_wanted"), F.col("rows")))
