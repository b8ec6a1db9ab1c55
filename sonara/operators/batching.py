"""Speaker-balanced batches as relations: which row stands in which slot of which batch.

All orders are digest orders of (seed, epoch, ...), so an epoch's plan is the same on any cluster, any batch can be
recomputed alone and resuming is a filter on ``batch_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.digests import stable_digest
from ..functions.ranking import digest_rank, running_total
from ..scratch import Scratch


def random_batches(rows: DataFrame, key: str, size: int, seed: int, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """Rows (batch_id, slot, key): a permutation of all rows cut into batches."""
    ranked = digest_rank(rows.select(key).withColumn("_d", stable_digest(seed, str(epoch), F.col(key))), "_d", key)
    batches = ranked.select(F.expr(f"rank div {size}").alias("batch_id"), (F.col("rank") % size).cast("int").alias("slot"), key)
    if drop_last:
        batches = batches.where(F.col("batch_id") < rows.count() // size)
    return batches


def _queues(rows: DataFrame, seed: int, epoch: int, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in their speaker's queue, and the speakers with queue length and rank."""
    placed = digest_rank(rows.withColumn("_d", stable_digest(seed, str(epoch), "row", F.col("path"))), "_d", "path", name="place", by=(*by, "speaker_id")).drop("_d")
    sizes = placed.groupBy(*by, "speaker_id").agg(F.count("*").alias("n"))
    ranked = digest_rank(sizes.withColumn("_d", stable_digest(seed, str(epoch), "speaker", F.col("speaker_id"))), "_d", "speaker_id", name="speaker_rank", by=by).drop("_d")
    return placed, ranked


def pk_batches(rows: DataFrame, speakers_per_batch: int, rows_per_speaker: int, seed: int, epoch: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (``by``, batch_id, slot, speaker_id, path, cycle): P speakers with K rows each in every batch.

    Speakers follow each other round a circle, so any P in a row are distinct and exposures differ by one at most.  Each
    exposure takes the next K rows of the speaker's queue, which begins again when it is used up (``cycle``).  There are
    ceil(rows / PK) batches.  More speakers a batch than there are, or more rows than a speaker has, are errors.
    """
    p, k = speakers_per_batch, rows_per_speaker
    placed, ranked = _queues(rows.select(*by, "speaker_id", "path"), seed, epoch, by)
    totals = ranked.groupBy(*by).agg(F.count("*").alias("_speakers"), F.ceil(F.sum("n") / (p * k)).alias("_batches"), F.min("n").alias("_least"))
    joined = ranked.join(totals, list(by)) if by else ranked.join(F.broadcast(totals))
    guard = F.when(F.col("_speakers") < p, F.raise_error(F.lit("P exceeds the speakers"))).when(F.col("_least") < k, F.raise_error(F.lit("K exceeds a speaker's rows"))).otherwise(F.col("_batches") * p)
    # Exposure e of speaker rank r is seat e * speakers + r; seats end with the last batch.
    exposures = joined.withColumn("_seats", guard).where("speaker_rank < _seats").withColumn("_e", F.explode(F.expr("sequence(0L, (_seats - 1 - speaker_rank) div _speakers)")))
    seats = exposures.withColumn("_seat", F.col("_e") * F.col("_speakers") + F.col("speaker_rank")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    taken = seats.withColumn("_t", F.col("_e") * k + F.col("_k")).select(
        *by, "speaker_id", F.expr(f"_seat div {p}").alias("batch_id"), (F.col("_seat") % p * k + F.col("_k")).cast("int").alias("slot"), (F.col("_t") % F.col("n")).alias("place"), F.expr("_t div n").alias("cycle")
    )
    return taken.join(placed, [*by, "speaker_id", "place"]).select(*by, "batch_id", "slot", "speaker_id", "path", "cycle")


def _units(index: DataFrame, rows_per_speaker: int, window: int, seed: int, epoch: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (speaker_id, unit, place, path, shard_path, base) of units of K rows, and base windows (base).

    A speaker's rows, in the order of base windows and then of digests, are cut into units of K; rows left over at the end
    form a last one together with those before them.
    """
    k = rows_per_speaker
    shards = index.select("shard_path").distinct().withColumn("_d", stable_digest(seed, str(epoch), "shard", F.col("shard_path")))
    bases = scratch.keep(digest_rank(shards, "_d", "shard_path").select("shard_path", F.expr(f"rank div {window}").alias("base")), "bases")
    placed = index.select("shard_path", "speaker_id", "path").join(bases, "shard_path").withColumn("_d", stable_digest(seed, str(epoch), "row", F.col("path")))
    within = F.row_number().over(Window.partitionBy("speaker_id", "base").orderBy("_d", "path")) - 1  # a base window's rows at most
    counts = running_total(placed.groupBy("speaker_id", "base").agg(F.count("*").alias("_n")), F.col("_n"), "base", "earlier", ("speaker_id",))
    totals = counts.groupBy("speaker_id").agg(F.sum("_n").alias("n"))
    if short := totals.where(F.col("n") < k).take(1):
        raise ValueError(f"K exceeds a speaker's rows: {short[0]['speaker_id']}")
    queue = placed.withColumn("_in", within).join(counts.drop("_n"), ["speaker_id", "base"]).join(totals, "speaker_id").withColumn("q", F.col("earlier") + F.col("_in"))
    last = F.expr(f"(n - 1) div {k}")
    twice = (F.col("n") % k != 0) & (F.col("q") >= F.col("n") - k) & (F.expr(f"q div {k}") < last)
    own = queue.withColumn("unit", F.explode(F.when(twice, F.array(F.expr(f"q div {k}"), last)).otherwise(F.array(F.expr(f"q div {k}")))))
    return own.select("speaker_id", "unit", (F.col("q") - F.least(F.col("unit") * k, F.col("n") - k)).cast("int").alias("place"), "path", "shard_path", "base"), bases.select("base").distinct()


def shard_windows(units: DataFrame, bases: DataFrame, speakers_per_batch: int, scratch: Scratch) -> DataFrame:
    """Rows (base, shard_window): all base windows, halved as long as both halves have units of P speakers or lie behind the
    last window.

    Halves lie at powers of two, and all blocks at all of them are judged at once, so it takes a few joins whatever the
    number of windows.  ``shard_window`` is the first base window of a block.  Fewer than P speakers are an error.
    """
    last = bases.agg(F.max("base")).first()[0] or 0
    levels = last.bit_length()
    blocks = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda x: F.call_function("shiftright", F.col("base"), x))).alias("level", "block")
    able = units.select("base", "speaker_id").distinct().select("speaker_id", blocks).distinct().groupBy("level", "block").agg((F.count("*") >= speakers_per_batch).alias("able"))
    behind = units.sparkSession.createDataFrame([(k, (last >> k) + 1, True) for k in range(levels + 1)], "level int, block long, able boolean")
    able = scratch.keep(able.unionByName(behind), "able")
    if not able.where((F.col("level") == levels) & (F.col("block") == 0) & F.col("able")).take(1):
        raise ValueError("P exceeds the speakers")
    halved = able.where("able").groupBy((F.col("level") + 1).alias("level"), F.shiftright("block", 1).alias("block")).agg(F.count("*").alias("n")).where("n = 2").drop("n")
    whole = bases.select("base", blocks).join(halved, ["level", "block"], "left_anti").groupBy("base").agg(F.max_by("block", "level").alias("block"), F.max("level").alias("level"))
    return whole.select("base", F.call_function("shiftleft", F.col("block"), F.col("level")).alias("shard_window"))


def windowed_batches(index: DataFrame, speakers_per_batch: int, rows_per_speaker: int, window: int, seed: int, epoch: int = 0) -> DataFrame:
    """P x K batches that read few shards; rows (shard_window, batch_id, slot, speaker_id, path, cycle, shard_path).

    Every ``window`` shards, in digest order, are a base window.  A speaker's rows go through these in units of K: rows of
    a speaker that has too few in a window wait for the next one, so at most K - 1 rows of a batch's speaker come from
    earlier shards.  Windows are halved as long as both halves have P speakers (``shard_windows``).

    A window gives as many batches as its units fill.  Its speakers stand on a circle, in one order of digests for all
    windows; the seats of its batches go round it, beginning where the seats of all windows before would have ended.  So
    exposures in a window differ by one at most, and where all speakers have units in all windows, so do those of the
    epoch.  An exposure takes the speaker's next unit in the window and begins again when they are used up (``cycle``).
    More speakers a batch than there are, or more rows than a speaker has, are errors.
    """
    p, k = speakers_per_batch, rows_per_speaker
    scratch = Scratch(index.sparkSession, "windowed-batches")
    members, bases = _units(index, k, window, seed, epoch, scratch)
    members = scratch.keep(members, "members")
    units = members.groupBy("speaker_id", "unit").agg(F.max("base").alias("base"))  # a unit is whole in the window of its last row
    units = scratch.keep(units.join(shard_windows(units, bases, p, scratch), "base").select("shard_window", "speaker_id", "unit"), "units")

    speakers = units.groupBy("shard_window", "speaker_id").agg(F.count("*").alias("units"))
    windows = speakers.groupBy("shard_window").agg(F.count("*").alias("able"), F.ceil(F.sum("units") / p).alias("batches"))
    windows = running_total(windows, F.col("batches"), "shard_window", "first_batch")
    ranked = digest_rank(units.select("speaker_id").distinct().withColumn("_d", stable_digest(seed, str(epoch), "speaker", F.col("speaker_id"))), "_d", "speaker_id", name="circle").drop("_d")
    everyone = ranked.count()
    seated = speakers.join(windows, "shard_window").join(ranked, "speaker_id")
    turn = F.pmod(F.col("circle") - F.col("first_batch") * p, F.lit(everyone))
    place = (F.row_number().over(Window.partitionBy("shard_window").orderBy(turn)) - 1).cast("long")  # a window's speakers
    exposures = seated.withColumn("_place", place).withColumn("e", F.explode(F.expr(f"sequence(0L, (batches * {p} - 1 - _place) div able)")))
    seats = exposures.withColumn("_seat", F.col("e") * F.col("able") + F.col("_place")).select(
        "shard_window", "speaker_id", (F.col("first_batch") + F.expr(f"_seat div {p}")).alias("batch_id"), (F.col("_seat") % p).alias("_of"), (F.col("e") % F.col("units")).alias("_nth"), F.expr("e div units").alias("cycle")
    )
    nth = (F.row_number().over(Window.partitionBy("shard_window", "speaker_id").orderBy("unit")) - 1).cast("long")
    taken = seats.join(units.withColumn("_nth", nth), ["shard_window", "speaker_id", "_nth"]).join(members.drop("base"), ["speaker_id", "unit"])
    return taken.select("shard_window", "batch_id", (F.col("_of") * k + F.col("place")).cast("int").alias("slot"), "speaker_id", "path", "cycle", "shard_path")


def epoch_stats(batches: DataFrame) -> DataFrame:
    """One row: batches, logical_selections, unique_selected, repeated_selections, queue_cycles, least and most exposure."""
    per_row = batches.groupBy("path").agg(F.count("*").alias("n"))
    speakers = speaker_exposure(batches)
    a = batches.agg(F.countDistinct("batch_id").alias("batches"), F.count("*").alias("logical_selections"))
    b = per_row.agg(F.count("*").alias("unique_selected"), F.sum(F.col("n") - 1).alias("repeated_selections"))
    c = speakers.agg(F.sum("queue_cycles").alias("queue_cycles"), F.min("exposure").alias("min_exposure"), F.max("exposure").alias("max_exposure"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def speaker_exposure(batches: DataFrame) -> DataFrame:
    """Rows (speaker_id, exposure, queue_cycles): batches that a speaker is in, and times that its queue began again."""
    return batches.groupBy("speaker_id").agg(F.countDistinct("batch_id").alias("exposure"), F.max("cycle").alias("queue_cycles"))


def shards_per_batch(batches: DataFrame) -> DataFrame:
    """Rows (batch_id, n_shards): the different shards that a batch reads."""
    return batches.groupBy("batch_id").agg(F.countDistinct("shard_path").alias("n_shards"))


def round_robin(batches: DataFrame) -> DataFrame:
    """Batches with ``position``: every speaker's first row, then every speaker's second one, and so on."""
    turn = F.row_number().over(Window.partitionBy("batch_id", "speaker_id").orderBy("slot"))
    position = F.row_number().over(Window.partitionBy("batch_id").orderBy("_turn", "speaker_id")) - 1
    return batches.withColumn("_turn", turn).withColumn("position", position).drop("_turn")


def microbatches(batches: DataFrame, size: int) -> DataFrame:
    """Round-robin batches with ``microbatch``; rows (batch_id, microbatch, n_rows, n_speakers, distinct_speakers)."""
    cut = round_robin(batches).withColumn("microbatch", F.expr(f"position div {size}"))
    return cut.groupBy("batch_id", "microbatch").agg(F.count("*").alias("n_rows"), F.countDistinct("speaker_id").alias("n_speakers"), (F.countDistinct("speaker_id") == F.count("*")).alias("distinct_speakers"))


def collate(batches: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """One row per batch with aligned arrays of the given columns in slot order.

    A slot whose path has no row, a missing value, and arrays of different lengths in one batch are errors.
    """
    own = rows.select("path", F.lit(True).alias("_there"), *columns)
    joined = batches.select("batch_id", "slot", "path").join(own, "path", "left")
    whole = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col("path")))).otherwise(F.col("slot"))
    packed = joined.withColumn("slot", whole).groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("slot", "path", *columns))).alias("r"))

    def aligned(c: str) -> Column:
        values = F.col(f"r.{c}")
        bad = F.exists(values, lambda x: x.isNull())
        if dict(rows.dtypes)[c].startswith("array"):
            bad |= F.size(F.array_distinct(F.transform(values, F.size))) > 1
        return F.when(bad, F.raise_error(F.lit(f"the rows of a batch have mixed values of {c}"))).otherwise(values).alias(c)

    return packed.select("batch_id", F.col("r.path").alias("paths"), *map(aligned, columns))


def feed(collated: DataFrame, consume: Callable[[Iterator[dict]], Iterator[dict]], schema: str, parts: int | None = None) -> DataFrame:
    """What ``consume`` makes of batches in their order, as rows of ``schema``.

    Batches are dealt to ``parts`` ranges of consecutive ones, each of which one call takes in ascending order, a batch at
    a time, where the range lies: what is collated never passes through the driver.
    """
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in consume(x for t in tables for k in range(t.num_rows) for x in t.slice(k, 1).to_pylist()):
            yield pa.RecordBatch.from_pylist([row], kinds)

    kinds = to_arrow_schema(collated.sparkSession.createDataFrame([], schema).schema)
    ranges = collated.repartitionByRange(parts, "batch_id") if parts else collated.repartitionByRange("batch_id")
    return ranges.sortWithinPartitions("batch_id").mapInArrow(run, schema)


def resume(batches: DataFrame, position: int, batches_per_epoch: int) -> DataFrame:
    """What is left of an epoch from a position on; one beyond the end is an error."""
    if not 0 <= position < batches_per_epoch:
        raise ValueError("the position lies outside the epoch")
    return batches.where(F.col("batch_id") >= position)
