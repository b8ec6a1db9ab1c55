"""Proof that CSV files are, byte for byte, the canonical rendering of a table, without collecting either.

Files are read as lines with the places that they have in the whole: by file name, block and line.  Rows are rendered to
lines and ranked.  Both sides come down to numbers of lines and bytes and an order-dependent digest tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import ordered_identity
from ..functions.ranking import ordered_rank, running_total
from ..operators.contracts import all_of, violations
from ..scratch import Scratch

#: Options of the rendering, besides Spark's own.
CSV = {"escape": '"'}


def rendered_lines(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows (place, line) of the table in ``order``, which must be unique.  A value with a line break is an error."""
    line = F.to_csv(F.struct(*rows.columns), CSV)
    whole = F.when(F.contains(line, F.lit("\n")), F.raise_error(F.lit("a canonical line holds no line break"))).otherwise(line)
    return ordered_rank(rows, list(order), "place", "rendered-lines").select("place", whole.alias("line"))


def stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (place, line, file, bytes) of CSV files' lines after their headers, and of the headers with null places.

    Only LF ends a line, so any other line end is part of it; ``bytes`` is the size of the whole file.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("at"))
    lines = Scratch(spark, "stored-lines").keep(lines, "lines")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    is_head = (F.col("block") == 0).cast("long")
    ranked = running_total(ordered_rank(blocks, [F.col("file"), F.col("block")], "rank", "stored-lines"), F.col("lines") - is_head, "rank", "before")
    own = ranked.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "first", "before")
    placed = lines.join(own, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    place = F.when((F.col("block") > 0) | (F.col("at") > F.col("first")), F.col("before") + F.col("at") - F.col("first") - is_head)
    return placed.select(place.alias("place"), F.col("value").alias("line"), "file", "bytes")


def stored_identity(stored: DataFrame) -> DataFrame:
    """One row (n_lines, n_bytes, identity) of stored lines without the headers; ``n_bytes`` comes from the files' sizes."""
    files = stored.groupBy("file", "bytes").agg(F.sum(F.when(F.col("place").isNull(), F.octet_length("line") + 1).otherwise(0)).alias("head"))
    size = files.agg(F.coalesce(F.sum(F.col("bytes") - F.col("head")), F.lit(0)).cast("long").alias("_bytes"))
    found = ordered_identity(stored.where("place is not null"))
    return found.join(F.broadcast(size)).select("n_lines", F.col("_bytes").alias("n_bytes"), "identity")


def csv_violations(rows: DataFrame, path: str, *order: Column, stored: DataFrame | None = None) -> DataFrame:
    """What keeps CSV files from being the canonical rendering of ``rows``: a header that is not the columns' names, another
    number of lines or bytes (say, other line ends or none at the end), other content or another order.

    ``stored`` are the files' lines (``stored_lines``) if they were read and kept already."""
    scratch = Scratch(rows.sparkSession, "csv-violations")
    stored = scratch.keep(stored_lines(rows.sparkSession, path), "stored") if stored is None else stored
    want = ordered_identity(rendered_lines(rows, *order)).select(*[F.col(c).alias(f"_{c}") for c in ("n_lines", "n_bytes", "identity")])
    both = scratch.keep(stored_identity(stored).join(F.broadcast(want)), "both")  # one row for three rules
    key = F.lit(path)
    return all_of(
        violations(stored.where("place is null"), "header", F.col("file"), F.col("line") != ",".join(rows.columns), F.col("line")),
        violations(both, "lines", key, F.col("n_lines") != F.col("_n_lines"), F.col("n_lines")),
        violations(both, "bytes", key, F.col("n_bytes") != F.col("_n_bytes"), F.col("n_bytes")),
        violations(both, "content_or_order", key, F.col("identity") != F.col("_identity"), F.col("identity")),
    )
