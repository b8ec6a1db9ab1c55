"""Bounded training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: One row in this many is the unit of a sampling rate.
_UNITS = 1_000_000
#: Labels of documents with this remainder are never learnt from.
HELD_OUT = 2


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept for judging: crc32 of the id as text, modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def hashed_sample(rows: DataFrame, bound: int, total: int, seed: int, key: str = "doc_id") -> DataFrame:
    """About ``bound`` of ``total`` rows, chosen by a hash of their key; all of them if there are no more."""
    if total <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(_UNITS)) < bound * _UNITS // total)


def sampled_texts(docs: DataFrame, chosen: DataFrame, bound: int, scratch: Scratch, text: str = "text") -> DataFrame:
    """The columns of ``chosen`` (_id, ...; one row for each id), which has about ``bound`` rows at most, with ``_text`` of
    its documents, where there is one.

    Of the texts that rows of one id have, that of least hash is taken, so there are no more rows than ids however often an
    id occurs.  The ids are counted and broadcast, so only texts of the sample are shuffled, one for each id and task.
    """
    chosen = scratch.keep(chosen, "chosen")
    n = chosen.count()
    if n > 2 * bound + 1000:  # a hash takes a share of rows, give or take a few in a hundred
        raise ValueError(f"{n} rows were chosen where {bound} are the bound")
    own = docs.select(F.col("doc_id").alias("_doc"), F.col(text).cast("string").alias("_text"))
    found = own.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    one = found.groupBy(*chosen.columns).agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"))).alias("_one"))
    return scratch.keep(one.select(*[c for c in chosen.columns if c != "_id"], F.col("_one.t").alias("_text")), "sample")


def training_labels(labels: DataFrame, column: str, bound: int, seed: int) -> DataFrame:
    """(doc_id, y, weight) of labelled rows that may be learnt from, one row per id.

    Of each class about half of ``bound`` are taken, chosen by hash; ``weight`` is the number of rows that each stands for.
    """
    usable = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    ids = usable.groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [hashed_sample(ids.where(F.col("y") == y), bound // 2, counts.get(y, 0), seed).withColumn("weight", F.lit(max(1.0, 2 * counts.get(y, 0) / bound))) for y in (0, 1)]
    return parts[0].unionByName(parts[1])
