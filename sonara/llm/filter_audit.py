"""Interaction audit of a set of filters by the Hart-Mas-Colell potential.

Of every part of a table and every coalition of filters, the removal game's worth is the number of documents that fail at
least one of the coalition.  The potential of a coalition is its worth plus the potentials of all coalitions that lack one
of its filters, divided by its size; a filter's Shapley value is the grand potential minus the potential without it.  With
five filters that is 32 coalitions a part, and what any order of filters removes at each step is the difference of two of
them, so no order is ever replayed on documents.

Documents are judged where they are read and counted by the set of filters they fail before anything is shuffled, except
for the filter on copies, for which (digest of the text, id) alone is.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: Potentials are held in units of 1 / SCALE, in which they are whole numbers.
SCALE = math.factorial(len(FILTERS))
_COALITIONS = 1 << len(FILTERS)

WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bit k is set if a text fails filter k of A to D: few words, few distinct ones, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    flags = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum(F.when(c, 1 << k).otherwise(0) for k, c in enumerate(flags))


def failure_counts(docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of each part by the set of filters that they fail.

    A document fails E if a row with a smaller id has the same text.  Rows of one text, part and label are counted together
    first, so a text with many copies reaches the comparison as a few rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.sha2(body, 256).alias("digest"), text_failures(body).alias("mask"))
    own = own.groupBy("_doc", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = own.join(marks, F.col("_doc") == F.col("_id"), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    by_text = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("_doc").alias("first"), F.min_by("n", "_doc").alias("of_first"), F.sum(F.when(F.col("_doc").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    by_text = scratch.keep(by_text, "texts")
    several = by_text.groupBy(F.col("digest").alias("_digest")).agg(F.sum("n").alias("_n"), F.min("first").alias("_least")).where("_n > 1").select("_digest", "_least")
    joined = by_text.join(several, F.col("digest") == F.col("_digest"), "left")
    # Rows with the least id of their text, or without an id, have no smaller one.
    safe = F.when(F.col("_digest").isNull(), F.col("n")).otherwise(F.col("no_id") + F.when(F.col("first") == F.col("_least"), F.col("of_first")).otherwise(0))
    split = joined.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), safe.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - safe).alias("n")))).alias("x"))
    weighted = lambda c: F.sum(F.col("x.n") * F.col(c)).alias(c)
    return split.groupBy("part", "x.mask").agg(F.sum("x.n").alias("n"), weighted("good"), weighted("toxic"))


def worths(cells: Column, count: str) -> Column:
    """The removal game's worth of all 32 coalitions, by their bits, from one part's cells (mask, n, good, toxic)."""
    return F.transform(F.sequence(F.lit(0), F.lit(_COALITIONS - 1)), lambda s: F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + F.when(c["mask"].bitwiseAND(s) != 0, c[count]).otherwise(0)))


def potentials(worth: Column) -> Column:
    """SCALE times the potential of all 32 coalitions: each follows from those with one filter less, which have lesser bits."""

    def step(known: Column, s: Column) -> Column:
        less = [F.when(s.bitwiseAND(F.lit(1 << k)) != 0, F.get(known, s.bitwiseAND(F.lit(_COALITIONS - 1 - (1 << k))))).otherwise(0) for k in range(len(FILTERS))]
        total = SCALE * F.get(worth, s) + sum(less)
        return F.concat(known, F.array((total / F.bit_count(s)).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_COALITIONS - 1)), F.array(F.lit(0).cast("long")), step)


def _steps() -> Column:
    """All orders and steps: (filter_order, step, own, before), the filter's bit and the coalition of those before it."""
    rows = []
    for order in ORDERS:
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            rows.append({"filter_order": order, "step": k + 1, "own": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,own:int,before:int>>")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): every source,
    each of the 120 orders of filters A to E and each step.

    Null sources are the part with the empty name, null texts are empty (and copies of each other), rows without an id are
    nobody's copy and have no label, repeated rows of one id all count and none makes the others a copy; an id with several
    labels is good or toxic if one says so.  An empty table gives an empty result; other columns of either table are
    ignored.
    """
    counted = failure_counts(docs, labels, Scratch(docs.sparkSession, "filter-audit"), text)
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # 32 at most
    parts = counted.groupBy("part").agg(F.sum("n").alias("total"), cells.alias("cells"))
    games = parts.select("part", "total", *[worths(F.col("cells"), c).alias(c) for c in ("n", "good", "toxic")])
    games = games.withColumn("potential", potentials(F.col("n")))
    each = games.select("*", F.explode(_steps()).alias("s"))
    grand = F.lit(_COALITIONS - 1)
    own, before, after = F.col("s.own"), F.col("s.before"), F.col("s.own") + F.col("s.before")
    at = lambda game, s: F.get(F.col(game), s)
    removed = at("n", after) - at("n", before)
    return each.select(
        "part", "s.filter_order", "s.step", (F.col("total") - at("n", after)).alias("kept"), removed.alias("removed"), (at("n", own) - removed).alias("redundant"), (at("n", grand) - at("n", grand - own)).alias("unique_fails"),
        (at("good", after) - at("good", before)).alias("good_lost"), (at("toxic", after) - at("toxic", before)).alias("toxic_lost"), (at("potential", grand) - at("potential", grand - own)).alias("shapley"),
    )
