"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

Text statistics are taken from whole texts.  Each statistic is then scaled to an integer and sketched: a sketch is a
log-linear histogram (six significant bits, so relative error is under 1/32), held as rows (group, measure, bucket,
count).  Sketches merge by adding counts, whatever the order, which gives the sketch of a language, or of everything,
from those of its sources.  To every group's sketch those of its language and of all documents are added, each scaled down
to a fixed number of documents: whatever its size, a group has cutoffs of its own, which lean on what is common the more
the fewer documents it has.  A measure's cutoffs are its quartiles widened by a multiple of their distance plus a slack.
Documents are filtered by joining them with their group's cutoffs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Groups whose cutoffs, some hundred bytes each, are broadcast.
MAX_GROUPS = 100_000

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measure(NamedTuple):
    """An integer expression over the statistics, and the least distance of its cutoffs from the quartiles."""

    expression: str
    slack: int
    lower: bool = False


#: Per 10,000 words, or thousandths of a code point.
MEASURES = {
    "word_length": Measure("1000 * word_chars div nullif(n_words, 0)", 2000, lower=True),
    "symbols": Measure("10000 * n_symbols div nullif(n_words, 0)", 1000),
    "dup_lines": Measure("10000 * n_dup_lines div nullif(n_words, 0)", 400),
    "repeats": Measure("10000 * n_repeat_words div nullif(n_words, 0)", 2500),
}


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which are not the first of theirs."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.zeros(len(key) + 1, bool)
    if len(key):
        same[1:-1] = ordered[1:] == ordered[:-1]
    often, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    often[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return often, later


def _in_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return K.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_statistics(chunk: K.Chunk) -> dict[str, np.ndarray]:
    """The five statistics of each document of a chunk."""
    data, w = chunk.data, K.words(chunk)
    n_words = np.diff(w.bounds)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    points = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)

    first, doc = K.window_starts(w.bounds, 3)
    often, _ = _repeated(_in_doc(K.run_hash(w.hash, first, first + 3), doc))
    covered = np.zeros(len(w.start), bool)
    for k in range(3):
        covered[first[often] + k] = True

    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, chunk.offsets[:-1][n_words > 0])
    starts = starts[starts < len(data)]
    ends = np.r_[starts[1:], len(data)]
    line_doc = np.searchsorted(chunk.offsets, starts, side="right") - 1
    ends = np.minimum(ends, chunk.offsets[line_doc + 1])
    ends -= data[np.maximum(ends, 1) - 1] == 10
    has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_doc = starts[has_word], ends[has_word], line_doc[has_word]
    _, later = _repeated(_in_doc(K.span_hash(data, starts, ends), line_doc))
    return {
        "n_words": n_words,
        "word_chars": _per_doc(points, chunk.offsets),
        "n_symbols": _per_doc(_SYMBOL[data], chunk.offsets),
        "n_dup_lines": np.bincount(line_doc[later], minlength=len(n_words)),
        "n_repeat_words": _per_doc(covered, w.bounds),
    }


def with_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns and the five statistics of every row; a null text is an empty one."""
    keep = tuple(dict.fromkeys(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [text_statistics(c) for c in K.chunks(batch.column(len(keep)))]
            if parts:
                columns = [pa.array(np.concatenate([p[s] for p in parts]).astype(np.int64)) for s in STATISTICS]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *STATISTICS])

    types = dict(docs.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{s} long" for s in STATISTICS)])
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def sketch(stats: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Rows (group, measure, bucket, n) over documents with a word."""
    value = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(x.expression).alias("v")) for m, x in MEASURES.items()]))
    values = stats.where("n_words > 0").select(*by, value.alias("x")).select(*by, "x.measure", "x.v")
    bucket = F.expr("shiftleft(shiftright(v, greatest(length(bin(v)) - 6, 0)), greatest(length(bin(v)) - 6, 0))")
    return values.groupBy(*by, "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The sketch of coarser groups."""
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def blend(fine: DataFrame, weights: tuple[int, int]) -> DataFrame:
    """The sketches (lang, source, measure, bucket, n) of ``fine`` with those of their languages and of all documents merged
    in, scaled to the two ``weights`` in documents.

    Counts are multiplied out instead of divided, so they stay whole numbers; quartiles do not change by that.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    total = lambda t, by, name: t.groupBy(*by, "measure").agg(F.sum("n").alias(name))
    coarse, whole = merge(fine, ("lang",)), merge(fine, ())
    langs, all_of = total(coarse, ("lang",), "in_lang"), total(whole, (), "in_all").withColumnRenamed("measure", "_m")
    groups = fine.select("lang", "source", "measure").distinct()
    named = lambda t, cols: t.select(*[F.col(c).alias(f"_{c}") for c in cols])
    same = lambda *cols: reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols])
    of_lang = groups.join(named(coarse, ("lang", "measure", "bucket", "n")), same("lang", "measure")).select("lang", "source", "measure", F.col("_bucket").alias("bucket"), F.lit(0).cast("long").alias("own"), F.col("_n").alias("parent"), F.lit(0).cast("long").alias("every"))
    of_all = groups.join(named(whole, ("measure", "bucket", "n")), same("measure")).select("lang", "source", "measure", F.col("_bucket").alias("bucket"), F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("parent"), F.col("_n").alias("every"))
    own = fine.select("lang", "source", "measure", "bucket", F.col("n").alias("own"), F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("every"))
    sums = own.unionByName(of_lang).unionByName(of_all).groupBy("lang", "source", "measure", "bucket").agg(*[F.sum(c).alias(c) for c in ("own", "parent", "every")])
    scaled = sums.join(named(langs, ("lang", "measure", "in_lang")), same("lang", "measure")).join(F.broadcast(all_of), F.col("measure") == F.col("_m"))
    n = wide("own") * wide("_in_lang") * wide("in_all") + F.lit(weights[0]) * wide("parent") * wide("in_all") + F.lit(weights[1]) * wide("every") * wide("_in_lang")
    return scaled.select("lang", "source", "measure", "bucket", n.cast("decimal(38,0)").alias("n"))


def cutoffs(sketches: DataFrame, by: tuple[str, ...], widen: float) -> DataFrame:
    """One row per group: ``low_`` and ``high_`` of each measure."""
    group = Window.partitionBy(*by, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketches.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)})
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    quartiles = ranked.groupBy(*by, "measure").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * widen
    slack = F.create_map(*[y for m, x in MEASURES.items() for y in (F.lit(m), F.lit(x.slack))])[F.col("measure")]
    limits = quartiles.select(*by, "measure", (F.col("q1") - spread - slack).alias("low"), (F.col("q3") + spread + slack).alias("high"))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return limits.groupBy(*by).agg(
        *[of(m, "low").alias(f"low_{m}") for m, x in MEASURES.items() if x.lower],
        *[of(m, "high").alias(f"high_{m}") for m in MEASURES],
    )


def apply_rules(docs: DataFrame, weights: tuple[int, int] = (100, 25), widen: float = 3.0, text: str = "text") -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and ``kept`` of every row.

    ``base_failed``: under 50 words, or over half of the words in repeated three-word windows.  ``kept``: not
    ``base_failed`` and every measure within the cutoffs of the row's language and source, to whose sketch those of the
    language and of all documents are added as so many documents as the two ``weights`` say.  Null languages and sources form groups of their
    own; null and empty texts fail the base rule; repeated rows are judged alike; an empty table gives an empty result;
    other columns are ignored.  Cutoffs of up to ``MAX_GROUPS`` groups are broadcast; those of more groups are joined by
    shuffling the statistics.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    stats = scratch.keep(with_statistics(docs, text), "statistics")  # texts are read once
    limits = cutoffs(blend(scratch.keep(sketch(stats), "sketch"), weights), ("lang", "source"), widen)
    chosen = scratch.keep(limits.withColumnsRenamed({"lang": "_0_lang", "source": "_0_source"}), "cutoffs")
    if chosen.count() <= MAX_GROUPS:  # so that documents of a common source stay where they are
        chosen = F.broadcast(chosen)
    judged = stats.join(chosen, F.col("lang").eqNullSafe(F.col("_0_lang")) & F.col("source").eqNullSafe(F.col("_0_source")), "left")
    base_failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return judged.select("doc_id", *STATISTICS, base_failed.alias("base_failed"), (~base_failed & _within()).alias("kept"))


def _within() -> Column:
    fits = F.lit(True)
    for m, x in MEASURES.items():
        value = F.expr(x.expression)
        fits &= value <= F.col(f"high_{m}")
        if x.lower:
            fits &= value >= F.col(f"low_{m}")
    return F.coalesce(fits, F.lit(False))
