"""Keyed permutations of whole numbers, pair numbers, greatest common divisors: samples without forming what is sampled."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .digests import PART_SEPARATOR

ROUNDS = 4
#: Times that a number outside the range is permuted again.
WALKS = 16


def div(a: Column, b: Column) -> Column:
    """Whole quotient of two non-negative numbers."""
    return F.call_function("div", a, b)


def _placed(head: str, x: int, size: int) -> int:
    """The place of one number; ``head`` begins the digests of its rounds."""
    start, left_size = head.encode(), max(math.ceil(math.sqrt(size)), 1)
    right_size = (size + left_size - 1) // left_size
    drawn = lambda r, v: int.from_bytes(sha256(b"%s%d\x1f%d" % (start, r, v)).digest()[:8], "big") >> 4
    left, right = divmod(x, right_size)
    for _ in range(WALKS):
        for r in range(0, ROUNDS, 2):
            left = (left + drawn(r, right)) % left_size
            right = (right + drawn(r + 1, left)) % right_size
        if (x := left * right_size + right) < size:
            return x
    raise ValueError("a keyed permutation did not come back into its range")


def keyed_permutation(x: Column, size: Column, seed: int, *key: Column | str) -> Column:
    """The place of ``x`` (0 to ``size`` - 1) in a permutation of that range that ``seed`` and ``key`` choose.

    A Feistel network on pairs (left, right) of the smallest near-square grid with ``size`` cells or more: rounds add a
    digest of one half to the other.  A cell beyond the range is permuted again until it lies inside.  The grid has fewer
    than sqrt(size) + 1 cells too many, so ``WALKS`` times are always enough up to a size of 256 and more than ever
    needed beyond; running out of them is an error, and so is a null.  Numbers go to Python in Arrow batches, which takes a
    tenth of the time of a fold over all rounds and walks as an expression.
    """
    @F.pandas_udf("long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for heads, numbers, sizes in batches:
            if heads.isna().any() or numbers.isna().any() or sizes.isna().any():
                raise ValueError("a keyed permutation takes no nulls")
            yield pd.Series([_placed(*each) for each in zip(heads.tolist(), numbers.tolist(), sizes.tolist())], dtype="int64")

    parts = [F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in key]]
    return run(F.concat(*[c for p in parts for c in (p, F.lit(PART_SEPARATOR))]), x.cast("long"), size.cast("long"))


def pair_of(number: Column) -> tuple[Column, Column]:
    """The pair i < j with number j (j - 1) / 2 + i."""
    near = F.floor((1 + F.sqrt(1 + 8 * number.cast("double"))) / 2).cast("long")
    start = lambda j: F.shiftright(j * (j - 1), 1)
    j = F.when(start(near) > number, near - 1).when(start(near + 1) <= number, near + 1).otherwise(near)
    return number - start(j), j


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive numbers."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]  # steps of Euclid's algorithm on 64 bits at most
