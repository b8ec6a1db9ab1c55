"""Strings: paths, Unicode trimming, integer parsing, numeric-aware order, padded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip(c: Column) -> Column:
    """Trim Unicode white space (Spark's ``trim`` takes off blanks alone)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def parsed_int(c: Column) -> Column:
    """The integer of up to 38 digits that a string spells, with a sign, outer white space and single underscores between
    digits allowed; null for anything else."""
    text = strip(c)
    return F.when(text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("decimal(38,0)"))


def casefolded(c: Column) -> Column:
    """Full Unicode case folding, which ``lower`` only approximates.  ASCII texts are folded by it; only the others go to
    Python, in Arrow batches."""
    import pandas as pd

    def fold(texts):
        return texts.map(lambda x: None if x is None else x.casefold())

    fold.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    ascii_only = c.rlike(r"\A\p{ASCII}*\z")
    return F.coalesce(F.when(ascii_only, F.lower(c)), F.pandas_udf(fold, T.StringType())(F.when(~ascii_only, c)))


def shortest_float(c: Column) -> Column:
    """The shortest text that reads back as the same double, with exponents below 1e-4 and from 1e16 on (two digits at
    least), as most languages other than the JVM's write it.  Doubles go to Python in Arrow batches: the JVM's own digits
    are the shortest from version 19 on only, and then not of the smallest numbers (4.9E-324)."""
    import pandas as pd

    def show(x):
        return pd.Series([repr(v) for v in x.tolist()], dtype=object)

    show.__annotations__ = {"x": pd.Series, "return": pd.Series}
    x = c.cast("double")
    return F.when(x.isNotNull(), F.pandas_udf(show, T.StringType())(x))


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def parent_name(path: Column) -> Column:
    """Name of the directory that holds the file; empty for a bare name."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Extension with its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def safe_path(path: Column, depth: int | None = 2, colons: bool = False) -> Column:
    """Whether a relative POSIX path stays inside its root.

    Null, empty, absolute and backslashed paths and those with a ``..`` part are unsafe; ``depth`` asks for so many
    parts exactly; colons are unsafe unless allowed.
    """
    parts = F.split(path, "/")
    good = (F.length(path) > 0) & ~path.startswith("/") & ~F.contains(path, F.lit("\\")) & ~F.array_contains(parts, "..")
    if not colons:
        good &= ~F.contains(path, F.lit(":"))
    if depth is not None:
        good &= (F.size(parts) == depth) & ~F.array_contains(parts, "") & ~F.array_contains(parts, ".")
    return F.coalesce(good, F.lit(False))


def numeric_aware(c: Column) -> list[Column]:
    """Sort keys: integers first by value, then the others by folded text; ties by the text itself."""
    number = parsed_int(c)
    return [number.isNull(), F.coalesce(number, F.lit(0)), F.when(number.isNull(), F.lower(c)).otherwise(F.lit("")), c]


def numeric_aware_columns(c: Column) -> dict[str, Column]:
    """The same keys under names of their own."""
    return {f"_numeric_aware_{k}": key for k, key in enumerate(numeric_aware(c))}


def numbered(prefix: str, n: Column, digits: int = 5, tail: str = "") -> Column:
    """``prefix`` and a number padded with zeros; longer numbers keep all their digits."""
    return F.format_string(f"{prefix}%0{digits}d{tail}", n.cast("long"))
