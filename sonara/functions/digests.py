"""SHA-256 digests of values and of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the digest formats.
RANK_SEPARATOR = "|"
PART_SEPARATOR = "\x1f"


def sha256(c: Column) -> Column:
    """Lower-case hex."""
    return F.sha2(c.cast("binary"), 256)


def ranking_digest(seed: int, speaker: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}{RANK_SEPARATOR}"), speaker), 256)


def stable_digest(seed: int, *parts: Column | str) -> Column:
    """Digest of the parts with separators between; null if a part is null (``concat_ws`` would skip it)."""
    columns = [F.lit(str(seed))]
    for p in parts:
        columns += [F.lit(PART_SEPARATOR), F.lit(p) if isinstance(p, str) else p.cast("string")]
    return F.sha2(F.concat(*columns), 256)


def canonical_pair(left: Column, right: Column) -> tuple[Column, Column]:
    """The two in order; a pair with itself is an error."""
    same = F.raise_error(F.concat(F.lit("self-pairs are forbidden: "), left))
    return F.when(left == right, same).otherwise(F.least(left, right)), F.greatest(left, right)


def canonical_json(*columns: str) -> Column:
    """Compact JSON with sorted keys; null fields are kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def table_identity(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (n_rows, identity) that depends on the rows' content alone, not on their order.

    Each row's canonical JSON is hashed.  The row digests form a tree: the sorted ones of each prefix of six digits are
    hashed together, then the prefixes' digests of each three digits, then those.  Six digits give 16.7 million groups,
    so a group stays small at any size; the two upper steps see 4096 digests each at most.
    """
    names = columns or tuple(rows.columns)
    joined = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"])
    digests = rows.select(F.sha2(canonical_json(*names), 256).alias("d"))
    leaves = digests.groupBy(F.substring("d", 1, 6).alias("p")).agg(F.count("*").alias("n"), joined(F.sort_array(F.collect_list("d"))).alias("h"))
    branches = leaves.groupBy(F.substring("p", 1, 3).alias("q")).agg(F.sum("n").alias("n"), joined(in_order).alias("h")).withColumnRenamed("q", "p")
    return branches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), joined(in_order).alias("identity"))


#: Lines or digests that are hashed together, and levels of such groups: enough for 10 ** 12 lines.
FANOUT, LEVELS = 1024, 4


def ordered_identity(lines: DataFrame, place: str = "place", line: str = "line") -> DataFrame:
    """One row (n_lines, n_bytes, identity) that depends on every byte and on the order of the lines.

    ``place`` numbers the lines from 0; each is counted with one line end.  Line digests are the leaves of a tree in which
    every ``FANOUT`` consecutive nodes have a parent, so no task sees more than that many of them.
    """
    level = lines.select(F.col(place).cast("long").alias("p"), sha256(F.col(line)).alias("h"), F.lit(1).cast("long").alias("n"), (F.octet_length(line) + 1).cast("long").alias("b"))
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n"), 256)
    for _ in range(LEVELS):
        level = level.groupBy(F.expr(f"p div {FANOUT}").alias("q")).agg(joined.alias("h"), F.sum("n").alias("n"), F.sum("b").alias("b")).withColumnRenamed("q", "p")
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes"), joined.alias("identity"))


#: Lanes of a multiset's state, and what they are counted modulo.
LANES, MODULUS = 4, 1 << 64


def multiset_state(rows: DataFrame, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (``by``, n_rows, lane0 to lane3): what identifies the rows of each group, whatever their order.

    The digest of a row's canonical JSON is cut into lanes, each of which is summed modulo 2 ** 64.  States of disjoint
    parts add up to that of the whole (``merged_state``), so adding or removing rows needs only those rows.
    """
    names = columns or tuple(c for c in rows.columns if c not in by)
    digest = rows.select(*by, F.sha2(canonical_json(*names), 256).alias("_d"))
    lanes = [F.conv(F.substring("_d", 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)").alias(f"lane{k}") for k in range(LANES)]
    return _summed(digest.select(*by, F.lit(1).cast("long").alias("n_rows"), *lanes), by)


def _summed(states: DataFrame, by: tuple[str, ...]) -> DataFrame:
    lanes = [F.pmod(F.coalesce(F.sum(f"lane{k}"), F.lit(0).cast("decimal(38,0)")), F.lit(str(MODULUS)).cast("decimal(38,0)")).cast("decimal(20,0)").alias(f"lane{k}") for k in range(LANES)]
    return states.groupBy(*by).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *lanes)


def merged_state(*states: DataFrame, removed: tuple[DataFrame, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """The state of all rows of ``states`` but those of ``removed``."""
    wide = lambda s, sign: s.select(*by, (sign * F.col("n_rows")).alias("n_rows"), *[(F.col(f"lane{k}").cast("decimal(38,0)") * sign).cast("decimal(38,0)").alias(f"lane{k}") for k in range(LANES)])
    parts = [wide(s, 1) for s in states] + [wide(s, -1) for s in removed]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return _summed(both, by)


def state_identity(state: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (``by``, n_rows, identity) of states."""
    return state.select(*by, "n_rows", sha256(F.concat_ws(RANK_SEPARATOR, "n_rows", *[f"lane{k}" for k in range(LANES)])).alias("identity"))
