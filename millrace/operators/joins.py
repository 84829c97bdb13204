"""Inner equi-joins of pairs by strategy, and cogroup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a side that an explicit broadcast join sends to all executors, and most bytes by the plan's own estimate.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 << 20


def inner(left: DataFrame, right: DataFrame, hint: str | None, hint_left: bool = False) -> DataFrame:
    """(k, v, w) for all pairs of rows with equal keys; null keys match nothing."""
    left, right = left.select("k", "v"), right.select("k", F.col("v").alias("w"))
    if hint and hint_left:
        left = left.hint(hint)
    elif hint:
        right = right.hint(hint)
    return left.join(right, "k").select("k", "v", "w")


def choose(left_rows: int, right_rows: int, broadcast_rows: int, enable_sort_merge: bool) -> str:
    """The strategy for two row counts; a side at the threshold is still broadcast."""
    if min(left_rows, right_rows) <= broadcast_rows:
        return "broadcast"
    return "merge" if enable_sort_merge else "shuffle_hash"


def rows_up_to(df: DataFrame, most: int) -> int:
    """The number of rows, or most + 1 if there are more: no more are counted."""
    return df.select(F.lit(1)).limit(most + 1).count()


def plan_bytes(df: DataFrame) -> int | None:
    """The size that the optimizer expects df to have; None where it doesn't know, as for rows from memory."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def text_bytes(df: DataFrame) -> int:
    """The length of all rows as JSON, which is measured by reading them."""
    return df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0


def by_rows(left: DataFrame, right: DataFrame, broadcast_rows: int, enable_sort_merge: bool) -> DataFrame:
    n, m = rows_up_to(left, broadcast_rows), rows_up_to(right, broadcast_rows)
    return inner(left, right, choose(n, m, broadcast_rows, enable_sort_merge), hint_left=n <= m)


def broadcast_smaller(left: DataFrame, right: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast of the side with the smaller plan, if its rows are counted to be few and its bytes expected to be; else a sort-merge join."""
    sizes = [plan_bytes(left), plan_bytes(right)]
    if None in sizes:
        n, m = rows_up_to(left, max_rows), rows_up_to(right, max_rows)
        small = left if n <= m else right
        fits = min(n, m) <= max_rows and text_bytes(small) <= max_bytes
    else:
        small = left if sizes[0] <= sizes[1] else right
        fits = min(sizes) <= max_bytes and rows_up_to(small, max_rows) <= max_rows
    return inner(left, right, "broadcast" if fits else "merge", hint_left=small is left)


def cogroup(left: DataFrame, right: DataFrame) -> DataFrame:
    """Groups of both sides by key, null keys together; each side has one row a key."""
    right = right.select(F.col("k").alias("k2"), F.col("v").alias("w"))
    both = left.withColumn("l", F.lit(True)).join(right, left["k"].eqNullSafe(right["k2"]), "full")
    return both.select(F.when(F.col("l"), F.col("k")).otherwise(F.col("k2")).alias("k"), F.coalesce("v", F.array()).alias("v"), F.coalesce("w", F.array()).alias("w"))
