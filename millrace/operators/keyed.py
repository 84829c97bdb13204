"""Keyed: a collection of pairs in the columns k and v."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.reducers import Reducer, ordered
from millrace.operators import joins
from millrace.operators.collection import Collection


class Keyed(Collection):
    def __init__(self, df: DataFrame):
        if df.columns != ["k", "v"]:
            raise ValueError(f"a keyed collection has the columns k and v, not {df.columns}")
        super().__init__(df)

    # pairs

    def keys(self) -> Collection:
        return Collection(self.df.select("k"))

    def values(self) -> Collection:
        return Collection(self.df.select("v"))

    def map_values(self, f: Callable[[Column], Column]) -> Keyed:
        return Keyed(self.df.select("k", f(F.col("v")).alias("v")))

    def filter_keys(self, f: Callable[[Column], Column]) -> Keyed:
        return Keyed(self.df.where(f(F.col("k"))))

    def filter_values(self, f: Callable[[Column], Column]) -> Keyed:
        return Keyed(self.df.where(f(F.col("v"))))

    def flat_map_values(self, f: Callable[[Column], Column]) -> Keyed:
        """The key again for each element of the array that f makes of the value."""
        return Keyed(self.df.select("k", F.explode(f(F.col("v"))).alias("v")))

    def union(self, *others: Collection) -> Keyed:
        return Keyed(super().union(*others).df)

    def distinct(self) -> Keyed:
        return Keyed(self.df.distinct())

    def partition_by_key(self, n: int) -> Keyed:
        return Keyed(self.df.repartition(n, "k"))

    # aggregation

    def group_by_key(self) -> Keyed:
        """All values of each key as a sorted array, nulls kept; a null key is a key.

        A key's values meet in one row, as the result says; reduce_by_key does not need that.
        """
        groups = self.df.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("v"))).alias("v"))
        return Keyed(groups.select("k", F.transform("v", lambda r: r["v"]).alias("v")))

    def reduce_by_key(self, reducer: Reducer) -> Keyed:
        """A commutative reduction, combined before the shuffle."""
        return Keyed(self.df.groupBy("k").agg(reducer.aggregate(F.col("v")).alias("v")))

    def group_by_key_action(self) -> dict:
        return {r["k"]: r["v"] for r in self.group_by_key().df.collect()}

    def reduce_by_key_action(self, reducer: Reducer) -> dict:
        return {r["k"]: r["v"] for r in self.reduce_by_key(reducer).df.collect()}

    # joins: k, v (left value), w (right value)

    def join(self, other: Keyed) -> Collection:
        """Inner join; Spark chooses how."""
        return Collection(joins.inner(self.df, other.df, None))

    def join_by_rows(self, other: Keyed, broadcast_rows: int = 1000, enable_sort_merge: bool = True) -> Collection:
        """Inner join, the strategy chosen by the row counts of both sides, which are counted first."""
        return Collection(joins.by_rows(self.df, other.df, broadcast_rows, enable_sort_merge))

    def shuffle_hash_join(self, other: Keyed) -> Collection:
        return Collection(joins.inner(self.df, other.df, "shuffle_hash"))

    def sort_merge_join(self, other: Keyed) -> Collection:
        return Collection(joins.inner(self.df, other.df, "merge"))

    def broadcast_join(self, other: Keyed, max_rows: int = joins.BROADCAST_ROWS) -> Collection:
        """Inner join with the smaller side broadcast, if it has max_rows at most and its bytes are few; else a sort-merge join."""
        return Collection(joins.broadcast_smaller(self.df, other.df, max_rows))

    def cogroup(self, other: Keyed) -> Collection:
        """Each key of either side with the sorted values of both (k, v, w); a side without it has an empty array."""
        return Collection(joins.cogroup(self.group_by_key().df, other.group_by_key().df))


def reduce_by_key_ordered(rows: Collection, key: Column, value: Column, order: Column, combine: Callable[[Column, Column], Column]) -> Keyed:
    """A left-to-right reduction of each key's values in the order of a column, for operations that need it."""
    return Keyed(rows.df.groupBy(key.alias("k")).agg(ordered(value, order, combine).alias("v")))
