"""Collection: an immutable, lazy handle on a DataFrame.

User functions get and give Columns, so Catalyst sees through them.  The
methods that end in _py take plain Python functions over Arrow batches and
declare their output schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.reducers import Reducer, ordered

if TYPE_CHECKING:
    from millrace.operators.keyed import Keyed


class Collection:
    """Rows with named columns; every transformation gives a new Collection and runs nothing."""

    def __init__(self, df: DataFrame):
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df

    @property
    def value(self) -> Column:
        """The only column, or a struct of all columns."""
        names = self._df.columns
        return self._df[names[0]] if len(names) == 1 else F.struct(*[self._df[n] for n in names])

    def __str__(self) -> str:
        return self._df._jdf.queryExecution().optimizedPlan().toString()

    # element-wise

    def map(self, *columns: Column, **named: Column) -> Collection:
        """One row for each row, made of the given columns."""
        return Collection(self._df.select(*columns, *[c.alias(n) for n, c in named.items()]))

    def filter(self, condition: Column) -> Collection:
        """Rows for which the condition is true; null counts as false."""
        return Collection(self._df.where(condition))

    def flat_map(self, array: Column, name: str = "value") -> Collection:
        """One row for each element of an array column; empty and null arrays give none."""
        return Collection(self._df.select(F.explode(array).alias(name)))

    def map_partitions_py(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> Collection:
        """A Python function over all Arrow batches of a partition."""
        return Collection(self._df.mapInArrow(f, schema))

    def map_py(self, f: Callable[[tuple], tuple], schema: str) -> Collection:
        """A Python function over rows, carried in Arrow batches."""
        made = to_arrow_schema(self._df.sparkSession.createDataFrame([], schema).schema)

        def run(batches):
            for b in batches:
                rows = [f(r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_pylist([dict(zip(made.names, r, strict=True)) for r in rows], schema=made)

        return Collection(self._df.mapInArrow(run, schema))

    def key_by(self, key: Column, value: Column) -> Keyed:
        """Pairs of a key and a value."""
        from millrace.operators.keyed import Keyed

        return Keyed(self._df.select(key.alias("k"), value.alias("v")))

    # sets

    def union(self, *others: Collection) -> Collection:
        """All rows of all sides, duplicates kept; columns go by position."""
        out = self._df
        for o in others:
            out = out.union(o.df)
        return Collection(out)

    def distinct(self) -> Collection:
        """Rows without duplicates, over all partitions."""
        return Collection(self._df.distinct())

    def distinct_within_partitions(self) -> Collection:
        """Each partition's rows without duplicates; partitions are told apart by their number, so memory is bounded by spilling."""
        names = self._df.columns
        numbered = self._df.select(F.struct(*[self._df[n] for n in names]).alias("row"), F.spark_partition_id().alias("part"))
        return Collection(numbered.distinct().select("row.*"))

    # order

    def sort_by(self, *keys: Column | str) -> Collection:
        """A global order; add a unique last key where ties matter."""
        return Collection(self._df.orderBy(*keys))

    def top(self, n: int, *keys: Column | str) -> Collection:
        """The first n rows in an order, without a global sort."""
        return Collection(self._df.orderBy(*keys).limit(n))

    def limit(self, n: int) -> Collection:
        return Collection(self._df.limit(n))

    # partitions

    def repartition(self, n: int) -> Collection:
        """n partitions of even size."""
        return Collection(self._df.repartition(n))

    def coalesce(self, n: int) -> Collection:
        """At most n partitions, merged without a shuffle."""
        return Collection(self._df.coalesce(n))

    def partition_by(self, n: int, *keys: Column | str) -> Collection:
        """n partitions dealt by the keys, which a later grouping by them reuses."""
        return Collection(self._df.repartition(n, *keys))

    def partition_by_id(self, n: int, number: Column) -> Collection:
        """n partitions, each row in the one that number says (from 0; others wrap around, null goes to 0): a partitioner of one's own."""
        return Collection(self._df.repartitionById(n, F.coalesce(F.pmod(number, F.lit(n)), F.lit(0)).cast("int")))

    def partition_by_range(self, n: int, *keys: Column | str) -> Collection:
        return Collection(self._df.repartitionByRange(n, *keys))

    @property
    def num_partitions(self) -> int:
        return self._df.rdd.getNumPartitions()

    # actions

    def collect(self) -> list[Row]:
        return self._df.collect()

    def count(self) -> int:
        return self._df.count()

    def take(self, n: int) -> list[Row]:
        return self._df.take(n)

    def first(self) -> Row:
        """The first row; LookupError when there is none."""
        rows = self._df.take(1)
        if not rows:
            raise LookupError("first() of an empty collection")
        return rows[0]

    def reduced(self, value: Column, reducer: Reducer, name: str = "value") -> Collection:
        """One row with the reduction; null when there are no rows."""
        return Collection(self._df.agg(reducer.aggregate(value).alias(name)))

    def reduce(self, value: Column, reducer: Reducer) -> Any:
        """The reduction of a column; LookupError when there are no rows."""
        n, out = self._df.agg(F.count("*"), reducer.aggregate(value)).first()
        if not n:
            raise LookupError("reduce() of an empty collection")
        return out

    def reduce_ordered(self, value: Column, order: Column, combine: Callable[[Column, Column], Column]) -> Any:
        """A left-to-right reduction of a column in the order of another; all values meet in one row."""
        n, out = self._df.agg(F.count("*"), ordered(value, order, combine)).first()
        if not n:
            raise LookupError("reduce_ordered() of an empty collection")
        return out

    def folded(self, value: Column, initial: Column, reducer: Reducer, name: str = "value") -> Collection:
        """One row: the reduction with the start value taken in once; the start value alone when there are no rows."""
        out = reducer.aggregate(value)
        return Collection(self._df.agg(F.when(F.count("*") > 0, reducer.combine(initial, out)).otherwise(initial).alias(name)))

    def fold(self, value: Column, initial: Column, reducer: Reducer) -> Any:
        return self.folded(value, initial, reducer).df.first()[0]

    def aggregated(self, **aggregates: Column) -> Collection:
        """Several aggregates in one pass."""
        return Collection(self._df.agg(*[c.alias(n) for n, c in aggregates.items()]))

    def aggregate(self, **aggregates: Column) -> Row:
        return self.aggregated(**aggregates).df.first()

    def foreach(self, f: Callable[[Row], None]) -> None:
        """Calls f on the driver for each row, a partition at a time, so its side effects are seen here."""
        for row in self._df.toLocalIterator():
            f(row)

    def cache(self) -> Collection:
        return Collection(self._df.cache())
