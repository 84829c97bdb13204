"""Collections from rows, from explicit partitions, from DataFrames and from files."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from millrace.operators.collection import Collection


def from_rows(spark: SparkSession, rows: Iterable, schema: StructType | str, partitions: int | None = None) -> Collection:
    """In-memory rows with an explicit schema, dealt to partitions in contiguous runs; no rows are allowed."""
    if partitions is not None and partitions < 1:
        raise ValueError("partitions must be positive")
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    if partitions is None:
        return Collection(spark.createDataFrame(rows, schema))
    size = -(-len(rows) // partitions) or 1
    return from_partitions(spark, [rows[i : i + size] for i in range(0, len(rows), size)], schema)


def from_partitions(spark: SparkSession, parts: Sequence[Sequence], schema: StructType | str) -> Collection:
    """One partition for each sequence of rows; an empty list of partitions gives an empty collection."""
    parts = [[r if isinstance(r, tuple) else (r,) for r in p] for p in parts]
    if not parts:
        return Collection(spark.createDataFrame([], schema))
    # an RDD, as Spark merges small local frames whatever their partitions
    return Collection(spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda p: p), schema))


def from_frame(df: DataFrame) -> Collection:
    return Collection(df)


@dataclass(frozen=True)
class Shared:
    """A value that every executor gets once; value reads it anywhere, destroy() takes it away."""

    held: Broadcast

    @property
    def value(self) -> Any:
        return self.held.value

    def destroy(self) -> None:
        self.held.destroy()


def share(spark: SparkSession, value: Any, max_bytes: int = 64 << 20) -> Shared:
    """A broadcast of a plain value; ValueError when it is larger than max_bytes, as every executor holds all of it."""
    size = len(pickle.dumps(value, pickle.HIGHEST_PROTOCOL))
    if size > max_bytes:
        raise ValueError(f"a shared value of {size} bytes is above max_bytes = {max_bytes}")
    return Shared(spark.sparkContext.broadcast(value))


def read(spark: SparkSession, path: str, format: str = "parquet", schema: StructType | str | None = None, **options) -> Collection:
    """A file source; filters and column choices made later reach the scan."""
    reader = spark.read.format(format).options(**options)
    return Collection((reader.schema(schema) if schema is not None else reader).load(path))
