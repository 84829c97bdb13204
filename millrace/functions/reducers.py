"""Ways to reduce many values to one, kept as Catalyst expressions.

A commutative reducer is a built-in aggregate, so Spark combines it before the
shuffle.  An ordered one folds the values in the order of a given column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reducer:
    """aggregate: values -> aggregate column; combine: two results -> one (for fold with a start value)."""

    aggregate: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]


class reducers:
    """Reducers whose order of evaluation does not matter."""

    sum = Reducer(F.sum, lambda a, b: a + b)
    min = Reducer(F.min, lambda a, b: F.least(a, b))
    max = Reducer(F.max, lambda a, b: F.greatest(a, b))
    all = Reducer(F.bool_and, lambda a, b: a & b)
    any = Reducer(F.bool_or, lambda a, b: a | b)
    product = Reducer(F.product, lambda a, b: a * b)

    @staticmethod
    def sums(*fields: str) -> Reducer:
        """The sums of several fields of a struct."""
        return Reducer(lambda v: F.struct(*[F.sum(v[f]).alias(f) for f in fields]), lambda a, b: F.struct(*[(a[f] + b[f]).alias(f) for f in fields]))


def ordered(value: Column, order: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Left-to-right reduction of value in the order of order; ties by value. Nulls are values like others."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    values = F.transform(rows, lambda r: r["v"])
    return F.reduce(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), combine)
