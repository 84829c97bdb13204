"""The next row in a global order, without a global window.

Rows are dealt to buckets by ranges of the order key.  The rows that open a
bucket also go to the bucket before it, as guests, so that a window inside
each bucket sees the successor of its last row.  Balance depends on the
boundaries; results do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges for each shuffle partition, and bytes of a range where that gives more of them.
RANGES = 4
RANGE_BYTES = 16 << 20
#: Most ranges, as the list of their bounds goes into the plan.
MOST_RANGES = 1 << 16
#: Bounds looked through at once.
_STEP = 256
_FIRST = -(2**63)


def ranges(df: DataFrame) -> int:
    """How many ranges df is dealt to, from the size that the plan knows before it runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a plan that doesn't know its size says the greatest there is
    return min(max(least, size // RANGE_BYTES if size < 1 << 60 else 0), MOST_RANGES)


def range_of(key: Column, bounds: list, kind: str) -> Column:
    """The number of bounds, in rising order, that are not above key: first every _STEP-th bound is looked at, then those between."""
    lit = lambda some: F.lit(some).cast(f"array<{kind}>") if some else F.array().cast(f"array<{kind}>")
    below = lambda some: F.size(F.filter(some, lambda b: b <= key))
    if len(bounds) <= _STEP:
        return below(lit(bounds))
    whole = F.greatest(below(lit(bounds[::_STEP])) - 1, F.lit(0)) * _STEP
    return whole + below(F.slice(lit(bounds), whole + 1, F.lit(_STEP)))


def by_ranges(df: DataFrame, key: str, bucket: str, guest: str) -> DataFrame:
    """df with an order key that is never null, and each row in its bucket; openers of buckets come again as guests.

    guest is 0 for a row in its own place, 0 < guest for a copy: 1 for the
    opener of the next bucket, 2 for the first rows of all behind the last ones.
    The ranges grow with df up to MOST_RANGES.
    """
    n = ranges(df)
    least, bounds = df.agg(F.min(key), F.percentile_approx(key, F.lit([i / n for i in range(1, n)]), F.lit(10 * n))).first()
    bounds = sorted({b for b in bounds or [] if b > least})
    cuts = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    own = range_of(F.col(key), bounds, "bigint")
    place = lambda b, g: F.struct(F.lit(b).cast("int").alias("b") if isinstance(b, int) else b.cast("int").alias("b"), F.lit(g).alias("g"))
    opens = F.when(F.array_contains(cuts, F.col(key)), F.array(place(own - 1, 1)))
    wraps = F.when(F.col(key) == F.lit(least), F.array(place(len(bounds), 2)))
    none = F.array().cast("array<struct<b:int,g:int>>")
    places = F.concat(F.array(place(own, 0)), F.coalesce(opens, none), F.coalesce(wraps, none))
    out = df.withColumn("_place", F.explode(places)) if least is not None else df.withColumn("_place", F.explode(none))
    return out.withColumn(bucket, F.col("_place.b")).withColumn(guest, F.col("_place.g")).drop("_place")


def order_key(doc_id: Column) -> Column:
    """Ascending ids with null first."""
    return F.coalesce(doc_id.cast("long"), F.lit(_FIRST))
