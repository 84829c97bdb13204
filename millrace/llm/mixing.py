"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the copy probability target/size of its source.
The whole part is copied as it is; the fraction is one unit of mass, counted in
words.  Units are paired: a random transfer moves words between the two until
one of them is whole, which keeps the pair's words and each unit's expected
copies.  Pairing runs inside small buckets of one source; what is left open in
each bucket, one unit at most, goes up a reduction tree until a source has one
open unit, which a last draw settles.  That draw moves the source by up to a
whole document, and pairing leaves the largest open; the root of the tree, which
holds BUCKET units on the average, settles the difference over its units,
larger ones first and by one copy each where that is enough.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.frames import discard, durable

#: Units of one source that one bucket of the tree pairs, on the average.
BUCKET = 1024
#: Part of a source's target that may stay unmet before units change by several copies.
NEAR = 0.005
#: Sources up to which the table of targets is broadcast (a few dozen bytes each); more are joined by key.
BROADCAST_SOURCES = 10_000
#: Runs of white space that the size of a text does not count.
WORD = r"[^\x20\x09-\x0D]+"

_UNIT = "doc_id long, source string, size long, mark long, nth long, whole long, mass double, u double, level int, copies long"
_KEPT = ["doc_id", "source", "size", "mark", "nth", "whole", "mass", "u", "level", "copies"]


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, target, members): water-filled targets; sources rank by code point, null last.

    A source's target is the lesser of cap times its size and its weight times
    one common level, which is raised until all sizes are shared out.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("members"))
    # one row a source, dealt by ranges of the name: ranks are offsets of the ranges plus places inside them
    per = per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    per = durable(per.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "sources")
    starts = per.groupBy("part").agg(F.count("*").alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rank = (F.col("start") + F.col("place")) % len(weights)
    ranked = durable(
        per.join(F.broadcast(starts), "part").select(
            "source", "source_size", "members", F.element_at(F.lit([float(w) for w in weights]), (rank + 1).cast("int")).alias("weight")
        ),
        "ranked",
    )
    discard(per)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = F.col("weight") * level >= F.col("source_size") * cap
        fixed, free = ranked.agg(F.sum(F.when(capped, F.col("source_size") * cap).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        new = (total - fixed) / free if free else level
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", "members", F.least(F.col("weight") * level, F.col("source_size") * float(cap)).alias("target"))


def pair_units(mass: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Pair the units in order; returns each unit's extra copy (0 or 1) and the index of the one left open, or -1.

    mass and size are in words, 0 < mass < size; the open unit's mass is
    written back to mass.
    """
    extra = np.zeros(len(mass), np.int64)
    open_at = -1
    for j in range(len(mass)):
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        up, down = min(size[i] - mass[i], mass[j]), min(mass[i], size[j] - mass[j])
        rise = u[j] * (up + down) < down
        if rise:
            done_i, done_j, move = size[i] - mass[i] <= mass[j], mass[j] <= size[i] - mass[i], up
            extra[i] = done_i
        else:
            done_i, done_j, move = mass[i] <= size[j] - mass[j], size[j] - mass[j] <= mass[i], -down
            extra[j] = done_j
        open_at = -1 if done_i and done_j else (j if done_i else i)
        mass[i] = min(max(mass[i] + move, 0.0), size[i])
        mass[j] = min(max(mass[j] - move, 0.0), size[j])
    return extra, open_at


def settle(copies: np.ndarray, size: np.ndarray, off: float, most: int, near: float, fixed: int = -1) -> tuple[np.ndarray, float]:
    """Copies changed so that the words come nearer by off, and what is still off; larger units go first, 0 to most copies stay.

    Every unit but the fixed one changes by one copy at most; where that leaves more than near, by any number.
    """
    out = copies.copy()
    for steps in (1, most):
        for k in np.argsort(-size, kind="stable"):
            if k != fixed and size[k] and abs(off) > near * (steps > 1):
                n = int(np.clip(np.rint(off / size[k]), max(-steps, -out[k]), min(steps, most - out[k])))
                out[k] += n
                off -= n * size[k]
    return out, abs(off)


def _round_bucket(last: bool, most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "order", "doc_id", "mark", "nth"], ascending=[False, True, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        mass, size, u = rows["mass"].to_numpy().copy(), rows["size"].to_numpy(), rows["u"].to_numpy()
        whole, wanted = rows["whole"].to_numpy(), rows["mass"].sum()
        extra, left = pair_units(mass, size, u)
        rows["mass"] = mass
        rows["copies"] = whole + extra
        if last:
            near = NEAR * (wanted + float((whole * size).sum()))
            if left >= 0:
                extra[left] = (u[left] * 7919.0) % 1.0 * size[left] < mass[left]
            copies, off = whole + extra, wanted - float((extra * size).sum())
            best = settle(copies, size, off, most, near)
            # the largest unit may have to give way where the others have no room
            for step in (0, 1, -1) if best[1] > near else ():
                if 0 <= copies[0] + step <= most:
                    moved = copies.copy()
                    moved[0] += step
                    best = min(best, settle(moved, size, off - step * size[0], most, near, 0), key=lambda x: x[1])
            rows["copies"] = best[0]
        elif left >= 0:
            rows["copies"] = rows["copies"].astype("Int64")
            rows.loc[left, "copies"] = pd.NA
        rows["level"] = rows["level"] + 1
        return rows[_KEPT]

    return run


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """Draw the copies of every document so that each source's words come to its target.

    docs needs doc_id (long), text and source; other columns are ignored.  The
    size of a text is its number of words (null: 0).  Sources, ordered by code
    point with null last, take the weights in turn and share all words; a
    target stops at cap times its source's words and the excess goes to the
    others by weight.  Returns one row per input row: doc_id, source, size,
    source_size, target, copies, taken (copies times size).  A document of
    size 0 has the whole part of its probability as copies and takes nothing.
    Draws depend on seed, doc_id, size and text, and on the place among equal
    rows, so reruns agree whatever the partitioning; equal rows are
    interchangeable.  Also returned: mark (the text's digest) and nth.  An empty table gives an
    empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    # equal rows are counted, then told apart by number
    base = base.groupBy(*base.columns).agg(F.count("*").alias("n")).select(*base.columns, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    base = durable(base, "sizes")
    targets = durable(source_targets(base, weights, cap), "targets")
    sources, most = targets.agg(F.count("*"), F.max("members")).first()
    side = targets.withColumnRenamed("source", "of")
    few = F.broadcast if sources <= BROADCAST_SOURCES else lambda df: df
    joined = base.join(few(side), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # whole part and fraction; a fraction within rounding of a whole number counts as one
    near = F.round(share)
    share = F.when(F.abs(share - near) < 1e-12, near).otherwise(share)
    own = ("doc_id", "size", "mark", "nth")
    units = joined.select(
        "doc_id", "source", "size", "mark", "nth", F.floor(share).cast("long").alias("whole"), ((share - F.floor(share)) * F.col("size")).alias("mass"),
        ((F.xxhash64(F.lit(seed), *own).bitwiseAND((1 << 52) - 1)) / float(1 << 52)).alias("u"), F.lit(0).alias("level"), "members",
    )
    open_rows = units.where("mass > 0")
    done = [units.where("not mass > 0").withColumn("copies", F.col("whole")).select(*_KEPT)]
    rounds, level, most = [], 0, most or 0
    while True:
        buckets = max(1, -(-most // BUCKET))
        mine = F.ceil(F.col("members") / BUCKET**(level + 1)).cast("long")
        spread = open_rows.withColumn("order", F.xxhash64(F.lit(seed + 1 + level), *own)).withColumn(
            "bucket", F.pmod(F.xxhash64(F.lit(seed + 1000 + level), *own), F.greatest(mine, F.lit(1).cast("long")))
        )
        out = durable(spread.groupBy("source", "bucket").applyInPandas(_round_bucket(buckets == 1, int(cap)), _UNIT), "mixed")
        rounds.append(out)
        done.append(out.where("copies is not null"))
        if buckets == 1:
            break
        rest = out.where("copies is null").drop("copies")
        rest = rest.join(few(side.select("of", "members")), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        open_rows = rest.withColumn("u", (F.col("u") * 104729.0) % 1.0)
        most, level = buckets, level + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    result = result.join(few(side), F.col("source").eqNullSafe(F.col("of")), "left")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    result = durable(result.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "copies", taken, "mark", "nth"), "taken")
    for x in (base, targets, *rounds):
        discard(x)
    return result


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with every row repeated as often as mix_sources() draws it; columns as they are, whatever their names.

    Rows that share doc_id and text take the most copies drawn for one of them;
    a null or empty text has no words and stays only where its source's whole
    part is 1 or more.  An empty table gives an empty result.
    """
    drawn = mix_sources(docs, **options).groupBy("doc_id", "mark").agg(F.max("copies").cast("int").alias("copies")).where("copies > 0")
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = left.join(drawn, F.col("row")["doc_id"].cast("long").eqNullSafe(drawn["doc_id"]) & (F.xxhash64(F.col("row")["text"]) == drawn["mark"]))
    rows = joined.select("row", F.explode(F.sequence(F.lit(1), drawn["copies"])).alias("time"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
