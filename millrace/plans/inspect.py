"""Looking at plans: shuffles and join strategies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def executed_plan(df: DataFrame) -> str:
    """The physical plan; after a run, the final one alone."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(df: DataFrame) -> int:
    """Shuffle exchanges in the physical plan; broadcasts don't count."""
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition|REPARTITION)", executed_plan(df)))


def is_wide(df: DataFrame) -> bool:
    return exchanges(df) > 0


def join_strategy(df: DataFrame) -> str | None:
    """The first join operator of the physical plan."""
    m = re.search(r"BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin|BroadcastNestedLoopJoin|CartesianProduct", executed_plan(df))
    return m[0] if m else None
