"""A lazy collection engine on Spark DataFrames."""

from millrace.functions.reducers import Reducer, reducers
from millrace.operators.collection import Collection
from millrace.operators.keyed import Keyed
from millrace.plans.conf import EngineConf, build_session, isolated
from millrace.plans.retry import RetryPolicy, run_with_limit, run_with_retry
from millrace.sources.frames import Shared, from_frame, from_partitions, from_rows, read, share

__all__ = ["Collection", "EngineConf", "Keyed", "Reducer", "RetryPolicy", "Shared", "build_session", "from_frame", "from_partitions", "from_rows", "isolated", "read", "reducers", "run_with_limit", "run_with_retry", "share"]
