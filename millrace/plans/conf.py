"""Engine settings and their Spark configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from millrace.plans.retry import RetryPolicy


@dataclass(frozen=True)
class EngineConf:
    """Defaults of the engine; times in milliseconds."""

    default_shuffle_partitions: int = 4
    default_parallelism: int = 4
    thread_pool_size: int = 4
    sort_sample_per_partition: int = 20
    broadcast_join_threshold: int = 1000  # rows; see Keyed.join_by_rows
    enable_sort_merge_join: bool = True
    max_task_retries: int = 3
    base_retry_delay_ms: int = 1000
    max_retry_delay_ms: int = 30000
    enable_lineage_recovery: bool = True  # Spark always recomputes lost partitions
    task_timeout_ms: int = 300000  # of a job; see run_with_limit
    sort_max_sample: int = 20000  # no Spark setting bounds the whole sample of a sort
    enable_speculative_execution: bool = False
    speculative_execution_threshold: float = 1.5

    def spark_conf(self) -> dict[str, str]:
        return {
            "spark.sql.shuffle.partitions": str(self.default_shuffle_partitions),
            "spark.default.parallelism": str(self.default_parallelism),
            "spark.sql.execution.rangeExchange.sampleSizePerPartition": str(self.sort_sample_per_partition),
            "spark.task.maxFailures": str(self.max_task_retries + 1),
            "spark.speculation": str(self.enable_speculative_execution).lower(),
            "spark.speculation.multiplier": str(self.speculative_execution_threshold),
            "spark.sql.adaptive.enabled": "true",
        }

    def retry_policy(self) -> RetryPolicy:
        return RetryPolicy(self.max_task_retries, self.base_retry_delay_ms, self.max_retry_delay_ms)

    def local_master(self) -> str:
        """A local master with as many threads as the pool and one try more than retries."""
        return f"local[{self.thread_pool_size},{self.max_task_retries + 1}]"


def isolated(spark: SparkSession, conf: EngineConf) -> SparkSession:
    """A session of its own settings, views and functions beside spark, on the same executors; settings that only a start can change stay."""
    own = spark.newSession()
    for key, value in conf.spark_conf().items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def build_session(conf: EngineConf | None = None, master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; without a master it runs where spark-submit says, or locally."""
    conf = conf or EngineConf()
    builder = SparkSession.builder.appName("millrace").config(map=conf.spark_conf() | extra)
    return (builder.master(master) if master else builder).getOrCreate()
