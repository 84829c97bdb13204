"""Retry of a whole job with exponential backoff; Spark itself retries tasks."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


@dataclass(frozen=True)
class RetryPolicy:
    """Up to max_retries repeats; waits double from base to max. Without exceptions named, all are retried."""

    max_retries: int = 3
    base_delay_ms: int = 1000
    max_delay_ms: int = 30000
    exceptions: tuple[type[BaseException], ...] = ()

    def __post_init__(self) -> None:
        if self.max_retries < 0 or self.base_delay_ms <= 0 or self.max_delay_ms < self.base_delay_ms:
            raise ValueError("retries must not be negative, delays must be positive and the longest not below the first")

    def should_retry(self, attempt: int, error: BaseException) -> bool:
        """attempt counts the failed tries so far, from 1."""
        return attempt <= self.max_retries and (not self.exceptions or isinstance(error, self.exceptions))

    def delay_ms(self, attempt: int) -> int:
        return min(self.base_delay_ms << min(max(attempt, 1) - 1, 62), self.max_delay_ms)


NO_RETRY = RetryPolicy(max_retries=0)


def run_with_retry(job: Callable[[], T], policy: RetryPolicy = RetryPolicy(), sleep: Callable[[float], None] = time.sleep) -> T:
    """The job's result; the first error that the policy doesn't retry comes out as it is."""
    attempt = 0
    while True:
        try:
            return job()
        except Exception as error:
            attempt += 1
            if not policy.should_retry(attempt, error):
                raise
            sleep(policy.delay_ms(attempt) / 1000)


def run_with_limit(spark: SparkSession, job: Callable[[], T], limit_ms: int) -> T:
    """The job's result; TimeoutError when it takes longer, and its Spark jobs are cancelled then."""
    group, late = f"limit-{uuid.uuid4().hex}", threading.Event()
    context = spark.sparkContext

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    context.setJobGroup(group, "job with a time limit", interruptOnCancel=True)
    timer = threading.Timer(limit_ms / 1000, stop)
    timer.start()
    try:
        return job()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"the job took more than {limit_ms} ms") from error
        raise
    finally:
        timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(key, None)
