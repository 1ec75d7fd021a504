"""Independent Spark jobs side by side: fits of folds and of estimators leave no executor idle while one of them iterates."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")


def side_by_side(jobs: list[Callable[[], T]], most: int = 8) -> list[T]:
    """The results of the jobs in their order; the first error is raised."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    inherits = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(min(most, len(jobs))) as pool:
        return list(pool.map(lambda job: job(), [inherits(job) for job in jobs]))
