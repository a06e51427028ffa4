"""Named queries: a Spark job each and, where SQL can say it, the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    job: Job
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Job], Job]:
    """Register a job under its function's name."""
    def register(job: Job) -> Job:
        if job.__name__ in REGISTRY:
            raise ValueError(f"two queries named {job.__name__}")
        REGISTRY[job.__name__] = Query(job.__name__, job, sql)
        return job
    return register
