"""The register of queries: a Spark job and, where SQL can say it, the statement that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Job], Job]:
    def keep(job: Job) -> Job:
        if key in QUERIES:
            raise KeyError(f"{key} is registered twice")
        QUERIES[key] = job
        if sql is not None:
            ORACLES[key] = sql
        return job

    return keep
