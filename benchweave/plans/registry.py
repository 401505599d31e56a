"""Where queries register: a name, the Spark call and, where SQL can say it, the check text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    oracle: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(run, oracle)
        return run

    return register
