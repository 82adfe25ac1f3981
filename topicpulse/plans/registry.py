"""The query catalogue: every operator as a named query with its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from topicpulse.plans.adapters_sql import with_adapters
from topicpulse.sources.tables import SampleStore


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SampleStore], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(SampleStore(spark, folder))


CATALOGUE: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(store) -> DataFrame`` under ``name``; ``oracle`` is DuckDB SQL."""

    def add(fn: Callable[[SampleStore], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        CATALOGUE[name] = Query(name, fn, with_adapters(oracle) if oracle else None)
        return fn

    return add


def catalogue() -> dict[str, Query]:
    """All queries; importing the plan modules fills the catalogue."""
    from topicpulse import plans

    plans.load()
    return CATALOGUE
