"""Registry of named queries with their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wrenchbook.plans.bindings import Tables, with_bindings

FAMILIES = ("orders", "analytics", "knowledge", "retrieval", "quality", "commands", "evaluation", "streams")


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None
    extra: dict[str, str] | None

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.build(Tables(spark, directory))

    def sql(self) -> str | None:
        return None if self.oracle is None else with_bindings(self.oracle, self.extra)


_QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    """Registers a function from tables to a DataFrame; ``covers`` names the operators."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, covers, build, oracle, extra)
        return build

    return register


def all_queries() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"wrenchbook.plans.{family}")
    return dict(_QUERIES)
