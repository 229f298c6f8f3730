"""Named queries over the standard tables, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query; ``sql`` gives the same rows on the same tables."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return wrap


for _module in ("temporal", "joins", "aggregates", "markets", "evaluation", "graphs", "relational", "live", "pitches", "books", "shaping", "scoring", "profiles"):
    importlib.import_module(f"chronolake.plans.{_module}")
