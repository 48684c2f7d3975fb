"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillion.sources.catalog import driver_view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Driver tables and views of one scale folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return driver_view(self.spark, self._sf_dir, name)


def query(sql: str | None = None, *views: str) -> Callable:
    """Register a function of Tables under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql.strip()
        return f

    return register


for _module in ("retrieval", "governance", "analytics", "workflows", "joins", "versioned", "further"):
    importlib.import_module(f"quillion.plans.{_module}")
