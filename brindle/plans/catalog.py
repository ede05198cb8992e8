"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "ds01_forecasting"
MODULES = ("datasets", "relational", "marts", "analytics", "quality", "bi", "io_streams", "panels", "evidence", "studies")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def registered(name: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query that is registered already, and its oracle."""
    return _QUERIES[name], _ORACLES[name]


def _load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"brindle.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
