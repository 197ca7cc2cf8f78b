"""The query registry: every query with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "sources", "intake", "attribution", "dimensions", "astm", "hl7", "tabular", "interpretation", "recognition",
    "bundles", "delivery", "reports", "orders", "streams",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"titrate.plans.{module}_queries")
