"""Queries and SQL of this subpackage; ``__spark_entry__`` adds them to the library's own."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "exact_topk", "packing", "quality", "pii", "mixing", "url_filter", "token_counts", "exact_dedup", "simhash", "licenses",
    "minmax", "collocations", "hard_negatives", "pipeline",
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
        importlib.import_module(f"titrate.llm.{module}")
