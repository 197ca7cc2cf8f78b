"""Shared helpers: tables, written intermediates, shipping of functions, column names."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titrate.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends there and any executor can read them again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/titrate-{spark.sparkContext.applicationId}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """Rows that read in the same order twice, for operators that number rows as they are read.

    Files do. A plan with an exchange may order its rows anew when other columns are asked for: such rows are written to the shared folder first.
    """
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return written(df, "settled") if "Exchange" in plan or "Sample" in plan else df


def travels(module: str) -> None:
    """Functions of the module are sent to executors by value: workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def per_worker(name: str, build: Callable[[], Any]) -> Any:
    """What ``build`` gives, kept for all tasks of one Python worker: for tables that are costly to load, and memos of bounded size."""
    kept = sys.modules.setdefault("titrate_worker", types.ModuleType("titrate_worker")).__dict__
    if name not in kept:
        kept[name] = build()
    return kept[name]


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """The table without its own columns of these names (a result column replaces a namesake, whatever its case)."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in taken])


def keep_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[f"`{c.replace('`', '``')}`" for c in like.columns])


def partitions_for(count: int, each: int, least: int = 1) -> int:
    return max(least, -(-count // each))


travels(__name__)
