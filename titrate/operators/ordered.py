"""Ordered computations per key that stay parallel when one key is hot.

A key's rows are cut into time chunks. Each chunk is summarized by a plain aggregate, the few chunk summaries of a
key are put in order, and the chunk's own rows are ordered only within the chunk. One key with a third of all rows
is spread over all its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_number(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], name: str) -> DataFrame:
    """1-based position of each row within its key."""
    rows = rows.withColumn("_chunk", chunk)
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    return rows.withColumn("_local", local).join(offsets, [*keys, "_chunk"]).withColumn(
        name, (F.col("_local") + F.col("_before")).cast("int")).drop("_chunk", "_local", "_before")


def last_before(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-NULL ``value`` strictly before each row of its key."""
    rows = rows.withColumn("_chunk", chunk).withColumn("_value", value)
    ends = rows.groupBy(*keys, "_chunk").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_here", F.last("_value", ignorenulls=True).over(local))
    return rows.join(carried, [*keys, "_chunk"]).withColumn(name, F.coalesce("_here", "_carry")).drop(
        "_chunk", "_value", "_here", "_carry")


def running_sum(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including each row."""
    rows = rows.withColumn("_chunk", chunk).withColumn("_value", value)
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_here", F.sum("_value").over(local))
    return rows.join(offsets, [*keys, "_chunk"]).withColumn(name, F.col("_here") + F.col("_before")).drop(
        "_chunk", "_value", "_here", "_before")
