"""Joins to dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_dimension(facts: DataFrame, dimension: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Facts with the dimension row of their key; each key holds one.

    No hint and no driver-side count: Spark broadcasts the dimension when its size in bytes allows (from file sizes when the plan is made, from
    measured sizes when it runs). Beyond that the join shuffles, and adaptive execution splits the partitions of a hot key (one connection with a
    third of all messages).
    """
    return facts.join(dimension, keys, how)


def join_rows(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Two tables that both grow with the input, joined by a key of which each holds few rows.

    Sorted and merged: estimates from file sizes and compressed shuffle sizes can stay below the broadcast threshold while the rows themselves fill
    the driver, and a table of one row for each file is never small for long.
    """
    return left.join(right.hint("merge"), keys, how)
