"""Sinks: bundles, dead messages, the attempt log and outbound orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import error_text


def write_bundles(bundles: DataFrame, path: str) -> None:
    """One JSON document per delivery, partitioned by day of receipt."""
    rows = bundles.select("delivery_id", "accession", "bundle", F.to_date("received_at").alias("received_on"))
    rows.write.mode("append").partitionBy("received_on").parquet(path)


def dead_messages(failures: DataFrame) -> DataFrame:
    """Rows of the dead-message sink: state DMQ, reason, detail cut to 1 000 characters."""
    return failures.select(
        "delivery_id", F.lit("DMQ").alias("state"), F.col("reason").alias("failure_reason"),
        error_text(F.col("detail")).alias("last_error"), "payload")


def write_dead_messages(failures: DataFrame, path: str) -> None:
    dead_messages(failures).write.mode("append").partitionBy("failure_reason").parquet(path)


def write_attempts(attempts: DataFrame, path: str) -> None:
    """Append only; numbers come from the log when it is read (K13), so appends never conflict."""
    attempts.withColumn("started_on", F.to_date("started_at")).write.mode("append").partitionBy("started_on").parquet(path)


def write_orders(orders: DataFrame, path: str) -> None:
    """Order messages ready to send."""
    orders.select("connection_id", "accession", "message").write.mode("append").parquet(path)
