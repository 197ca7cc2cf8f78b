"""Streaming queries (N): each drives a stream over the tables to its end and reads back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import frames
from ..session import checkpoint_dir
from ..streaming import jobs
from . import testbed as tb
from .delivery_queries import NOW_SQL, QUEUE_SQL, fold_sql, log, now, queue
from .intake_queries import SESSION_SQL, wire_frames
from .registry import query


def places(spark, n=3):
    """Fresh folders below the shared checkpoint folder."""
    root = f"{checkpoint_dir(spark)}/titrate-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    return [f"{root}/{i}" for i in range(n)]


def as_stream(spark, rows, parts=2):
    """The rows as a file stream that arrives in ``parts`` micro-batches."""
    path = places(spark, 1)[0]
    rows.repartition(parts).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(run):
    run.awaitTermination()
    if run.exception() is not None:
        raise RuntimeError(str(run.exception()))


@query("n01_file_intake", "SELECT 'lineitem.parquet' AS name, CAST(count(*) > 0 AS INTEGER) AS n FROM lineitem")
def n01(spark, sf_dir):
    target, checkpoint, _ = places(spark)
    finished(jobs.file_intake(spark, sf_dir, "line*.parquet", target, checkpoint))
    finished(jobs.file_intake(spark, sf_dir, "line*.parquet", target, checkpoint))
    stored = spark.read.parquet(sf_dir + "/lineitem.parquet").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).distinct()
    return spark.read.parquet(target).groupBy("name").agg(F.count("*").cast("int").alias("n")).join(stored, "name")


@query("n02_receipts_once", """SELECT receipt_id FROM (SELECT DISTINCT 'recv-v1:' || sha256(encode(source) || unhex('00') || encode(sha256(text))) AS receipt_id FROM documents)""")
def n02(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.col("source").alias("source_id"), F.col("text").alias("raw_text"),
                                                    F.timestamp_seconds("doc_id").alias("received_at"))
    target, checkpoint, _ = places(spark)
    finished(jobs.receipts(as_stream(spark, d, 3), target, checkpoint))
    return spark.read.parquet(target).select("receipt_id")


@query("n03_frame_sessions", f"""WITH {SESSION_SQL} SELECT session_id, raw_text, n_frames, CASE WHEN kind IN (1, 3, 4, 5) THEN 'INCOMPLETE_TRANSMISSION' ELSE 'COMPLETE' END AS state FROM ses
UNION ALL SELECT session_id, raw_text, n_frames, 'COMPLETE' FROM ses WHERE kind = 0""")
def n03(spark, sf_dir):
    """Seven kinds of session; those of kind 0 send twice, those of kind 5 never end and run into the receive timeout at the next batch."""
    rows = wire_frames(spark, sf_dir).withColumn("issue", frames.frame_issue()).select(
        "session_id", "seq", F.lit("FRAME").alias("kind"), "frame_no", "text", "terminator", "checksum", "issue")
    number = F.substring("session_id", 2, 20).cast("long")
    again = rows.filter(number % 7 == 0).withColumn("seq", F.col("seq") + 100)
    ends = tb.table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 5").select(tb.text("s", F.col("o_orderkey")).alias("session_id"), F.lit(99).alias("seq"), F.lit("EOT").alias("kind"))
    late = ends.filter(F.substring("session_id", 2, 20).cast("long") % 7 == 0).withColumn("seq", F.col("seq") + 100)
    everything = rows.unionByName(again).unionByName(ends, allowMissingColumns=True).unionByName(late, allowMissingColumns=True)
    path, target, checkpoint = places(spark)
    everything.repartition(1).write.parquet(path)
    spark.read.parquet(path).limit(1).withColumns({"session_id": F.lit("clock"), "kind": F.lit("EOT")}).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers alone would keep the run from ending
    try:
        finished(jobs.frame_sessions(stream, 1).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", before)
    return spark.read.parquet(target)


@query("n04_retry_state", fold_sql(3) + """ SELECT delivery_id, CASE outcome WHEN 'DELIVERED' THEN 'DELIVERED' WHEN 'DMQ' THEN 'DMQ' WHEN 'RETRY' THEN 'RETRYING' ELSE 'PENDING' END AS state, attempts,
  outcome IS NOT DISTINCT FROM 'RETRY' AS scheduled FROM fin""")
def n04(spark, sf_dir):
    log_path, state_path, checkpoint = places(spark)
    finished(jobs.delivery_states(as_stream(spark, log(spark, sf_dir), 2), log_path, state_path, checkpoint, max_attempts=3))
    return jobs.current_states(spark, state_path).select("delivery_id", "state", "attempts", F.col("next_attempt_at").isNotNull().alias("scheduled"))


@query("n05_file_stability", """WITH o AS (SELECT event_id, user_id, ts, CAST(event_id % 2 AS INTEGER) AS size, date_trunc('day', ts) AS mtime FROM events),
 p AS (SELECT *, lag(size) OVER w AS psize, lag(mtime) OVER w AS pmtime FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT '/in/' || user_id AS path, CAST(count(*) AS BIGINT) AS n, CAST(count_if(coalesce(epoch_ms(ts) - epoch_ms(mtime) >= 3000 AND size = psize AND abs(epoch_ms(mtime) - epoch_ms(pmtime)) <= 1000, false)) AS BIGINT) AS n_stable FROM p GROUP BY 1""")
def n05(spark, sf_dir):
    e = tb.table(spark, sf_dir, "events").select(tb.text("/in/", F.col("user_id")).alias("path"), (F.col("event_id") % 2).alias("size"), F.date_trunc("day", "ts").alias("mtime"), F.col("ts").alias("observed_at"))
    target, checkpoint, _ = places(spark)
    settled = jobs.file_stability(as_stream(spark, e, 1), None)
    finished(settled.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return spark.read.parquet(target).groupBy("path").agg(F.count("*").alias("n"), F.count_if("stable").alias("n_stable"))


LATER_SQL = f"{NOW_SQL} + INTERVAL 30 DAY"
_DUE_AT = "state IN ('RECEIVED','PENDING','RETRYING') AND (next_attempt_at IS NULL OR next_attempt_at <= {now}) AND (lease_until IS NULL OR lease_until < {now})"


@query("n06_delivery_hand_off", f"""WITH {QUEUE_SQL}, a AS (SELECT *, {_DUE_AT.format(now=NOW_SQL)} AS first, {_DUE_AT.format(now=LATER_SQL)} AS later, event_id % 10 = 1 AS again FROM q)
SELECT delivery_id, 0 AS attempts, connection_id FROM a WHERE first OR (later AND NOT again)
UNION ALL SELECT delivery_id, 1, connection_id FROM a WHERE again AND {_DUE_AT.format(now=LATER_SQL)}""")
def n06(spark, sf_dir):
    """Two runs at two clock times: what was not due goes out with the second, and a tenth of the deliveries come back for another attempt."""
    waiting, target, checkpoint = places(spark)
    path = places(spark, 1)[0]
    rows = queue(spark, sf_dir).withColumn("attempts", F.lit(0))
    rows.unionByName(rows.filter("has_bundle")).repartition(2).write.parquet(path)

    def run(clock):
        stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
        finished(jobs.hand_off(stream, waiting, target, checkpoint, clock))

    run(now)
    number = F.substring("delivery_id", 2, 20).cast("long")
    rows.filter(number % 10 == 1).withColumn("attempts", F.lit(1)).repartition(1).write.mode("append").parquet(path)
    run(lambda: now() + F.expr("INTERVAL 30 DAY"))
    return spark.read.parquet(target).select("delivery_id", "attempts", "connection_id")


@query("n07_running_counters", """SELECT ['ASTM','HL7','CSV'][user_id % 3 + 1] AS protocol, ['TCP','MLLP'][event_id % 2 + 1] AS transport, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def n07(spark, sf_dir):
    from .reports_queries import routed

    target, checkpoint, _ = places(spark)
    finished(jobs.running_counters(as_stream(spark, routed(spark, sf_dir), 2), target, checkpoint))
    return jobs.newest(spark, target)


@query("n07_windowed_throughput", """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS window_start, ['ASTM','HL7','CSV'][user_id % 3 + 1] AS protocol, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def n07b(spark, sf_dir):
    from .reports_queries import routed

    rows = routed(spark, sf_dir).withColumn("transport", F.lit("any"))
    target, checkpoint, _ = places(spark)
    rates = jobs.windowed_throughput(as_stream(spark, rows, 1), "60 days")
    finished(rates.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(target)).start())
    return spark.read.parquet(target).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "protocol", F.round(F.col("per_second") * 60).cast("long").alias("n"))
