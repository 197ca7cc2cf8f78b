"""Report queries (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connections as ops
from ..operators import reports
from . import testbed as tb
from .attribution_queries import LADDER_SQL, connections, traffic
from .delivery_queries import FILE_SQL, NOW_SQL, QUEUE_SQL, attempts, file_log, now, queue
from .dimensions_queries import MISSING, PART, parsed, small_documents, with_missing
from .registry import query


def routed(spark, sf_dir):
    e = tb.table(spark, sf_dir, "events")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    return e.select("event_id", pick(("ASTM", "HL7", "CSV"), F.col("user_id")).alias("protocol"), pick(("TCP", "MLLP"), F.col("event_id")).alias("transport"),
                    (F.col("event_type") != "error").alias("success"), F.col("ts").alias("received_at"), F.col("value").cast("decimal(18,2)").alias("seconds"))


ROUTED = """r AS (SELECT event_id, ['ASTM','HL7','CSV'][user_id % 3 + 1] AS protocol, ['TCP','MLLP'][event_id % 2 + 1] AS transport, event_type <> 'error' AS success, ts,
  CAST(value AS DECIMAL(18,2)) AS seconds FROM events)"""


@query("l01_counts_by_state", f"""WITH {QUEUE_SQL} SELECT s.state, CAST(count(q.state) AS BIGINT) AS n FROM (VALUES ('RECEIVED'), ('PENDING'), ('RETRYING'), ('DELIVERED'), ('DMQ')) s(state)
LEFT JOIN q USING (state) GROUP BY 1""")
def l01(spark, sf_dir):
    return reports.counts_by_state(queue(spark, sf_dir))


@query("l02_oldest_undelivered", f"""WITH {QUEUE_SQL} SELECT strftime(min(received_at), '%Y-%m-%d %H:%M:%S') AS oldest, CAST(epoch({NOW_SQL}) - floor(epoch(min(received_at))) AS BIGINT) AS age_seconds
FROM q WHERE state IN ('RECEIVED', 'PENDING', 'RETRYING')""")
def l02(spark, sf_dir):
    return reports.oldest_undelivered(queue(spark, sf_dir), now()).select(F.date_format("oldest", "yyyy-MM-dd HH:mm:ss").alias("oldest"), "age_seconds")


STATS = f"""CAST(count_if(state IN ('RECEIVED', 'PENDING', 'RETRYING')) AS BIGINT) AS undelivered, CAST(count_if(state = 'DMQ') AS BIGINT) AS dead_lettered, CAST(count_if(state = 'DELIVERED') AS BIGINT) AS delivered,
  CAST(epoch({NOW_SQL}) - floor(epoch(min(received_at) FILTER (state IN ('RECEIVED', 'PENDING', 'RETRYING')))) AS BIGINT) AS oldest_age_seconds"""


@query("l03_queue_stats", f"WITH {QUEUE_SQL} SELECT {STATS} FROM q")
def l03(spark, sf_dir):
    return reports.queue_stats(queue(spark, sf_dir), now())


@query("l04_delivery_listing", f"""WITH {QUEUE_SQL} SELECT delivery_id, state, failure_reason FROM q WHERE state = 'DMQ' AND connection_id = 'c3' AND dismissed_at IS NULL
ORDER BY received_at DESC, delivery_id LIMIT 50 OFFSET 10""")
def l04(spark, sf_dir):
    return reports.listing(queue(spark, sf_dir), state="DMQ", connection="c3", limit=50, offset=10).select("delivery_id", "state", "failure_reason")


@query("l05_attempt_history", """SELECT event_id AS attempt_id, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 503 WHEN 'purchase' THEN 422 WHEN 'signup' THEN 429 END AS http_status
FROM events WHERE user_id = 8""")
def l05(spark, sf_dir):
    return reports.attempt_history(attempts(spark, sf_dir), "d8").select("attempt_id", "http_status")


@query("l06_raw_payload", "SELECT 'd' || doc_id AS delivery_id, length(text)::INTEGER AS n_chars FROM documents")
def l06(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").withColumn("raw_hash", F.sha2("text", 256))
    raw = d.groupBy("raw_hash").agg(F.first("text").alias("raw_text"))
    return reports.raw_payloads(d.select(tb.text("d", F.col("doc_id")).alias("delivery_id"), "raw_hash"), raw).select("delivery_id", F.length("raw_text").alias("n_chars"))


@query("l07_delivery_summary", f"""SELECT 'M' || o_orderkey AS delivery_id, CASE WHEN o_orderkey % 3 = 0 THEN 'hint' || o_orderkey ELSE 'APP' || (o_custkey % 25) END AS sender,
  CAST(greatest(0, epoch({NOW_SQL}) - epoch(o_orderdate)) AS BIGINT) AS age_seconds, 1000 AS error_chars FROM orders""")
def l07(spark, sf_dir):
    key = F.substring("message_id", 2, 20).cast("long")
    m = tb.hl7_messages(spark, sf_dir).withColumn("raw_hash", F.sha2("raw_text", 256))
    deliveries = m.select(F.col("message_id").alias("delivery_id"), "raw_hash", "protocol", F.when(key % 3 == 0, "MLLP").when(key % 3 == 1, "SERIAL").otherwise("HTTP").alias("transport"),
                          tb.text("hint", key).alias("sender_hint"), "received_at", F.repeat(F.lit("e"), 1200).alias("last_error"))
    return reports.summaries(deliveries, m, now()).select("delivery_id", "sender", "age_seconds", F.length("last_error").alias("error_chars"))


@query("l08_file_state_listing", f"WITH {FILE_SQL} SELECT analyzer_id, content_hash, last_path FROM fs WHERE status = 'PROCESSED' ORDER BY last_seen DESC, analyzer_id, content_hash LIMIT 20 OFFSET 5")
def l08(spark, sf_dir):
    from ..operators import delivery

    return reports.file_listing(delivery.file_states(file_log(spark, sf_dir)), "PROCESSED", 20, 5).select("analyzer_id", "content_hash", "last_path")


@query("l09_active_rejections", "SELECT doc_id AS rejection_id FROM documents WHERE doc_id % 2 = 0 ORDER BY doc_id % 100 DESC, doc_id LIMIT 100")
def l09(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rejection_id"), F.timestamp_seconds(F.col("doc_id") % 100).alias("rejected_at"), (F.col("doc_id") % 2 == 1).alias("dismissed"))
    return reports.active_rejections(d, 100).select("rejection_id")


@query("l10_received_counter", f"WITH {ROUTED} SELECT protocol, transport, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2")
def l10(spark, sf_dir):
    return reports.received_counter(routed(spark, sf_dir))


@query("l11_routed_counter", f"WITH {ROUTED} SELECT protocol, transport, success, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2, 3")
def l11(spark, sf_dir):
    return reports.routed_counter(routed(spark, sf_dir))


@query("l12_routing_duration", f"""WITH {ROUTED} SELECT protocol, transport, CAST(count(*) AS BIGINT) AS n, CAST(sum(seconds) AS VARCHAR) AS total, CAST(max(seconds) AS VARCHAR) AS longest FROM r GROUP BY 1, 2""")
def l12(spark, sf_dir):
    return reports.routing_duration(routed(spark, sf_dir)).withColumns({"total": F.col("total").cast("string"), "longest": F.col("longest").cast("string")})


@query("l13_identity_outcomes", f"""WITH {LADDER_SQL} SELECT mode, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE reason WHEN 'AMBIGUOUS_SOURCE' THEN 'ambiguous_source' WHEN 'UNREGISTERED_SOURCE' THEN 'unregistered_source' ELSE
  CASE WHEN snd IS NULL THEN NULL WHEN coalesce(regexp_matches(snd, '(?i)' || c.pat), false) THEN 'corroborated' ELSE 'mismatch' END END AS mode
  FROM out JOIN msg USING (message_id) LEFT JOIN con c ON c.id = out.connection_id) WHERE mode IS NOT NULL GROUP BY 1""")
def l13(spark, sf_dir):
    from ..operators import attribution

    rows = attribution.on_listener(traffic(spark, sf_dir), connections(spark, sf_dir))
    rows = rows.join(connections(spark, sf_dir).select("connection_id", "identifier_pattern"), "connection_id", "left")
    return reports.identity_counter(rows.withColumn("corroboration", attribution.corroboration(F.col("sender_hint"), F.col("identifier_pattern"))))


@query("l14_refused_by_port", """SELECT CAST(2000 + o_custkey % 5 AS BIGINT) AS listener_port, CAST(count(*) AS BIGINT) AS n FROM orders WHERE NOT (o_custkey % 7 < 3 OR (o_custkey % 7 = 5 AND o_custkey % 256 BETWEEN 4 AND 9)) GROUP BY 1""")
def l14(spark, sf_dir):
    from ..operators import intake
    from .intake_queries import nation_ranges, peers

    return reports.refused_by_port(intake.admitted(peers(spark, sf_dir), intake.allowed_ranges(nation_ranges(spark, sf_dir))))


@query("l15_queue_health", f"WITH {QUEUE_SQL} SELECT {STATS}, 'UP' AS status FROM q")
def l15(spark, sf_dir):
    return reports.queue_health(queue(spark, sf_dir), now())


@query("l16_profile_summaries", """SELECT 'p' || (p_partkey % 500) AS profile_id, CAST(max(p_partkey // 500) + 1 AS INTEGER) AS revision, CAST(NULL AS VARCHAR) AS protocol FROM part GROUP BY 1""")
def l16(spark, sf_dir):
    return reports.profile_summaries(small_documents(spark, sf_dir)).drop("display_name")


@query("l17_readiness", f"""WITH {MISSING} SELECT connection_id, concat_ws(',', CASE WHEN k % 10 = 7 THEN 'runtime-restore-failed' END, CASE WHEN missing <> '' THEN 'missing-required-values' END) AS blockers,
  k % 10 <> 7 AND missing = '' AS ready FROM miss""")
def l17(spark, sf_dir):
    number = F.substring("connection_id", 2, 20).cast("long")
    rows = with_missing(spark, sf_dir).withColumn("profile_found", F.lit(True)).withColumn("restore_failure", F.when(number % 10 == 7, "port busy"))
    return ops.readiness(rows).select("connection_id", F.array_join("blockers", ",").alias("blockers"), "ready")


@query("l18_recognition_summary", f"""WITH {PART} SELECT profile_id, CASE WHEN k % 5 <= 1 THEN 'NONE' ELSE 'RULES' END AS mode,
  CASE WHEN k % 5 <= 1 THEN 'none' ELSE 'any_condition' END AS basis,
  CASE WHEN k % 5 <= 1 THEN '' ELSE 'SPECIMEN_ID_PATTERN; FIELD_EQUALS O.12 Q' END AS conditions FROM p""")
def l18(spark, sf_dir):
    return reports.recognition_summary(parsed(spark, sf_dir)).select(
        "profile_id", "mode", "basis",
        F.array_join(F.transform("conditions", lambda c: F.concat_ws(" ", c["rule_type"], c["target_field"], c["operand"])), "; ").alias("conditions"))


@query("l19_exclusive_directories", """WITH c AS (SELECT '/in/' || (s_suppkey // 2) AS directory, 'an' || CASE WHEN s_suppkey % 6 < 4 THEN s_suppkey // 2 ELSE s_suppkey END AS analyzer_id,
  CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE '*.' || (s_suppkey % 3) END AS pattern FROM supplier)
SELECT directory, CASE WHEN count(DISTINCT analyzer_id) = 1 AND min(pattern) <> '' THEN min(analyzer_id) END AS analyzer_id,
  CASE WHEN count(DISTINCT analyzer_id) = 1 AND min(pattern) <> '' THEN string_agg(DISTINCT pattern, ',' ORDER BY pattern) END AS patterns,
  CASE WHEN count(DISTINCT analyzer_id) > 1 THEN 'shared' WHEN min(pattern) = '' THEN 'no_pattern' END AS reason FROM c GROUP BY 1""")
def l19(spark, sf_dir):
    k = F.col("s_suppkey")
    half = F.floor(k / 2)
    claims = tb.table(spark, sf_dir, "supplier").select(
        tb.text("/in/", half).alias("directory"), F.when(k % 6 < 4, tb.text("an", half)).otherwise(tb.text("an", k)).alias("analyzer_id"),
        F.when(k % 10 == 0, " ").otherwise(tb.text("*.", k % 3)).alias("pattern"))
    return reports.exclusive_directories(claims).withColumn("patterns", F.array_join("patterns", ","))


@query("l20_throughput", f"""WITH {ROUTED} SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS window_start, protocol, transport, CAST(round(count(*) * 1000 / 60.0) AS BIGINT) AS milli_per_second FROM r GROUP BY 1, 2, 3""")
def l20(spark, sf_dir):
    return reports.throughput(routed(spark, sf_dir)).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "protocol", "transport",
                                                            F.round(F.col("per_second") * 1000).cast("long").alias("milli_per_second"))


_FIVE = "strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M')"


@query("l21_success_rate", f"WITH {ROUTED} SELECT {_FIVE} AS window_start, CAST(count(*) AS BIGINT) AS n, CAST(round(count_if(success) * 10000.0 / count(*)) AS BIGINT) AS per_10000 FROM r GROUP BY 1")
def l21(spark, sf_dir):
    return reports.success_rate(routed(spark, sf_dir)).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n", F.round(F.col("rate") * 10000).cast("long").alias("per_10000"))


@query("l22_latency_p95", f"WITH {ROUTED} SELECT {_FIVE} AS window_start, protocol, CAST(round(quantile_cont(CAST(seconds AS DOUBLE), 0.95) * 100000) AS BIGINT) AS p95_scaled FROM r GROUP BY 1, 2")
def l22(spark, sf_dir):
    return reports.latency_p95(routed(spark, sf_dir).withColumn("seconds", F.col("seconds").cast("double")), exact=True).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "protocol", F.round(F.col("p95") * 100000).cast("long").alias("p95_scaled"))
