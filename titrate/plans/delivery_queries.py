"""Delivery-state queries (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery
from . import testbed as tb
from .registry import query

NOW_SECONDS = 1706745600  # 2024-02-01T00:00:00Z


def now():
    return F.timestamp_seconds(F.lit(NOW_SECONDS))


NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"
STATUS_SQL = "CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 503 WHEN 'purchase' THEN 422 WHEN 'signup' THEN 429 END"


def status_of(kind):
    return F.when(kind == "click", 200).when(kind == "view", 503).when(kind == "purchase", 422).when(kind == "signup", 429)


def attempts(spark, sf_dir):
    e = tb.table(spark, sf_dir, "events")
    return e.select(tb.text("d", F.col("user_id")).alias("delivery_id"), F.col("event_id").alias("attempt_id"),
                    F.col("ts").alias("started_at"), status_of(F.col("event_type")).alias("http_status"), "event_type")


def log(spark, sf_dir):
    """Attempts with operator actions among them: signups whose id divides by three are retries, every error whose id
    divides by seven is a dismissal."""
    e = tb.table(spark, sf_dir, "events")
    kind = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0), "RETRY").when(
        (F.col("event_type") == "error") & (F.col("event_id") % 7 == 0), "DISMISS").otherwise("ATTEMPT")
    return e.select(tb.text("d", F.col("user_id")).alias("delivery_id"), F.col("ts").alias("at"), "event_id", kind.alias("kind"),
                    F.when(kind == "ATTEMPT", F.when((F.col("event_type") == "click") & (F.col("event_id") % 5 > 0), 408)
                           .otherwise(status_of(F.col("event_type")))).alias("status"))


# The same log folded row by row with a recursive query: state A(live), D(ead), X(delivered).
LOG_SQL = f"""log AS (SELECT 'd' || user_id AS delivery_id, ts AS tm, event_id,
    CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'RETRY'
         WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'DISMISS' ELSE 'ATTEMPT' END AS kind,
    CASE WHEN event_type = 'click' AND event_id % 5 > 0 THEN 408 ELSE {STATUS_SQL} END AS status FROM events),
  num AS (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY tm, event_id) AS rn,
    CASE WHEN kind <> 'ATTEMPT' THEN kind WHEN status = 200 THEN 'S' WHEN status = 422 THEN 'T' ELSE 'R' END AS ev FROM log),
  fold AS (
    SELECT delivery_id, 0::BIGINT AS rn, 'A' AS st, 0 AS n, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reason,
      NULL::INTEGER AS status, NULL::TIMESTAMP AS last_at, NULL::VARCHAR AS ev_outcome
    FROM (SELECT DISTINCT delivery_id FROM num)
    UNION ALL
    SELECT f.delivery_id, m.rn,
      CASE WHEN f.st = 'X' THEN 'X' WHEN m.ev = 'RETRY' THEN 'A' WHEN f.st = 'D' OR m.ev = 'DISMISS' THEN f.st
           WHEN m.ev = 'S' THEN 'X' WHEN m.ev = 'T' THEN 'D' WHEN f.n + 1 >= {{most}} THEN 'D' ELSE 'A' END,
      CASE WHEN f.st = 'A' AND m.ev IN ('S', 'T', 'R') THEN f.n + 1 ELSE f.n END,
      CASE WHEN f.st = 'X' OR m.ev = 'DISMISS' THEN f.outcome WHEN m.ev = 'RETRY' THEN 'REQUEUED' WHEN f.st = 'D' THEN f.outcome
           WHEN m.ev = 'S' THEN 'DELIVERED' WHEN m.ev = 'T' OR f.n + 1 >= {{most}} THEN 'DMQ' ELSE 'RETRY' END,
      CASE WHEN f.st <> 'A' AND m.ev <> 'RETRY' OR m.ev = 'DISMISS' OR f.st = 'X' THEN f.reason WHEN m.ev = 'T' THEN 'CONFIG_STATE'
           WHEN m.ev = 'R' AND f.n + 1 >= {{most}} THEN 'RETRY_EXHAUSTED' END,
      CASE WHEN f.st = 'A' AND m.ev IN ('S', 'T', 'R') THEN m.status ELSE f.status END,
      CASE WHEN f.st = 'A' AND m.ev IN ('S', 'T', 'R') THEN m.tm ELSE f.last_at END,
      CASE WHEN m.ev = 'DISMISS' THEN CASE WHEN f.st = 'D' THEN 'DISMISSED' END WHEN f.st = 'X' THEN NULL
           WHEN m.ev = 'RETRY' THEN 'REQUEUED' WHEN f.st = 'D' THEN NULL WHEN m.ev = 'S' THEN 'DELIVERED'
           WHEN m.ev = 'T' OR f.n + 1 >= {{most}} THEN 'DMQ' ELSE 'RETRY' END
    FROM fold f JOIN num m ON m.delivery_id = f.delivery_id AND m.rn = f.rn + 1)"""
FINAL_SQL = """fin AS (SELECT delivery_id, arg_max(st, rn) AS st, CAST(arg_max(n, rn) AS INTEGER) AS attempts,
  (array_agg(outcome ORDER BY rn DESC))[1] AS outcome, (array_agg(reason ORDER BY rn DESC))[1] AS reason,
  (array_agg(status ORDER BY rn DESC))[1] AS last_http_status FROM fold GROUP BY 1)"""


def fold_sql(most):
    return "WITH RECURSIVE " + LOG_SQL.format(most=most) + ", " + FINAL_SQL


def rendered(spark, sf_dir):
    li = tb.table(spark, sf_dir, "lineitem")
    return li.select(tb.text("v", F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("delivery_id"),
                     tb.text("r", F.col("l_orderkey")).alias("receipt_id"), F.col("l_shipdate").alias("received_at"),
                     tb.text("S", F.col("l_partkey")).alias("accession"))


@query("k01_insert_absent", """WITH r AS (SELECT 'v' || l_orderkey || '-' || l_linenumber AS delivery_id, 'r' || l_orderkey AS receipt_id,
   l_shipdate AS received_at, 'S' || l_partkey AS accession, l_orderkey, l_linenumber FROM lineitem)
SELECT delivery_id, receipt_id, accession, 'PENDING' AS state FROM (
  SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY received_at, receipt_id, accession) AS rn FROM r
  WHERE NOT (l_orderkey % 3 = 0 AND l_linenumber = 1)) WHERE rn = 1""")
def k01(spark, sf_dir):
    known = tb.table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(tb.text("v", F.col("o_orderkey"), "-1").alias("delivery_id"))
    return delivery.insert_absent(known, rendered(spark, sf_dir)).select("delivery_id", "receipt_id", "accession", "state")


@query("k01_history_carried", """SELECT delivery_id, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT DISTINCT 'v' || l_orderkey || '-' || l_linenumber AS delivery_id, l_orderkey FROM lineitem) v
JOIN events e ON e.user_id = v.l_orderkey GROUP BY 1""")
def k01b(spark, sf_dir):
    history = attempts(spark, sf_dir).withColumn("delivery_id", F.concat(F.lit("r"), F.substring("delivery_id", 2, 20)))
    return delivery.carried_history(history, rendered(spark, sf_dir)).groupBy("delivery_id").agg(F.count("*").alias("n"))


def queue(spark, sf_dir):
    """A queue derived from the events: one row per event."""
    e = tb.table(spark, sf_dir, "events")
    state = F.element_at(F.array(*map(F.lit, delivery.STATES)), (F.col("event_id") % 5 + 1).cast("int"))
    soon = F.timestamp_seconds(F.unix_seconds("ts") + F.col("user_id") * 3600)
    return e.select(
        tb.text("q", F.col("event_id")).alias("delivery_id"), state.alias("state"), F.col("ts").alias("received_at"),
        F.when(F.col("event_id") % 3 == 0, soon).alias("next_attempt_at"),
        F.when(F.col("event_id") % 4 == 0, soon).alias("lease_until"),
        tb.text("c", F.col("user_id") % 7).alias("connection_id"),
        F.when(state == "DMQ", F.element_at(F.array(*map(F.lit, ("REJECTED", "CONFIG_STATE", delivery.INCOMPLETE))),
                                            (F.col("user_id") % 3 + 1).cast("int"))).alias("failure_reason"),
        F.when((state == "DMQ") & (F.col("event_id") % 2 == 0), F.col("ts")).alias("dismissed_at"),
        F.when(state == "DELIVERED", F.col("ts")).alias("delivered_at"), (F.col("event_id") % 2 == 0).alias("has_bundle"),
        F.col("event_type").alias("raw_hash"), F.lit("ASTM").alias("protocol"))


QUEUE_SQL = """q AS (SELECT 'q' || event_id AS delivery_id, event_id, user_id, event_type,
  ['RECEIVED','PENDING','RETRYING','DELIVERED','DMQ'][event_id % 5 + 1] AS state, ts AS received_at,
  CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) + to_hours(user_id) END AS next_attempt_at,
  CASE WHEN event_id % 4 = 0 THEN date_trunc('second', ts) + to_hours(user_id) END AS lease_until,
  'c' || (user_id % 7) AS connection_id,
  CASE WHEN event_id % 5 = 4 THEN ['REJECTED','CONFIG_STATE','INCOMPLETE_TRANSMISSION'][user_id % 3 + 1] END AS failure_reason,
  CASE WHEN event_id % 5 = 4 AND event_id % 2 = 0 THEN ts END AS dismissed_at,
  CASE WHEN event_id % 5 = 3 THEN ts END AS delivered_at, event_id % 2 = 0 AS has_bundle FROM events)"""
DUE_SQL = f"state IN ('RECEIVED','PENDING','RETRYING') AND (next_attempt_at IS NULL OR next_attempt_at <= {NOW_SQL}) AND (lease_until IS NULL OR lease_until < {NOW_SQL})"


@query("k02_due_work", f"""WITH {QUEUE_SQL} SELECT delivery_id, state FROM q WHERE {DUE_SQL}
ORDER BY coalesce(next_attempt_at, received_at), received_at, delivery_id LIMIT 200""")
def k02(spark, sf_dir):
    return delivery.next_due(queue(spark, sf_dir), now(), 200).select("delivery_id", "state")


@query("k03_result_gate", f"""WITH {QUEUE_SQL} SELECT delivery_id, 'PARSE_NO_RESULTS' AS failure_reason FROM q
WHERE event_id NOT IN (SELECT l_orderkey FROM lineitem)""")
def k03(spark, sf_dir):
    held = tb.table(spark, sf_dir, "lineitem").select(tb.text("q", F.col("l_orderkey")).alias("delivery_id"))
    return delivery.without_results(queue(spark, sf_dir), held).select("delivery_id", "failure_reason")


@query("k04_outcome_class", """SELECT status, CASE WHEN status IS NULL THEN 'RETRY' WHEN status BETWEEN 200 AND 299 THEN 'DELIVERED'
  WHEN status IN (408, 429) THEN 'RETRY' WHEN status BETWEEN 300 AND 499 THEN 'DMQ' ELSE 'RETRY' END AS action,
  CASE WHEN status BETWEEN 300 AND 399 THEN 'UNEXPECTED_REDIRECT' WHEN status = 422 THEN 'CONFIG_STATE'
    WHEN status BETWEEN 400 AND 499 AND status NOT IN (408, 429) THEN 'REJECTED' END AS reason, CAST(count(*) AS BIGINT) AS n
FROM (SELECT CASE WHEN event_id % 50 > 0 THEN CAST(200 + event_id % 400 AS INTEGER) END AS status FROM events) GROUP BY 1""")
def k04(spark, sf_dir):
    status = F.when(F.col("event_id") % 50 > 0, (F.lit(200) + F.col("event_id") % 400).cast("int"))
    rows = tb.table(spark, sf_dir, "events").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return rows.select("status", delivery.disposition(F.col("status")).alias("d"), "n").select("status", "d.action", "d.reason", "n")


@query("k05_backoff", """SELECT attempts, CAST(greatest(1, least(5000 * pow(2.0, greatest(0, attempts - 1)), 600000)) AS BIGINT) AS delay_ms,
  true AS jitter_in_range, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(event_id % 150 AS INTEGER) AS attempts FROM events) GROUP BY 1""")
def k05(spark, sf_dir):
    e = tb.table(spark, sf_dir, "events").select((F.col("event_id") % 150).cast("int").alias("attempts"), tb.text("d", F.col("event_id")).alias("id"))
    plain, jittered = delivery.backoff_ms(F.col("attempts"), jitter=0), delivery.backoff_ms(F.col("attempts"), F.col("id"))
    ok = jittered.between((plain * 0.8).cast("long") - 1, (plain * 1.2).cast("long") + 1)
    return e.groupBy("attempts").agg(F.max(plain).alias("delay_ms"), F.bool_and(ok).alias("jitter_in_range"), F.count("*").alias("n"))


@query("k06_retry_budget", fold_sql(3) + """ SELECT delivery_id, CASE outcome WHEN 'DELIVERED' THEN 'DELIVERED' WHEN 'DMQ' THEN 'DMQ'
  WHEN 'RETRY' THEN 'RETRYING' ELSE 'PENDING' END AS state, CASE WHEN outcome = 'DMQ' THEN reason END AS failure_reason, attempts FROM fin""")
def k06(spark, sf_dir):
    return delivery.states(log(spark, sf_dir), max_attempts=3).select("delivery_id", "state", "failure_reason", "attempts")


@query("k07_state_fold", fold_sql(150) + """ SELECT delivery_id, CASE outcome WHEN 'DELIVERED' THEN 'DELIVERED' WHEN 'DMQ' THEN 'DMQ'
  WHEN 'RETRY' THEN 'RETRYING' ELSE 'PENDING' END AS state, CASE WHEN outcome = 'DMQ' THEN reason END AS failure_reason, attempts,
  last_http_status FROM fin""")
def k07(spark, sf_dir):
    return delivery.states(log(spark, sf_dir)).select("delivery_id", "state", "failure_reason", "attempts", "last_http_status")


@query("k07_event_outcomes", "WITH RECURSIVE " + LOG_SQL.format(most=5) + """ SELECT f.delivery_id, m.event_id, f.ev_outcome AS outcome,
  CAST(f.n AS BIGINT) AS attempts FROM fold f JOIN num m USING (delivery_id, rn)""")
def k07b(spark, sf_dir):
    return delivery.in_force(log(spark, sf_dir), max_attempts=5).select("delivery_id", "event_id", "outcome", "attempts")


def retry_targets(spark, sf_dir):
    return tb.table(spark, sf_dir, "orders").select(tb.text("q", F.col("o_orderkey")).alias("delivery_id"))


RETRY_SQL = f"""rr AS (SELECT 'q' || o_orderkey AS delivery_id, CASE WHEN q.state IS NULL THEN 'not_found'
  WHEN failure_reason = 'INCOMPLETE_TRANSMISSION' THEN 'incomplete_transmission_request_analyzer_retransmission'
  WHEN q.state = 'DELIVERED' THEN 'already_delivered' WHEN lease_until > {NOW_SQL} THEN 'delivery_in_progress' END AS reason,
  q.state, has_bundle FROM orders LEFT JOIN q ON q.event_id = o_orderkey)"""


@query("k08_operator_retry", f"""WITH {QUEUE_SQL}, {RETRY_SQL} SELECT delivery_id, reason, reason IS NULL AS retried,
  CASE WHEN reason IS NULL THEN CASE WHEN has_bundle THEN 'PENDING' ELSE 'RECEIVED' END ELSE state END AS state FROM rr""")
def k08(spark, sf_dir):
    return delivery.retry_requests(retry_targets(spark, sf_dir), queue(spark, sf_dir), now())


@query("k09_bulk_retry", f"""WITH {QUEUE_SQL}, c AS (SELECT *, coalesce(lease_until > {NOW_SQL}, false) AS busy FROM q WHERE state = 'DMQ' AND dismissed_at IS NULL
  AND failure_reason = 'CONFIG_STATE' ORDER BY received_at DESC, delivery_id LIMIT 1000)
SELECT CAST(count(*) AS BIGINT) AS requested, CAST(count_if(NOT busy) AS BIGINT) AS retried, CAST(count_if(busy) AS BIGINT) AS skipped FROM c""")
def k09(spark, sf_dir):
    return delivery.bulk_retry(queue(spark, sf_dir), "CONFIG_STATE", None, now()).drop("remaining")


@query("k10_dismiss", f"""WITH {QUEUE_SQL} SELECT 'q' || o_orderkey AS delivery_id, coalesce(q.state = 'DMQ', false) AS dismissed
FROM orders LEFT JOIN q ON q.event_id = o_orderkey""")
def k10(spark, sf_dir):
    return delivery.dismissals(retry_targets(spark, sf_dir), queue(spark, sf_dir)).select("delivery_id", "dismissed")


@query("k11_interrupted_recovery", f"""WITH {QUEUE_SQL} SELECT delivery_id, CASE WHEN state = 'RECEIVED' THEN 'RECEIVED' ELSE 'PENDING' END AS state,
  'STARTUP_RECOVERY' AS kind, 'INTERRUPTED' AS outcome FROM q WHERE state IN ('RECEIVED','PENDING','RETRYING') AND lease_until IS NOT NULL""")
def k11(spark, sf_dir):
    back, entries = delivery.recovered(queue(spark, sf_dir), now())
    return back.select("delivery_id", "state").join(entries.select("delivery_id", "kind", "outcome"), "delivery_id")


EXPIRED_SQL = f"""((state = 'DMQ' AND dismissed_at < {NOW_SQL} - INTERVAL 10 DAY) OR (state = 'DELIVERED' AND delivered_at < {NOW_SQL} - INTERVAL 20 DAY))"""


@query("k12_retention_purge", f"WITH {QUEUE_SQL} SELECT state, CAST(count(*) AS BIGINT) AS n FROM q WHERE {EXPIRED_SQL} GROUP BY 1")
def k12(spark, sf_dir):
    return delivery.expired(queue(spark, sf_dir), now(), 20, 10).groupBy("state").agg(F.count("*").alias("n"))


@query("k12_orphan_payloads", """SELECT raw_hash FROM (SELECT DISTINCT sha256(text) AS raw_hash, text FROM documents) WHERE raw_hash NOT IN (
  SELECT sha256(text) FROM documents WHERE doc_id % 3 > 0)""")
def k12b(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").withColumn("raw_hash", F.sha2("text", 256))
    return delivery.orphans(d.select("raw_hash").distinct(), d.filter("doc_id % 3 > 0")).select("raw_hash")


@query("k13_attempt_numbers", """SELECT event_id AS attempt_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt_no FROM events""")
def k13(spark, sf_dir):
    return delivery.numbered_attempts(attempts(spark, sf_dir)).select("attempt_id", "attempt_no")


def file_log(spark, sf_dir):
    e = tb.table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"click": "PROCESSED", "view": "SEEN", "purchase": "FAILED", "signup": "RETRYING",
                                                            "error": "ATTEMPT"}.items() for x in kv]), F.col("event_type"))
    return e.select(tb.text("an", F.col("user_id") % 5).alias("analyzer_id"), tb.text("h", F.col("user_id")).alias("content_hash"),
                    tb.text("/in/", F.col("event_id")).alias("path"), F.col("ts").alias("at"), "event_id", kind.alias("kind"),
                    tb.text("e", F.col("event_id")).alias("error"))


FILE_SQL = """fs AS (SELECT 'an' || (user_id % 5) AS analyzer_id, 'h' || user_id AS content_hash,
  arg_max(CASE event_type WHEN 'click' THEN 'PROCESSED' WHEN 'purchase' THEN 'FAILED_NEEDS_HANDLING' ELSE 'RETRYING' END, (ts, event_id))
    FILTER (event_type IN ('click', 'purchase', 'signup')) AS status, arg_max('/in/' || event_id, (ts, event_id)) AS last_path,
  min(ts) AS first_seen, max(ts) AS last_seen, CAST(count_if(event_type = 'error') AS INTEGER) AS attempts,
  (array_agg(CASE WHEN event_type <> 'click' THEN 'e' || event_id END ORDER BY ts DESC, event_id DESC) FILTER (event_type IN ('error', 'purchase', 'click')))[1]
    AS last_error FROM events GROUP BY user_id)"""


@query("k14_file_state", f"WITH {FILE_SQL} SELECT * FROM fs WHERE status IS NOT NULL")
def k14(spark, sf_dir):
    return delivery.file_states(file_log(spark, sf_dir))


def file_state(spark, sf_dir):
    hours = F.substring("content_hash", 2, 20).cast("int")
    return delivery.file_states(file_log(spark, sf_dir)).withColumn(
        "next_attempt_at", F.timestamp_seconds(F.unix_seconds("last_seen") + hours * 3600))


@query("k15_file_decision", f"""WITH {FILE_SQL}, o AS (SELECT o_orderkey, 'an' || (o_custkey % 5) AS analyzer_id, 'h' || o_custkey AS content_hash FROM orders)
SELECT decision, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN status = 'PROCESSED' THEN 'SKIP_PROCESSED'
  WHEN status = 'FAILED_NEEDS_HANDLING' THEN 'SKIP_FAILED' WHEN status = 'RETRYING' AND
    date_trunc('second', last_seen) + to_hours(CAST(substr(content_hash, 2) AS INTEGER)) > {NOW_SQL} THEN 'WAIT' ELSE 'PROCESS' END AS decision
  FROM o LEFT JOIN fs USING (analyzer_id, content_hash)) GROUP BY 1""")
def k15(spark, sf_dir):
    o = tb.table(spark, sf_dir, "orders").select(tb.text("an", F.col("o_custkey") % 5).alias("analyzer_id"), tb.text("h", F.col("o_custkey")).alias("content_hash"))
    return delivery.file_decision(o, file_state(spark, sf_dir), now()).groupBy("decision").agg(F.count("*").alias("n"))


@query("k16_file_backoff", """SELECT attempts, CAST(least(1000 * pow(2.0, greatest(0, attempts - 1)), 600000) AS BIGINT) AS delay_ms FROM (
  SELECT DISTINCT CAST(event_id % 40 AS INTEGER) AS attempts FROM events)""")
def k16(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "events").select((F.col("event_id") % 40).cast("int").alias("attempts")).distinct()
    return rows.select("attempts", delivery.file_backoff_ms(F.col("attempts")).alias("delay_ms"))


@query("k17_file_stability", """WITH o AS (SELECT event_id, user_id, ts, CAST(event_id % 2 AS INTEGER) AS size,
   date_trunc('day', ts) AS mtime FROM events),
 p AS (SELECT *, lag(size) OVER w AS psize, lag(mtime) OVER w AS pmtime FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, coalesce(epoch_ms(ts) - epoch_ms(mtime) >= 3000 AND size = psize AND abs(epoch_ms(mtime) - epoch_ms(pmtime)) <= 1000, false) AS stable FROM p""")
def k17(spark, sf_dir):
    e = tb.table(spark, sf_dir, "events").select(
        "event_id", tb.text("/in/", F.col("user_id")).alias("path"), (F.col("event_id") % 2).cast("int").alias("size"),
        F.date_trunc("day", "ts").alias("mtime"), F.col("ts").alias("observed_at"))
    return delivery.stable_observations(e).select("event_id", "stable")


@query("k18_state_reset", f"WITH {FILE_SQL} SELECT CAST(count(*) AS BIGINT) AS removed FROM fs WHERE status IS NOT NULL AND analyzer_id = 'an2'")
def k18(spark, sf_dir):
    return delivery.reset(delivery.file_states(file_log(spark, sf_dir)), F.lit("an2"))[1]


@query("k19_remote_receipt", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'rcpt' || event_id WHEN event_id % 3 = 1 THEN props ELSE 'OK' END AS receipt FROM events""")
def k19(spark, sf_dir):
    body = F.when(F.col("event_id") % 3 == 0, tb.text('{"receiptId": "rcpt', F.col("event_id"), '"}')).when(
        F.col("event_id") % 3 == 1, F.col("props")).otherwise("OK")
    return tb.table(spark, sf_dir, "events").select("event_id", delivery.remote_receipt(body).alias("receipt"))


@query("k20_rejection_log", """SELECT doc_id AS rejection_id, sha256(text) AS bundle_hash, substr(text, 1, 800) AS snippet FROM documents WHERE doc_id % 2 = 0""")
def k20(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rejection_id"), F.col("source").alias("analyzer_id"), F.col("text").alias("bundle"),
                                                    F.timestamp_seconds("doc_id").alias("rejected_at"), (F.col("doc_id") % 2 == 1).alias("dismissed"))
    return delivery.rejections(d).filter(~F.col("dismissed")).select("rejection_id", "bundle_hash", "snippet")
