"""Delivery state: what each delivery's attempts and operator actions add up to.

Every rule is an aggregate or a chunked ordered pass (see ``ordered``), never a per-delivery collection, so a
delivery with very many attempts costs no single task more than its largest time chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.text import age_seconds, snippet
from . import ordered

# Defaults of the delivery retry policy and retention.
MAX_ATTEMPTS, BASE_MS, MULTIPLIER, MAX_MS, JITTER = 150, 5_000, 2.0, 600_000, 0.2
DISMISSED_DAYS = 90
STATES = ("RECEIVED", "PENDING", "RETRYING", "DELIVERED", "DMQ")
DISPATCHABLE = ("RECEIVED", "PENDING", "RETRYING")
INCOMPLETE = "INCOMPLETE_TRANSMISSION"
# Defaults: limits of one bulk retry.
MAX_BULK_IDS, MAX_BULK_ROWS = 500, 1000
# File retry policy.
FILE_BASE_MS, FILE_MAX_MS = 1_000, 600_000
FILE_QUIET_MS, FILE_DRIFT_MS = 3_000, 1_000


def disposition(status: Column) -> Column:
    """(action, reason) of one attempt; a NULL status means the receiver was not reached."""
    action = (
        F.when(status.isNull(), "RETRY")
        .when(status.between(200, 299), "DELIVERED")
        .when(status.isin(408, 429), "RETRY")
        .when(status.between(300, 499), "DMQ")
        .otherwise("RETRY")
    )
    reason = (
        F.when(status.between(300, 399), "UNEXPECTED_REDIRECT")
        .when(status == 422, "CONFIG_STATE")
        .when(status.between(400, 499) & ~status.isin(408, 429), "REJECTED")
    )
    return F.struct(action.alias("action"), reason.alias("reason"))


def backoff_ms(attempts: Column, key: Column | None = None, base: int = BASE_MS, multiplier: float = MULTIPLIER,
               most: int = MAX_MS, jitter: float = JITTER) -> Column:
    """Capped exponential delay; the jitter depends on the delivery and attempt, so a rerun gives the same."""
    exponent = F.greatest(F.lit(0), attempts - 1)
    capped = F.least(F.lit(float(base)) * F.pow(F.lit(max(multiplier, 1.0)), exponent), F.lit(float(most))).cast("long")
    if key is not None and jitter > 0:
        factor = F.lit(1.0) + (identity.unit_fraction(key, attempts) * 2 - 1) * jitter
        capped = (capped * factor).cast("long")
    return F.greatest(F.lit(1).cast("long"), capped)


def insert_absent(existing: DataFrame, rendered: DataFrame) -> DataFrame:
    """Rendered deliveries not yet known, one row each, as PENDING."""
    first = rendered.groupBy("delivery_id").agg(
        F.min(F.struct("received_at", *[c for c in rendered.columns if c not in ("delivery_id", "received_at")])).alias("r"))
    new = first.select("delivery_id", "r.*").join(existing.select("delivery_id"), "delivery_id", "left_anti")
    return new.withColumn("state", F.lit("PENDING"))


def carried_history(attempts: DataFrame, rendered: DataFrame) -> DataFrame:
    """The receipt's attempts re-keyed to each delivery it became."""
    links = rendered.select("receipt_id", "delivery_id").distinct()
    return attempts.withColumnRenamed("delivery_id", "receipt_id").join(links, "receipt_id").drop("receipt_id")


def due(deliveries: DataFrame, now: Column) -> DataFrame:
    """Dispatchable, next attempt due, lease free."""
    return deliveries.filter(
        F.col("state").isin(*DISPATCHABLE)
        & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
        & (F.col("lease_until").isNull() | (F.col("lease_until") < now))
    )


def next_due(deliveries: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """The oldest due entries (a top-k: each partition keeps ``limit`` rows before the final merge)."""
    return due(deliveries, now).orderBy(
        F.coalesce("next_attempt_at", "received_at"), "received_at", "delivery_id").limit(limit)


def without_results(deliveries: DataFrame, results: DataFrame) -> DataFrame:
    """Deliveries that hold no result, only flags: dead-lettered as PARSE_NO_RESULTS."""
    return deliveries.join(results.select("delivery_id").distinct(), "delivery_id", "left_anti").withColumn(
        "failure_reason", F.lit("PARSE_NO_RESULTS"))


def numbered_attempts(attempts: DataFrame, chunk: str = "day") -> DataFrame:
    """attempt_no per delivery by (started_at, attempt_id)."""
    return ordered.running_number(attempts, ["delivery_id"], F.date_trunc(chunk, "started_at"),
                                  ["started_at", "attempt_id"], "attempt_no")


def in_force(events: DataFrame, max_attempts: int = MAX_ATTEMPTS, chunk: str = "day") -> DataFrame:
    """Events with whether they took effect and what they did.

    Needs delivery_id, at, event_id, kind (ATTEMPT / RETRY / DISMISS) and status. A delivery is alive, or dead after
    a refusal until an operator retries it, or delivered for good. Before the attempt budget is spent only a refusal
    kills; from the event that spends it on, every failed attempt does, so the log is read twice with those two sets
    of deadly events and cut at that point. Adds ``outcome``: DELIVERED, DMQ, RETRY, REQUEUED or NULL (no effect),
    ``attempts`` (in force so far) and ``reason``.
    """
    keys, order = ["delivery_id"], ["at", "event_id"]
    bucket = F.date_trunc(chunk, F.col("at"))
    fate = disposition(F.col("status"))
    is_attempt, is_retry = F.col("kind") == "ATTEMPT", F.col("kind") == "RETRY"
    rows = events.withColumn("_action", F.when(is_attempt, fate["action"])).withColumn("_reason", F.when(is_attempt, fate["reason"]))

    def alive_before(frame: DataFrame, deadly: Column, name: str) -> DataFrame:
        turn = F.when(is_retry, True).when(is_attempt & deadly, False)
        return ordered.last_before(frame, keys, bucket, order, turn, name).withColumn(
            name, F.coalesce(name, F.lit(True)))

    rows = alive_before(rows, F.col("_action") == "DMQ", "_loose")
    counts = is_attempt & F.col("_loose")
    rows = ordered.running_sum(rows, keys, bucket, order, F.when(counts, 1).otherwise(0), "_n_loose")
    spent = rows.filter(counts & (F.col("_action") == "RETRY") & (F.col("_n_loose") >= max_attempts)).groupBy(*keys).agg(
        F.min(F.struct(*order)).alias("_spent"))
    rows = rows.join(spent, keys, "left")
    after = F.struct(*order) > F.col("_spent")
    at_point = F.struct(*order) == F.col("_spent")
    strict = F.coalesce(after | at_point, F.lit(False))
    rows = alive_before(
        rows, (F.col("_action") == "DMQ") | (strict & (F.col("_action") == "RETRY")), "_alive")
    delivered = rows.filter(is_attempt & F.col("_alive") & (F.col("_action") == "DELIVERED")).groupBy(*keys).agg(
        F.min(F.struct(*order)).alias("_done"))
    rows = rows.join(delivered, keys, "left")
    open_still = F.coalesce(F.struct(*order) <= F.col("_done"), F.lit(True))
    effective = is_attempt & F.col("_alive") & open_still
    rows = ordered.running_sum(rows, keys, bucket, order, F.when(effective, 1).otherwise(0), "attempts")
    exhausted = strict & (F.col("_action") == "RETRY")
    outcome = (
        F.when(effective & exhausted, "DMQ")
        .when(effective, F.col("_action"))
        .when(is_retry & open_still & F.coalesce(F.struct(*order) < F.col("_done"), F.lit(True)), "REQUEUED")
    )
    reason = F.when(effective & exhausted, "RETRY_EXHAUSTED").when(effective, F.col("_reason"))
    dead = F.col("kind").isin("DISMISS") & ~F.col("_alive") & open_still
    return rows.withColumn("outcome", F.when(dead, "DISMISSED").otherwise(outcome)).withColumn("reason", reason).drop(
        "_action", "_reason", "_loose", "_n_loose", "_spent", "_alive", "_done")


def states(events: DataFrame, max_attempts: int = MAX_ATTEMPTS, chunk: str = "day") -> DataFrame:
    """One row per delivery: state, attempts in force, last status, failure reason."""
    rows = in_force(events, max_attempts, chunk)
    when = F.struct("at", "event_id")
    last = F.when(F.col("outcome").isin("DELIVERED", "DMQ", "RETRY", "REQUEUED"), when)
    attempt = F.when(F.col("outcome").isin("DELIVERED", "DMQ", "RETRY"), when)
    folded = rows.groupBy("delivery_id").agg(
        F.max_by(F.struct("outcome", "reason"), last).alias("_last"),
        F.max_by("status", attempt).alias("last_http_status"),
        F.max(F.when(attempt.isNotNull(), F.col("attempts"))).alias("attempts"),
        F.max(F.when(attempt.isNotNull(), F.col("at"))).alias("last_attempt_at"),
        F.min("at").alias("received_at"),
        F.max(F.when(F.col("outcome") == "DISMISSED", F.col("at"))).alias("dismissed_at"),
    )
    outcome = F.col("_last.outcome")
    state = (
        F.when(outcome == "DELIVERED", "DELIVERED").when(outcome == "DMQ", "DMQ").when(outcome == "RETRY", "RETRYING")
        .otherwise("PENDING")
    )
    attempts = F.coalesce("attempts", F.lit(0)).cast("int")
    delay = backoff_ms(attempts, F.col("delivery_id"))
    return folded.select(
        "delivery_id", state.alias("state"), attempts.alias("attempts"), "last_http_status",
        F.when(state == "DMQ", F.col("_last.reason")).alias("failure_reason"), "received_at", "last_attempt_at",
        F.when(state == "RETRYING", F.timestamp_millis(F.unix_millis("last_attempt_at") + delay)).alias("next_attempt_at"),
        F.when(state == "DELIVERED", F.col("last_attempt_at")).alias("delivered_at"), "dismissed_at",
    )


def retry_requests(requests: DataFrame, deliveries: DataFrame, now: Column) -> DataFrame:
    """What an operator's retry does to each requested delivery."""
    rows = requests.join(deliveries, "delivery_id", "left")
    reason = (
        F.when(F.col("state").isNull(), "not_found")
        .when(F.col("failure_reason") == INCOMPLETE, "incomplete_transmission_request_analyzer_retransmission")
        .when(F.col("state") == "DELIVERED", "already_delivered")
        .when(F.col("lease_until") > now, "delivery_in_progress")
    )
    new_state = F.when(F.col("has_bundle"), "PENDING").otherwise("RECEIVED")
    return rows.select("delivery_id", F.when(reason.isNull(), new_state).otherwise(F.col("state")).alias("state"),
                       reason.isNull().alias("retried"), reason.alias("reason"))


def bulk_retry(deliveries: DataFrame, reason: str | None, connection: str | None, now: Column, most: int = MAX_BULK_ROWS) -> DataFrame:
    """Undismissed dead messages of a reason and connection as one request. The newest ``most`` that can be retried are;
    what cannot be takes no place of theirs. ``skipped`` counts those, ``remaining`` what a further request will reach."""
    rows = deliveries.filter("state = 'DMQ' AND dismissed_at IS NULL")
    if reason is not None:
        rows = rows.filter(F.col("failure_reason") == reason)
    if connection is not None:
        rows = rows.filter(F.col("connection_id") == connection)
    able = ~F.coalesce(F.col("failure_reason") == INCOMPLETE, F.lit(False)) & ~F.coalesce(F.col("lease_until") > now, F.lit(False))
    chosen = rows.filter(able).orderBy(F.desc("received_at"), "delivery_id").limit(most)
    taken = retry_requests(chosen.select("delivery_id"), deliveries, now).agg(F.count_if("retried").alias("retried"))
    matching = rows.agg(F.count_if(able).alias("_able"), F.count_if(~able).alias("skipped"))
    return matching.crossJoin(taken).select(
        (F.col("retried") + F.col("skipped")).alias("requested"), "retried", "skipped", (F.col("_able") - F.col("retried")).alias("remaining"))


def bulk_retry_ids(ids: list[str], deliveries: DataFrame, now: Column, most: int = MAX_BULK_IDS) -> DataFrame:
    """The outcome of each listed delivery, as K08 gives it. A longer list is refused as a whole."""
    if len(ids) > most:
        raise ValueError(f"{len(ids)} ids are more than the {most} of one request")
    requests = deliveries.sparkSession.createDataFrame([(i,) for i in ids], "delivery_id string")
    return retry_requests(requests, deliveries, now)


def dismissals(requests: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Only dead messages can be dismissed; the row stays."""
    rows = requests.join(deliveries.select("delivery_id", "state"), "delivery_id", "left")
    return rows.withColumn("dismissed", F.coalesce(F.col("state") == "DMQ", F.lit(False)))


def recovered(deliveries: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Leased rows of an interrupted run go back to the queue; each gets one attempt-log row."""
    held = deliveries.filter(F.col("state").isin(*DISPATCHABLE) & F.col("lease_until").isNotNull())
    state = F.when(F.col("state") == "RECEIVED", "RECEIVED").otherwise("PENDING")
    back = held.withColumn("state", state).withColumn("lease_until", F.lit(None).cast("timestamp")).withColumn(
        "next_attempt_at", F.lit(None).cast("timestamp"))
    log = held.select("delivery_id", F.lit("STARTUP_RECOVERY").alias("kind"), now.alias("started_at"),
                      now.alias("finished_at"), F.lit("INTERRUPTED").alias("outcome"))
    return back, log


def expired(deliveries: DataFrame, now: Column, delivered_days: int | None = None, dismissed_days: int = DISMISSED_DAYS) -> DataFrame:
    """Rows past their retention."""
    old = (F.col("state") == "DMQ") & (F.col("dismissed_at") < now - F.make_dt_interval(F.lit(dismissed_days)))
    if delivered_days is not None:
        old = old | ((F.col("state") == "DELIVERED") & (F.col("delivered_at") < now - F.make_dt_interval(F.lit(delivered_days))))
    return deliveries.filter(F.coalesce(old, F.lit(False)))


def orphans(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Payloads no remaining row refers to."""
    return raw.join(kept.select("raw_hash").distinct(), "raw_hash", "left_anti")


def file_states(events: DataFrame) -> DataFrame:
    """State per (analyzer, content) from its log.

    Needs analyzer_id, content_hash, path, at, event_id, kind (SEEN, RETRYING, ATTEMPT, PROCESSED, FAILED), error.
    """
    when = F.struct("at", "event_id")
    status = F.when(F.col("kind") == "RETRYING", "RETRYING").when(F.col("kind") == "PROCESSED", "PROCESSED").when(
        F.col("kind") == "FAILED", "FAILED_NEEDS_HANDLING")
    changed = F.when(status.isNotNull(), when)
    spoke = F.when(F.col("kind").isin("ATTEMPT", "FAILED", "PROCESSED"), when)
    error = F.when(F.col("kind") != "PROCESSED", F.col("error"))
    return events.groupBy("analyzer_id", "content_hash").agg(
        F.max_by(status, changed).alias("status"), F.max_by("path", when).alias("last_path"),
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
        F.count_if(F.col("kind") == "ATTEMPT").cast("int").alias("attempts"),
        F.max_by(error, spoke).alias("last_error"),
    ).filter("status IS NOT NULL")


def file_decision(files: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """What to do with each offered file."""
    rows = files.join(state.select("analyzer_id", "content_hash", "status", "next_attempt_at"),
                      ["analyzer_id", "content_hash"], "left")
    decision = (
        F.when(F.col("status") == "PROCESSED", "SKIP_PROCESSED")
        .when(F.col("status") == "FAILED_NEEDS_HANDLING", "SKIP_FAILED")
        .when((F.col("status") == "RETRYING") & (F.col("next_attempt_at") > now), "WAIT")
        .otherwise("PROCESS")
    )
    return rows.withColumn("decision", decision)


def file_backoff_ms(attempts: Column) -> Column:
    """K16."""
    return backoff_ms(attempts, base=FILE_BASE_MS, most=FILE_MAX_MS, jitter=0)


def stable_observations(observations: DataFrame, chunk: str = "hour") -> DataFrame:
    """Observations at which a file counts as settled: quiet for three seconds, and same size and (within one
    second) same modification time as when last noted. Needs path, size, mtime, observed_at."""
    noted = F.struct("size", "mtime")
    rows = ordered.last_before(observations, ["path"], F.date_trunc(chunk, "observed_at"), ["observed_at"], noted, "_before")
    quiet = F.unix_millis("observed_at") - F.unix_millis("mtime") >= FILE_QUIET_MS
    same = (F.col("_before.size") == F.col("size")) & (
        F.abs(F.unix_millis("mtime") - F.unix_millis("_before.mtime")) <= FILE_DRIFT_MS)
    return rows.withColumn("stable", F.coalesce(quiet & same, F.lit(False))).drop("_before")


def reset(state: DataFrame, analyzer: Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, count removed)."""
    return state.filter(F.col("analyzer_id") != analyzer), state.filter(F.col("analyzer_id") == analyzer).agg(
        F.count("*").alias("removed"))


def remote_receipt(body: Column) -> Column:
    """The receiver's receipt id, else its whole answer."""
    return F.coalesce(F.get_json_object(body, "$.receiptId"), body)


def rejections(bundles: DataFrame) -> DataFrame:
    """Rejection rows: content hash and the first 800 characters."""
    return bundles.select("rejection_id", "analyzer_id", F.sha2("bundle", 256).alias("bundle_hash"),
                          snippet(F.col("bundle")).alias("snippet"), "rejected_at", "dismissed")


def with_age(deliveries: DataFrame, now: Column) -> DataFrame:
    return deliveries.withColumn("age_seconds", age_seconds(F.col("received_at"), now))
