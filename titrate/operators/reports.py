"""Reports: counts, listings and rates over the delivery tables and the message log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import age_seconds, error_text
from .delivery import DISPATCHABLE, STATES
from .intake import astm_sender, hl7_sender

MAX_PAGE = 1000


def counts_by_state(deliveries: DataFrame) -> DataFrame:
    """One row per state, zero where there is none (one conditional count per state in one pass)."""
    wide = deliveries.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in STATES])).alias("r")).select("r.*")


def oldest_undelivered(deliveries: DataFrame, now: Column) -> DataFrame:
    """L02."""
    return deliveries.filter(F.col("state").isin(*DISPATCHABLE)).agg(F.min("received_at").alias("oldest")).select(
        "oldest", age_seconds(F.col("oldest"), now).alias("age_seconds"))


def queue_stats(deliveries: DataFrame, now: Column) -> DataFrame:
    """Undelivered, dead-lettered, delivered, age of the oldest undelivered, verdict."""
    waiting = F.col("state").isin(*DISPATCHABLE)
    out = deliveries.agg(
        F.count_if(waiting).alias("undelivered"), F.count_if(F.col("state") == "DMQ").alias("dead_lettered"),
        F.count_if(F.col("state") == "DELIVERED").alias("delivered"), F.min(F.when(waiting, F.col("received_at"))).alias("_oldest"))
    return out.withColumn("oldest_age_seconds", age_seconds(F.col("_oldest"), now)).drop("_oldest")


def queue_health(deliveries: DataFrame, now: Column, recovered_from_corruption: bool = False, readable: bool = True) -> DataFrame:
    """Verdict with detail."""
    verdict = "UP" if readable and not recovered_from_corruption else "DOWN"
    return queue_stats(deliveries, now).withColumn("status", F.lit(verdict))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0, most: int = MAX_PAGE) -> DataFrame:
    """A bounded page of an ordered listing: each partition keeps limit + offset rows before the merge. Larger pages are refused."""
    if limit > most:
        raise ValueError(f"a page of {limit} rows is larger than {most}")
    return rows.orderBy(*order).offset(offset).limit(limit)


def listing(deliveries: DataFrame, state: str | None = None, connection: str | None = None, reason: str | None = None,
            include_dismissed: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first."""
    rows = deliveries
    for column, value in (("state", state), ("connection_id", connection), ("failure_reason", reason)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if not include_dismissed:
        rows = rows.filter("dismissed_at IS NULL")
    return page(rows, [F.desc("received_at"), "delivery_id"], limit, offset)


def attempt_history(attempts: DataFrame, delivery_id: str) -> DataFrame:
    """The attempts of one delivery in order (the filter reaches the scan)."""
    return attempts.filter(F.col("delivery_id") == delivery_id).orderBy("started_at", "attempt_id")


def raw_payloads(deliveries: DataFrame, raw: DataFrame) -> DataFrame:
    """Payload of each delivery."""
    return deliveries.select("delivery_id", "raw_hash").join(raw.select("raw_hash", "raw_text"), "raw_hash")


def summaries(deliveries: DataFrame, raw: DataFrame, now: Column) -> DataFrame:
    """Summary rows: sender from the hint, or read from the payload for serial and HTTP input, and age.

    Only rows that need their payload are joined to it.
    """
    parsed = F.col("transport").isin("SERIAL", "HTTP")
    texts = raw.select("raw_hash", "raw_text")
    with_text = deliveries.filter(parsed).join(texts, "raw_hash", "left")
    sender = F.when(F.col("protocol") == "ASTM", astm_sender(F.col("raw_text"))).when(F.col("protocol") == "HL7", hl7_sender(F.col("raw_text")))
    read = with_text.withColumn("sender", sender).drop("raw_text")
    hinted = deliveries.filter(~parsed).withColumn("sender", F.col("sender_hint"))
    rows = hinted.unionByName(read.select(*hinted.columns))
    return rows.withColumn("age_seconds", age_seconds(F.col("received_at"), now)).withColumn("last_error", error_text(F.col("last_error")))


def file_listing(state: DataFrame, status: str, limit: int, offset: int = 0) -> DataFrame:
    """Last seen first."""
    return page(state.filter(F.col("status") == status), [F.desc("last_seen"), "analyzer_id", "content_hash"], limit, offset)


def active_rejections(rejections: DataFrame, limit: int) -> DataFrame:
    """Newest first."""
    return page(rejections.filter("NOT dismissed"), [F.desc("rejected_at"), "rejection_id"], limit)


def received_counter(messages: DataFrame) -> DataFrame:
    """L10."""
    return messages.groupBy("protocol", "transport").agg(F.count("*").alias("n"))


def routed_counter(messages: DataFrame) -> DataFrame:
    """L11."""
    return messages.groupBy("protocol", "transport", "success").agg(F.count("*").alias("n"))


def routing_duration(messages: DataFrame) -> DataFrame:
    """Needs ``seconds``."""
    return messages.groupBy("protocol", "transport").agg(F.count("seconds").alias("n"), F.sum("seconds").alias("total"), F.max("seconds").alias("longest"))


def identity_counter(outcomes: DataFrame) -> DataFrame:
    """Needs ``reason`` (attribution) and ``corroboration``."""
    mode = F.coalesce(
        F.when(F.col("reason") == "AMBIGUOUS_SOURCE", "ambiguous_source").when(F.col("reason") == "CONNECTION_TRANSPORT_MISMATCH", "transport_mismatch")
        .when(F.col("reason").isNotNull(), "unregistered_source"), F.col("corroboration"))
    return outcomes.filter(mode.isNotNull()).groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


def refused_by_port(peers: DataFrame) -> DataFrame:
    """Needs ``admitted``."""
    return peers.filter(~F.col("admitted")).groupBy("listener_port").agg(F.count("*").alias("n"))


def throughput(messages: DataFrame, slide: str | None = None) -> DataFrame:
    """Messages per second over one-minute windows."""
    window = F.window("received_at", "1 minute", slide) if slide else F.window("received_at", "1 minute")
    return messages.groupBy(window.alias("w"), "protocol", "transport").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "protocol", "transport", (F.col("n") / 60).alias("per_second"))


def success_rate(messages: DataFrame) -> DataFrame:
    """Share of routed messages that succeeded, over five-minute windows."""
    return messages.groupBy(F.window("received_at", "5 minutes").alias("w")).agg(
        (F.count_if("success") / F.count("*")).alias("rate"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "rate", "n")


def latency_p95(messages: DataFrame, exact: bool = False) -> DataFrame:
    """95th percentile of routing seconds by protocol over five-minute windows (a mergeable estimate by default;
    ``exact`` keeps every distinct value of a window)."""
    p = F.percentile("seconds", F.lit(0.95)) if exact else F.percentile_approx("seconds", 0.95, 10_000)
    return messages.groupBy(F.window("received_at", "5 minutes").alias("w"), "protocol").agg(p.alias("p95")).select(
        F.col("w.start").alias("window_start"), "protocol", "p95")


def profile_summaries(profiles: DataFrame) -> DataFrame:
    """Latest revision of each profile with protocol and name."""
    rows = profiles.select("profile_id", "revision", "display_name", F.get_json_object("body", "$.protocol.name").alias("protocol"))
    return rows.groupBy("profile_id").agg(F.max_by(F.struct("revision", "display_name", "protocol"), "revision").alias("p")).select("profile_id", "p.*")


def recognition_summary(parsed: DataFrame) -> DataFrame:
    """How each profile recognizes controls: mode, basis and the ordered conditions.

    ``basis`` is none (affirmed: no controls), any_condition or unset; a condition is (rule_type, target_field, operand), the operand of a
    pattern left out. Wording is the reader's.
    """
    r = F.col("doc.controlResultRecognition")
    rules = F.map_entries(r["rules"])

    def condition(e: Column) -> Column:
        v = e["value"]
        secret = v["ruleType"] == "SPECIMEN_ID_PATTERN"
        return F.struct(v["ruleType"].alias("rule_type"), v["targetField"].alias("target_field"), F.when(~secret, v["operand"]).alias("operand"))

    none = r["mode"] == "NONE"
    basis = F.when(none, "none").when(F.size(rules) > 0, "any_condition").otherwise("unset")
    empty = F.array().cast("array<struct<rule_type:string,target_field:string,operand:string>>")
    return parsed.select("profile_id", "revision", r["mode"].alias("mode"), basis.alias("basis"),
                         F.when(none, empty).otherwise(F.transform(rules, condition)).alias("conditions"))


def exclusive_directories(claims: DataFrame) -> DataFrame:
    """Directories whose every claim belongs to one analyzer, with its patterns; others with why they are refused.

    ``claims``: directory, analyzer_id, pattern (saved and active FILE connections, union). The claims of a directory
    are reduced to distinct (analyzer, pattern) pairs before they are listed.
    """
    pairs = claims.select("directory", "analyzer_id", F.trim("pattern").alias("pattern")).distinct()
    owners = pairs.groupBy("directory").agg(
        F.min("analyzer_id").alias("analyzer_id"), (F.min("analyzer_id") != F.max("analyzer_id")).alias("_shared"),
        F.max(F.coalesce("pattern", F.lit("")) == "").alias("_open"))
    reason = F.when(F.col("_shared"), "shared").when(F.col("_open"), "no_pattern")
    owners = owners.withColumn("reason", reason)
    listed = pairs.join(owners.filter("reason IS NULL").select("directory"), "directory", "left_semi").groupBy("directory").agg(
        F.sort_array(F.collect_set("pattern")).alias("patterns"))
    return owners.join(listed, "directory", "left").select("directory", F.when(F.col("reason").isNull(), F.col("analyzer_id")).alias("analyzer_id"), "patterns", "reason")
