"""Intake: what a message is, whether it is acceptable, and its content-derived receipt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.net import canonical_ip
from ..functions.text import blank_to_null, clip, filled, let

PROTOCOLS = ("ASTM", "HL7", "CSV", "UNKNOWN")
TRANSPORTS = ("TCP", "MLLP", "SERIAL", "FILE", "HTTP")
MAX_MESSAGE_CHARS = 16 * 1024 * 1024


def protocol_of(raw: Column) -> Column:
    """By the first characters of the clipped text, else four or more comma columns in its first line."""

    def detect(t: Column) -> Column:
        columns = F.split(F.regexp_replace(F.substring_index(t, "\n", 1), ",+\\z", ""), ",")
        return (
            F.when(t.startswith("H|\\^&"), "ASTM")
            .when(t.startswith("MSH|"), "HL7")
            .when(t.contains(",") & (F.size(columns) > 3), "CSV")
            .otherwise("UNKNOWN")
        )

    return F.coalesce(let(clip(raw), detect), F.lit("UNKNOWN"))


def protocol_by_type(content_type: Column, raw: Column) -> Column:
    """Declared content type without its parameters, content as the fallback."""

    def named(ct: Column) -> Column:
        return (
            F.when(ct.contains("hl7"), "HL7")
            .when(ct.isin("text/csv", "application/csv", "text/tab-separated-values"), "CSV")
            .when(ct.contains("astm"), "ASTM")
        )

    lowered = clip(F.lower(content_type))
    bare = clip(F.when(F.instr(lowered, ";") > 1, F.substring_index(lowered, ";", 1)).otherwise(lowered))
    return F.coalesce(let(bare, named), protocol_of(raw))


def rejection(protocol: Column, transport: Column, source: Column, raw: Column) -> Column:
    """Why an envelope is refused; NULL when it is acceptable."""
    return (
        F.when(~F.coalesce(protocol.isin(*PROTOCOLS), F.lit(False)), "protocol")
        .when(~F.coalesce(transport.isin(*TRANSPORTS), F.lit(False)), "transport")
        .when(~filled(source), "source")
        .when(~filled(raw), "text")
        .when(F.length(raw) > MAX_MESSAGE_CHARS, "size")
    )


def with_receipt(messages: DataFrame) -> DataFrame:
    """raw_hash and receipt_id of source_id and raw_text."""
    return messages.withColumn("raw_hash", identity.content_hash(F.col("raw_text"))).withColumn(
        "receipt_id", identity.receipt_id(F.col("source_id"), F.col("raw_hash"))
    )


def first_receipts(received: DataFrame) -> DataFrame:
    """The kept row of each receipt (first by time, then message id) and how often it was sent.

    The first row is chosen by an aggregate, which combines copies before the shuffle: a text that makes up a third
    of the input arrives as one partial row per input partition. Only ids take part, not the texts.
    """
    order = F.struct("received_at", "message_id")
    return received.groupBy("receipt_id").agg(
        F.min(order).alias("_first"), F.count("*").alias("n_received"), F.max("received_at").alias("last_received")
    ).select("receipt_id", F.col("_first.message_id").alias("message_id"),
             F.col("_first.received_at").alias("first_received"), "last_received", "n_received")


def already_present(received: DataFrame) -> DataFrame:
    """Every message with whether its receipt existed before. Joined on the message, not on the hot receipt."""
    kept = first_receipts(received).select("message_id", F.lit(False).alias("_later"))
    return received.join(kept, "message_id", "left").withColumn(
        "already_present", F.coalesce("_later", F.lit(True))
    ).drop("_later")


def raw_store(received: DataFrame) -> DataFrame:
    """One payload row per hash. Texts with one hash are equal, so any copy serves and one travels."""
    return received.groupBy("raw_hash").agg(
        F.first("raw_text").alias("raw_text"), F.min("received_at").alias("first_received"),
        F.count("*").alias("n_received"),
    )


def encoded_payload(content: Column) -> Column:
    """(encoding, payload): text where the bytes are valid UTF-8, base64 otherwise."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.struct(
        F.when(utf8, "UTF8").otherwise("BASE64").alias("encoding"),
        F.when(utf8, content.cast("string")).otherwise(F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))).alias("payload"),
    )


def decoded_payload(encoding: Column, payload: Column) -> Column:
    """B08."""
    return F.when(encoding == "UTF8", F.encode(payload, "UTF-8")).otherwise(
        F.try_to_binary(F.when(encoding == "BASE64", payload), F.lit("base64"))
    )


def file_receipts(files: DataFrame) -> DataFrame:
    """One receipt per (connection, content); the same bytes under another interpretation conflict.

    Needs connection_id, raw_hash, interpretation_hash, path, received_at.
    """
    order = F.struct("received_at", "path", "interpretation_hash")
    out = files.groupBy("connection_id", "raw_hash").agg(
        F.min(order).alias("_first"),
        (F.min("interpretation_hash") != F.max("interpretation_hash")).alias("conflict"),
        F.count("*").alias("n_seen"),
    )
    return out.select(
        identity.file_receipt_id(F.col("connection_id"), F.col("raw_hash")).alias("receipt_id"), "connection_id",
        "raw_hash", F.col("_first.path").alias("path"), F.col("_first.interpretation_hash").alias("interpretation_hash"),
        "conflict", "n_seen",
    )


def interpretation_hash(context: dict[str, Column], purpose: Column) -> Column:
    """Hash of the receipt-time context: source path left out, purpose left out when ROUTINE, keys sorted."""
    kept = {k: v for k, v in context.items() if k != "sourcePath"}
    kept["purpose"] = F.when(purpose != "ROUTINE", purpose)
    return F.sha2(F.to_json(F.struct(*[kept[k].alias(k) for k in sorted(kept)])), 256)


def is_query_only(raw: Column) -> Column:
    """An ASTM message with a Q record and no R record, under the delimiter its header declares."""
    header = F.regexp_replace(raw, r"\A\p{javaWhitespace}+", "")
    delimiter = F.when(header.startswith("H") & (F.length(header) > 1), F.substring(header, 2, 1)).otherwise("|")

    def has(letter: str) -> Column:
        return F.exists(
            F.split(raw, "\r"),
            lambda l: (F.substring(clip(l), 1, 1) == letter) & (F.substring(clip(l), 2, 1) == delimiter),
        )

    return filled(raw) & has("Q") & ~has("R")


def astm_sender(raw: Column) -> Column:
    """Field 5 of the first H record, under its own delimiter."""

    def of_header(h: Column) -> Column:
        cells = F.split(h, F.concat(F.lit("\\Q"), F.substring(h, 2, 1), F.lit("\\E")))
        return blank_to_null(clip(F.get(cells, F.lit(4))))

    headers = F.filter(F.split(raw, r"[\r\n]+"), lambda l: clip(l).startswith("H") & (F.length(clip(l)) > 1))
    return let(clip(F.get(headers, F.lit(0))), of_header)


def hl7_sender(raw: Column) -> Column:
    """MSH-3 with its component separator written as a caret."""

    def of_header(h: Column) -> Column:
        cells = F.split(h, F.concat(F.lit("\\Q"), F.substring(h, 4, 1), F.lit("\\E")))
        swapped = F.replace(F.get(cells, F.lit(2)), F.substring(h, 5, 1), F.lit("^"))
        return F.when(h.startswith("MSH") & (F.length(h) >= 8), blank_to_null(swapped))

    return let(F.get(F.split(F.regexp_replace(raw, r"\A\p{javaWhitespace}+", ""), "[\r\n]", 2), F.lit(0)), of_header)


def sender_token(token: Column) -> Column:
    """(site, model, version); a token without carets is the model."""

    def of_pieces(p: Column) -> Column:
        many = F.size(p) > 1
        at = lambda i: blank_to_null(clip(F.get(p, F.lit(i))))
        return F.struct(
            F.when(many, at(0)).alias("site"), F.when(many, at(1)).otherwise(at(0)).alias("model"),
            F.when(many, at(2)).alias("version"),
        )

    return F.when(filled(token), let(F.split(token, r"\^"), of_pieces))


def first_component(hint: Column) -> Column:
    """B16."""
    return F.when(hint.isNotNull(), blank_to_null(clip(F.substring_index(hint, "^", 1))))


def allowed_ranges(entries: DataFrame) -> DataFrame:
    """Address ranges of the listed entries; NULL bounds for an entry that is neither address nor range."""
    from ..functions.net import cidr_range

    return entries.select("entry", F.explode_outer(F.array(cidr_range(F.col("entry")))).alias("r")).select(
        "entry", "r.family", "r.low", "r.high", "r.bits")


def range_keys(ranges: DataFrame) -> DataFrame:
    """Ranges as (family, bits, prefix) keys, so that membership is an equi join."""
    return ranges.filter("low IS NOT NULL").select(
        "family", "bits", F.substring("low", F.lit(1), F.col("bits")).alias("prefix")).distinct()


def admitted(connections: DataFrame, ranges: DataFrame) -> DataFrame:
    """Which peers lie in an allowed range. Each address is looked up under every prefix length in use by its
    family (33 at most for IPv4, 129 for IPv6), which keeps the join an equi join however many ranges there are."""
    from ..functions.net import address_bits

    keys = range_keys(ranges)
    # An IPv6 peer may carry a scope such as %2, which no range has.
    literal = canonical_ip(F.regexp_replace("peer", "%.*", ""))
    lengths = keys.select("family", "bits").distinct()
    peers = connections.select("peer").distinct().select("peer", literal.alias("_ip")).withColumn("_b", address_bits(F.col("_ip")))
    sized = peers.filter("_b IS NOT NULL").withColumn("family", F.when(F.length("_b") == 32, 4).otherwise(6))
    probes = sized.join(F.broadcast(lengths), "family").select("peer", "family", "bits", F.substring("_b", F.lit(1), F.col("bits")).alias("prefix"))
    inside = probes.join(keys, ["family", "bits", "prefix"], "left_semi").select("peer").distinct()
    return connections.join(inside.withColumn("_in", F.lit(True)), "peer", "left").withColumn(
        "admitted", F.coalesce("_in", F.lit(False))).drop("_in")


def known_hosts(peers: DataFrame, connections: DataFrame, admitted_side: bool = True) -> DataFrame:
    """Peers that are (or are not) the host of an active connection on that listener."""
    hosts = connections.filter("inbound_address IS NOT NULL").select(
        "listener_port", F.col("inbound_address").alias("address")).distinct()
    keyed = peers.withColumn("address", canonical_ip(F.col("peer")))
    return keyed.join(hosts, ["listener_port", "address"], "left_semi" if admitted_side else "left_anti")


def http_senders(requests: DataFrame, connections: DataFrame) -> DataFrame:
    """Requests whose address is an active HTTP connection's source."""
    sources = connections.filter("inbound_transport = 'HTTP'").select(
        canonical_ip(F.col("inbound_source")).alias("address")).filter("address IS NOT NULL").distinct()
    return requests.withColumn("address", canonical_ip(F.col("source_id"))).join(sources, "address", "left_semi")


def client_address(remote: Column, forwarded: Column, real_ip: Column, trusted: Column) -> Column:
    """Walk the forwarded chain from its end while the peer is a trusted proxy (``trusted`` is an array)."""

    def walk(peer: Column) -> Column:
        state = F.struct(peer.alias("peer"), F.lit(False).alias("bad"))

        def step(acc: Column, hop: Column) -> Column:
            active = F.array_contains(trusted, acc["peer"]) & ~acc["bad"]
            return F.when(
                active, let(canonical_ip(hop), lambda ip: F.struct(
                    F.coalesce(ip, acc["peer"]).alias("peer"), ip.isNull().alias("bad")))
            ).otherwise(acc)

        end = F.aggregate(F.reverse(F.split(forwarded, ",")), state, step)
        chained = let(end, lambda e: F.when(e["bad"], peer).otherwise(e["peer"]))
        return F.when(~F.coalesce(F.array_contains(trusted, peer), F.lit(False)), F.coalesce(peer, F.lit("unknown"))).when(
            filled(forwarded), chained
        ).otherwise(F.coalesce(canonical_ip(real_ip), peer, F.lit("unknown")))

    return let(canonical_ip(remote), walk)


def client_port(remote: Column, remote_port: Column, forwarded: Column, real_ip: Column, forwarded_port: Column, trusted: Column) -> Column:
    """The forwarded port only when proxied; ports outside 1..65535 give NULL."""
    any_header = filled(forwarded) | filled(real_ip) | filled(forwarded_port)
    proxied = F.coalesce(F.array_contains(trusted, canonical_ip(remote)), F.lit(False)) & any_header
    declared = clip(forwarded_port).try_cast("int")
    chosen = F.when(proxied, declared).otherwise(remote_port)
    return F.when(chosen.between(1, 65535), chosen)


def message_text(content: Column) -> Column:
    """The whole message as UTF-8 when valid, else ISO-8859-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1"))
