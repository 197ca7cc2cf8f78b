"""Outbound orders: checks, code lookup, endpoint and message text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled

# The ports used when neither connection nor profile names one.
DEFAULT_PORTS = {"ASTM": 12001, "HL7": 2575}
TCP = ("TCP/IP", "MLLP")


def orders_enabled(outbound: Column, lis_initiated: Column, data_flow: Column) -> Column:
    two_way = data_flow.isNull() | (data_flow == "TWO_WAY")
    return F.coalesce(outbound, F.lit(False)) & F.coalesce(lis_initiated, F.lit(False)) & two_way


def endpoint(c: dict[str, Column]) -> Column:
    """(orders_enabled, needed, port, source, error) of a connection.

    ``c`` maps protocol, transport, connection_role, outbound_capability, lis_initiated, data_flow, port_mode,
    outbound_port, port, transport_port, profile_role and profile_port to columns (ports are INT or NULL).
    """
    enabled = orders_enabled(c["outbound_capability"], c["lis_initiated"], c["data_flow"])
    client = F.coalesce(c["connection_role"] == "CLIENT", F.lit(False))
    needed = c["protocol"].isin("ASTM", "HL7") & c["transport"].isin(*TCP) & (client | enabled)
    own = F.coalesce(c["port_mode"] != "DEFAULT", F.lit(True))
    profile_client = F.coalesce(c["profile_role"] == "CLIENT", F.lit(False))
    fallback = F.when(c["protocol"] == "ASTM", DEFAULT_PORTS["ASTM"]).when(c["protocol"] == "HL7", DEFAULT_PORTS["HL7"])
    connection = F.when(own, F.coalesce(c["outbound_port"], F.when(client, c["port"])))
    profile = F.coalesce(c["transport_port"], F.when(profile_client, c["profile_port"]))
    port = F.coalesce(connection, profile, fallback)
    source = (
        F.when(connection.isNotNull(), "Connection override").when(profile.isNotNull(), "Profile default")
        .otherwise("Deployment default")
    )
    bad_mode = ~F.coalesce(c["port_mode"].isin("", "DEFAULT", "OVERRIDE"), F.lit(True))
    error = F.when(bad_mode, "port_mode").when(~port.between(1, 65535), "port_range")
    return F.struct(
        enabled.alias("orders_enabled"), needed.alias("needed"), F.when(needed & error.isNull(), port).alias("port"),
        F.when(needed & error.isNull(), source).alias("source"), F.when(needed, error).alias("error"),
    )


def request_reason(requests: DataFrame) -> Column:
    """Why an order is not dispatched; NULL when it can be.

    Over requests joined to their connection and codes: connection_id, accession, loinc_codes, connected (BOOLEAN),
    host, port, codes (ARRAY), orders_enabled, protocol.
    """
    c = F.col
    return (
        F.when(~filled(c("connection_id")), "connection_required")
        .when(~filled(c("accession")), "accession_required")
        .when(F.coalesce(F.size("loinc_codes"), F.lit(0)) <= 0, "codes_required")
        .when(~F.coalesce(c("connected"), F.lit(False)), "no_active_connection")
        .when(~filled(c("host")) | ~F.coalesce(c("port").between(1, 65535), F.lit(False)), "no_endpoint")
        .when(F.coalesce(F.size("codes"), F.lit(0)) <= 0, "no_code_resolved")
        .when(~(F.coalesce(c("orders_enabled"), F.lit(False)) & c("protocol").rlike("(?i)\\A(HL7|ASTM)")), "orders_not_supported")
    )


def mapped_codes(requests: DataFrame, order_codes: DataFrame) -> DataFrame:
    """Requested LOINC codes -> instrument codes in request order, unmapped ones kept apart.

    An order's codes are one bounded array, so they are regrouped per order after the lookup. ``order_codes`` holds
    (connection_id, loinc, instrument_code); ``requests`` needs order_id.
    """
    asked = requests.select("order_id", "connection_id", F.posexplode("loinc_codes").alias("pos", "loinc"))
    found = asked.join(order_codes, ["connection_id", "loinc"], "left")
    entry = F.struct("pos", "loinc", "instrument_code")
    listed = found.groupBy("order_id").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    return requests.join(listed, "order_id", "left").select(
        *requests.columns,
        F.transform(F.filter("_l", lambda e: e["instrument_code"].isNotNull()), lambda e: e["instrument_code"]).alias("codes"),
        F.transform(F.filter("_l", lambda e: e["instrument_code"].isNull()), lambda e: e["loinc"]).alias("unmapped"),
    )


def _numbered(codes: Column, line) -> Column:
    kept = F.filter(codes, filled)
    return F.array_join(F.transform(kept, lambda c, i: line(c, (i + 1).cast("string"))), "")


def astm_order(accession: Column, patient: Column, codes: Column, sender: str = "LIS^Order^1.0") -> Column:
    """H, P, one O per non-blank code, L."""
    body = _numbered(codes, lambda c, n: F.concat(F.lit("O|"), n, F.lit("|"), accession, F.lit("||^^^"), c, F.lit("|R\r")))
    return F.concat(F.lit(f"H|\\^&|||{sender}|||||||LIS2-A2\rP|1|||"), F.coalesce(patient, F.lit("")), F.lit("\r"), body,
                    F.lit("L|1|N\r"))


def hl7_order(accession: Column, patient: Column, codes: Column, at: Column, sender: str = "LIS|LAB", control: str = "LIS") -> Column:
    """MSH, PID, one ORC and OBR per non-blank code. ``at`` is the message time."""
    stamp = F.date_format(at, "yyyyMMddHHmmss")
    body = _numbered(codes, lambda c, n: F.concat(
        F.lit("ORC|NW|"), accession, F.lit("|"), accession, F.lit("\rOBR|"), n, F.lit("|"), accession, F.lit("|"), accession,
        F.lit("|^^^"), c, F.lit("^"), c, F.lit("\r")))
    return F.concat(F.lit(f"MSH|^~\\&|{sender}|ANALYZER|LAB|"), stamp, F.lit(f"||ORM^O01|{control}"), stamp, F.lit("|P|2.3.1\rPID|1||"),
                    F.coalesce(patient, F.lit("")), F.lit("^^^HOSP\r"), body)
