"""Outbound order queries (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orders
from . import testbed as tb
from .registry import query


def requests(spark, sf_dir):
    o = tb.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    codes = F.array(tb.text("L", key % 4), tb.text("L", (key + 1) % 4), F.lit("L9"))
    return o.select(
        tb.text("o", key).alias("order_id"), F.when(key % 13 != 0, tb.text("c", F.col("o_custkey") % 30)).otherwise(" ").alias("connection_id"),
        F.when(key % 17 != 0, tb.text("S", key)).alias("accession"), F.when(key % 3 > 0, tb.text("P", F.col("o_custkey"))).alias("patient_id"),
        F.when(key % 19 != 0, F.when(key % 23 == 0, F.array(F.lit("L9"))).otherwise(codes)).alias("loinc_codes"), F.col("o_orderdate").alias("at"))


def order_codes(spark, sf_dir):
    n = F.col("n_nationkey")
    return tb.table(spark, sf_dir, "nation").select(tb.text("c", n).alias("connection_id"), F.explode(F.array(*[
        F.struct(F.lit(f"L{i}").alias("loinc"), tb.text(f"T{i}-", n).alias("instrument_code")) for i in range(3)])).alias("c")).select("connection_id", "c.*")


REQ = """rq AS (SELECT *, 'o' || o_orderkey AS order_id, o_custkey % 30 AS n, CASE WHEN o_orderkey % 19 = 0 THEN [] WHEN o_orderkey % 23 = 0 THEN ['L9']
  ELSE ['L' || (o_orderkey % 4), 'L' || ((o_orderkey + 1) % 4), 'L9'] END AS asked FROM orders),
mp AS (SELECT *, [x FOR x IN asked IF x IN ('L0', 'L1', 'L2') AND n < 25 AND o_orderkey % 13 <> 0] AS known FROM rq)"""


@query("m01_order_checks", f"""WITH {REQ} SELECT order_id, CASE WHEN o_orderkey % 13 = 0 THEN 'connection_required' WHEN o_orderkey % 17 = 0 THEN 'accession_required' WHEN len(asked) = 0 THEN 'codes_required'
  WHEN n >= 25 THEN 'no_active_connection' WHEN n % 5 = 0 THEN 'no_endpoint' WHEN len(known) = 0 THEN 'no_code_resolved' WHEN n % 3 = 0 THEN 'orders_not_supported' END AS reason FROM mp""")
def m01(spark, sf_dir):
    n = F.col("n_nationkey")
    conn = tb.table(spark, sf_dir, "nation").select(
        tb.text("c", n).alias("connection_id"), F.lit(True).alias("connected"), F.when(n % 5 > 0, "10.0.0.1").alias("host"), F.lit(2575).alias("port"),
        (n % 3 > 0).alias("orders_enabled"), F.when(n % 2 == 0, "hl7").otherwise("ASTM").alias("protocol"))
    rows = orders.mapped_codes(requests(spark, sf_dir), order_codes(spark, sf_dir)).join(conn, "connection_id", "left")
    return rows.select("order_id", orders.request_reason(rows).alias("reason"))


@query("m02_order_code_mapping", f"""WITH {REQ} SELECT order_id, array_to_string([replace(x, 'L', 'T') || '-' || n FOR x IN known], ',') AS codes,
  array_to_string([x FOR x IN asked IF NOT list_contains(known, x)], ',') AS unmapped FROM mp""")
def m02(spark, sf_dir):
    rows = orders.mapped_codes(requests(spark, sf_dir), order_codes(spark, sf_dir))
    return rows.select("order_id", F.coalesce(F.array_join("codes", ","), F.lit("")).alias("codes"), F.coalesce(F.array_join("unmapped", ","), F.lit("")).alias("unmapped"))


@query("m03_astm_order", r"""SELECT 'o' || o_orderkey AS order_id, 'H|\^&|||LIS^Order^1.0|||||||LIS2-A2' || chr(13) || 'P|1|||' || CASE WHEN o_orderkey % 3 > 0 THEN 'P' || o_custkey ELSE '' END || chr(13)
  || 'O|1|S' || o_orderkey || '||^^^A|R' || chr(13) || 'O|2|S' || o_orderkey || '||^^^B' || (o_orderkey % 5) || '|R' || chr(13) || 'L|1|N' || chr(13) AS message FROM orders""")
def m03(spark, sf_dir):
    key = F.col("o_orderkey")
    codes = F.array(F.lit("A"), F.lit(" "), tb.text("B", key % 5), F.lit(None).cast("string"))
    patient = F.when(key % 3 > 0, tb.text("P", F.col("o_custkey")))
    return tb.table(spark, sf_dir, "orders").select(tb.text("o", key).alias("order_id"), orders.astm_order(tb.text("S", key), patient, codes).alias("message"))


@query("m04_hl7_order", r"""SELECT 'o' || o_orderkey AS order_id, 'MSH|^~\&|LIS|LAB|ANALYZER|LAB|' || t || '||ORM^O01|LIS' || t || '|P|2.3.1' || chr(13) || 'PID|1||P' || o_custkey || '^^^HOSP' || chr(13)
  || 'ORC|NW|S' || o_orderkey || '|S' || o_orderkey || chr(13) || 'OBR|1|S' || o_orderkey || '|S' || o_orderkey || '|^^^B^B' || chr(13) AS message
FROM (SELECT *, strftime(o_orderdate, '%Y%m%d%H%M%S') AS t FROM orders)""")
def m04(spark, sf_dir):
    key = F.col("o_orderkey")
    message = orders.hl7_order(tb.text("S", key), tb.text("P", F.col("o_custkey")), F.array(F.lit(""), F.lit("B")), F.col("o_orderdate"))
    return tb.table(spark, sf_dir, "orders").select(tb.text("o", key).alias("order_id"), message.alias("message"))


@query("m05_outbound_endpoint", """WITH c AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'ASTM' WHEN 1 THEN 'HL7' ELSE 'FILE' END AS protocol, s_suppkey % 4 = 0 AS client, s_suppkey % 5 > 0 AS cap,
  CASE WHEN s_suppkey % 7 = 0 THEN 'RESULTS_ONLY' WHEN s_suppkey % 7 = 1 THEN 'TWO_WAY' END AS flow, CASE s_suppkey % 6 WHEN 0 THEN 'DEFAULT' WHEN 1 THEN 'ODD' END AS mode,
  CASE WHEN s_suppkey % 8 = 0 THEN 7000 WHEN s_suppkey % 8 = 1 THEN 70000 END AS op, CASE WHEN s_suppkey % 2 = 0 THEN 8000 END AS p, CASE WHEN s_suppkey % 9 = 0 THEN 9000 END AS tp FROM supplier),
e AS (SELECT *, cap AND (flow IS NULL OR flow = 'TWO_WAY') AS enabled, CASE WHEN coalesce(mode, '') <> 'DEFAULT' THEN coalesce(op, CASE WHEN client THEN p END) END AS own FROM c),
f AS (SELECT *, protocol <> 'FILE' AND (client OR enabled) AS needed, coalesce(own, tp, CASE protocol WHEN 'ASTM' THEN 12001 WHEN 'HL7' THEN 2575 END) AS port0 FROM e),
g AS (SELECT *, CASE WHEN mode = 'ODD' THEN 'port_mode' WHEN NOT port0 BETWEEN 1 AND 65535 THEN 'port_range' END AS err FROM f)
SELECT 'c' || k AS connection_id, enabled AS orders_enabled, needed, CASE WHEN needed AND err IS NULL THEN port0 END AS port,
  CASE WHEN needed AND err IS NULL THEN CASE WHEN own IS NOT NULL THEN 'Connection override' WHEN tp IS NOT NULL THEN 'Profile default' ELSE 'Deployment default' END END AS source,
  CASE WHEN needed THEN err END AS error FROM g""")
def m05(spark, sf_dir):
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    settings = {
        "protocol": F.when(k % 3 == 0, "ASTM").when(k % 3 == 1, "HL7").otherwise("FILE"), "transport": F.lit("TCP/IP"),
        "connection_role": F.when(k % 4 == 0, "CLIENT").otherwise("SERVER"), "outbound_capability": k % 5 > 0, "lis_initiated": F.lit(True),
        "data_flow": F.when(k % 7 == 0, "RESULTS_ONLY").when(k % 7 == 1, "TWO_WAY"), "port_mode": F.when(k % 6 == 0, "DEFAULT").when(k % 6 == 1, "ODD"),
        "outbound_port": F.when(k % 8 == 0, 7000).when(k % 8 == 1, 70000), "port": F.when(k % 2 == 0, 8000), "transport_port": F.when(k % 9 == 0, 9000),
        "profile_role": none, "profile_port": F.lit(None).cast("int"),
    }
    rows = tb.table(spark, sf_dir, "supplier").select(tb.text("c", k).alias("connection_id"), *[v.alias(n) for n, v in settings.items()])
    return rows.select("connection_id", orders.endpoint({n: F.col(n) for n in settings}).alias("e")).select("connection_id", "e.*")
