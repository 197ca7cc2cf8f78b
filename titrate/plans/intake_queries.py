"""Intake and frame queries (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..functions.net import canonical_ip
from ..operators import frames, intake
from . import testbed as tb
from .registry import query

TRIM = "chr(9)||chr(10)||chr(13)||' '"


def documents(spark, sf_dir):
    """Mixed raw inputs: documents with instrument openings on four of five."""
    d = tb.table(spark, sf_dir, "documents")
    opening = F.element_at(F.array(*map(F.lit, ("H|\\^&|x\r", "MSH|^~\\&|a\r", "a,b,c,d\n", "", " \t\x02H|\\^&"))),
                           (F.col("doc_id") % 5 + 1).cast("int"))
    return d.withColumn("raw_text", F.concat(opening, "text"))


@query("b01_detect_protocol", f"""SELECT protocol, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE doc_id % 5
  WHEN 0 THEN 'ASTM' WHEN 1 THEN 'HL7' WHEN 2 THEN 'CSV' WHEN 4 THEN 'ASTM' ELSE CASE
  WHEN contains(trim(text, {TRIM}), ',') AND
    len(string_split(rtrim(split_part(trim(text, {TRIM}), chr(10), 1), ','), ',')) > 3
  THEN 'CSV' ELSE 'UNKNOWN' END END AS protocol FROM documents) GROUP BY 1""")
def b01(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(intake.protocol_of(F.col("raw_text")).alias("protocol")).agg(
        F.count("*").alias("n"))


@query("b02_protocol_by_type", """SELECT ['HL7','CSV','ASTM','HL7','CSV'][doc_id % 5 + 1] AS protocol,
  CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1""")
def b02(spark, sf_dir):
    types = F.array(*map(F.lit, ("application/HL7-v2; charset=x", " text/csv ;a", "text/plain", "x/y", "APPLICATION/csv")))
    text = F.when(F.col("doc_id") % 5 == 2, F.lit("H|\\^&")).when(F.col("doc_id") % 5 == 3, F.lit("MSH|^~\\&|")).otherwise(F.lit("?"))
    rows = tb.table(spark, sf_dir, "documents")
    kind = intake.protocol_by_type(F.element_at(types, (F.col("doc_id") % 5 + 1).cast("int")), text)
    return rows.groupBy(kind.alias("protocol")).agg(
        F.count("*").alias("n"))


@query("b03_envelope_filter", """SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE
  WHEN role = 'system' THEN 'protocol' WHEN turn % 4 = 3 THEN 'transport' WHEN conv_id % 7 = 0 THEN 'source'
  WHEN trim(text) = '' OR turn % 5 = 4 THEN 'text' END AS reason FROM conversations) GROUP BY 1""")
def b03(spark, sf_dir):
    c = tb.table(spark, sf_dir, "conversations")
    why = intake.rejection(
        F.when(F.col("role") == "system", "X25").otherwise("ASTM"), F.when(F.col("turn") % 4 != 3, "TCP"),
        F.when(F.col("conv_id") % 7 == 0, " ").otherwise("s"), F.when(F.col("turn") % 5 == 4, " \t").otherwise(F.col("text")))
    return c.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("b04_content_hash", "SELECT doc_id, sha256(text) AS raw_hash FROM documents")
def b04(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select("doc_id", identity.content_hash(F.col("text")).alias("raw_hash"))


RECEIVED_SQL = """rec AS (SELECT doc_id, source, text, sha256(text) AS raw_hash,
  'recv-v1:' || sha256(CAST(source AS BLOB) || unhex('00') || CAST(sha256(text) AS BLOB)) AS receipt_id FROM documents)"""


def received(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    return intake.with_receipt(d.select(
        F.col("doc_id").alias("message_id"), F.col("source").alias("source_id"), F.col("text").alias("raw_text"),
        F.timestamp_seconds(F.col("doc_id")).alias("received_at")))


@query("b05_receipt_id", f"WITH {RECEIVED_SQL} SELECT doc_id AS message_id, receipt_id FROM rec")
def b05(spark, sf_dir):
    return received(spark, sf_dir).select("message_id", "receipt_id")


@query("b06_retransmission", f"""WITH {RECEIVED_SQL}
SELECT doc_id AS message_id, receipt_id, row_number() OVER (PARTITION BY receipt_id ORDER BY doc_id) > 1 AS already_present
FROM rec""")
def b06(spark, sf_dir):
    return intake.already_present(received(spark, sf_dir)).select("message_id", "receipt_id", "already_present")


@query("b07_raw_store", f"""WITH {RECEIVED_SQL}
SELECT raw_hash, any_value(text) AS raw_text, CAST(count(*) AS BIGINT) AS n_received FROM rec GROUP BY 1""")
def b07(spark, sf_dir):
    return intake.raw_store(received(spark, sf_dir)).select("raw_hash", "raw_text", "n_received")


@query("b08_lossless_payload", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'UTF8' ELSE 'BASE64' END AS encoding,
  CASE WHEN doc_id % 2 = 0 THEN text ELSE base64(unhex('FF') || encode(text)) END AS payload, true AS lossless
FROM documents""")
def b08(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    content = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 2 == 0, content).otherwise(F.concat(F.unhex(F.lit("FF")), content))
    rows = d.select("doc_id", content.alias("content")).withColumn("e", intake.encoded_payload(F.col("content")))
    back = intake.decoded_payload(F.col("e.encoding"), F.col("e.payload"))
    return rows.select("doc_id", "e.encoding", F.col("e.payload").alias("payload"), (back == F.col("content")).alias("lossless"))


@query("b09_file_receipts", """WITH f AS (SELECT source AS connection_id, sha256(text) AS raw_hash,
   'i' || (doc_id % 2) AS ih, 'p' || doc_id AS path, doc_id FROM documents)
SELECT 'recv-file-v1:' || sha256(CAST(connection_id AS BLOB) || unhex('00') || CAST(raw_hash AS BLOB)) AS receipt_id,
  arg_min(path, doc_id) AS path, count(DISTINCT ih) > 1 AS conflict, CAST(count(*) AS BIGINT) AS n_seen
FROM f GROUP BY connection_id, raw_hash""")
def b09(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    files = d.select(F.col("source").alias("connection_id"), F.sha2("text", 256).alias("raw_hash"),
                     tb.text("i", F.col("doc_id") % 2).alias("interpretation_hash"), tb.text("p", F.col("doc_id")).alias("path"),
                     F.timestamp_seconds("doc_id").alias("received_at"))
    return intake.file_receipts(files).select("receipt_id", "path", "conflict", "n_seen")


@query("b10_interpretation_hash", """SELECT doc_id, sha256('{"connectionId":"c' || (doc_id % 9) || '","delimiter":","'
  || CASE WHEN doc_id % 3 = 0 THEN ',"purpose":"SETUP"' ELSE '' END || '}') AS interpretation_hash FROM documents""")
def b10(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    context = {"delimiter": F.lit(","), "sourcePath": F.col("text"), "connectionId": tb.text("c", F.col("doc_id") % 9)}
    purpose = F.when(F.col("doc_id") % 3 == 0, "SETUP").otherwise("ROUTINE")
    return d.select("doc_id", intake.interpretation_hash(context, purpose).alias("interpretation_hash"))


_LEN = "unhex(printf('%08x', octet_length(encode({0})))) || encode({0})"


@query("b11_delivery_identity", f"""WITH d AS (SELECT doc_id, 'c' || source AS c, sha256(text) AS h,
  CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE 'é' || doc_id END AS a FROM documents)
SELECT doc_id, CASE WHEN trim(a) <> '' THEN ['astm-v1','hl7-v1','file-v1'][doc_id % 3 + 1] || ':' ||
  sha256({_LEN.format('c')} || {_LEN.format('h')} || {_LEN.format('a')}) END AS delivery_id FROM d""")
def b11(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    protocol = F.element_at(F.array(*map(F.lit, ("ASTM", "HL7", "CSV"))), (F.col("doc_id") % 3 + 1).cast("int"))
    accession = F.when(F.col("doc_id") % 10 == 0, " ").otherwise(tb.text("é", F.col("doc_id")))
    return d.select("doc_id", identity.delivery_id(protocol, tb.text("c", F.col("source")), F.sha2("text", 256), accession)
                    .alias("delivery_id"))


@query("b12_query_only", """SELECT o_orderkey % 3 = 0 AS query_only, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def b12(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = F.concat(F.when(key % 2 == 0, "H|\\^&\r Q|1|").otherwise("H!\\^&\r Q!1!"), key.cast("string"), F.when(
        key % 3 == 0, "\rRx|").when(key % 2 == 0, "\rR|1").otherwise("\r R!1"), F.lit("\rL|1"))
    return tb.table(spark, sf_dir, "orders").groupBy(intake.is_query_only(raw).alias("query_only")).agg(
        F.count("*").alias("n"))


@query("b13_astm_sender", """SELECT message_id, 'LAB' || (l_suppkey % 25) || '^MOD' || (l_partkey % 5) || '^1' AS sender
FROM (SELECT *, 'A' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS message_id FROM lineitem)""")
def b13(spark, sf_dir):
    return tb.astm_messages(spark, sf_dir).select("message_id", intake.astm_sender(F.col("raw_text")).alias("sender"))


@query("b14_hl7_sender", """SELECT 'M' || o_orderkey AS message_id, 'APP' || (o_custkey % 25) || '^v' AS sender FROM orders""")
def b14(spark, sf_dir):
    raw = F.regexp_replace("raw_text", r"\AMSH\|\^~\\&\|(APP\d+)", "\n MSH|!~\\\\&|$1!v")
    return tb.hl7_messages(spark, sf_dir).select("message_id", intake.hl7_sender(raw).alias("sender"))


@query("b15_sender_token", """SELECT site, model, version, CAST(count(*) AS BIGINT) AS n FROM (SELECT
  CASE WHEN l_linenumber % 2 = 0 THEN 'LAB' || (l_suppkey % 25) END AS site,
  CASE WHEN l_linenumber % 2 = 0 THEN 'MOD' || (l_partkey % 5) ELSE 'solo' || (l_suppkey % 25) END AS model,
  CASE WHEN l_linenumber % 4 = 0 THEN '1' END AS version FROM lineitem) GROUP BY 1, 2, 3""")
def b15(spark, sf_dir):
    ln, k = F.col("l_linenumber"), F.col("l_suppkey") % 25
    token = F.when(ln % 2 == 0, tb.text("LAB", k, "^ MOD", F.col("l_partkey") % 5, F.when(ln % 4 == 0, "^1").otherwise("^ "))
                   ).otherwise(tb.text(" solo", k))
    rows = tb.table(spark, sf_dir, "lineitem").select(intake.sender_token(token).alias("t"))
    return rows.groupBy("t.site", "t.model", "t.version").agg(F.count("*").alias("n"))


@query("b16_first_component", """SELECT CASE WHEN c_custkey % 3 > 0 THEN c_name END AS first, CAST(count(*) AS BIGINT) AS n
FROM customer GROUP BY 1""")
def b16(spark, sf_dir):
    hint = F.concat(F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")), F.lit("^x"))
    return tb.table(spark, sf_dir, "customer").groupBy(intake.first_component(hint).alias("first")).agg(
        F.count("*").alias("n"))


@query("b17_ip_literals", """SELECT o_orderkey, CASE o_orderkey % 4
  WHEN 0 THEN '10.' || (o_orderkey % 256) || '.0.' || (o_custkey % 256)
  WHEN 1 THEN '2001:db8:0:0:0:0:' || printf('%x', o_custkey) || ':1'
  WHEN 2 THEN CASE WHEN o_custkey % 300 <= 255 THEN '1.2.3.' || (o_custkey % 300) END END AS address FROM orders""")
def b17(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = (
        F.when(key % 4 == 0, tb.text(" 010.", key % 256, ".00.", cust % 256))
        .when(key % 4 == 1, F.concat(F.lit("2001:DB8::"), F.hex(cust), F.lit(":0001")))
        .when(key % 4 == 2, F.when(cust % 300 <= 255, tb.text("::FFFF:1.2.3.", cust % 300)).otherwise(tb.text("1.2.3.", cust % 300)))
        .otherwise(tb.text("host", key))
    )
    return tb.spread(tb.table(spark, sf_dir, "orders")).select("o_orderkey", canonical_ip(text).alias("address"))


def peers(spark, sf_dir):
    k = F.col("o_custkey")
    return tb.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session"), (F.lit(2000) + k % 5).alias("listener_port"),
        tb.text("10.", k % 7, ".", k % 256, ".", k % 16).alias("peer"))


def nation_ranges(spark, sf_dir):
    k = F.col("n_nationkey")
    entry = F.when(k < 3, tb.text("10.", k, ".0.0/16")).when(k == 3, F.lit("bad/99")).when(k < 10, tb.text(" 10.5.", k, ".0/28 "))
    return tb.table(spark, sf_dir, "nation").select(entry.alias("entry")).filter("entry IS NOT NULL")


@query("b18_source_allow_list", """SELECT admitted, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey % 7 < 3
  OR (o_custkey % 7 = 5 AND o_custkey % 256 BETWEEN 4 AND 9) AS admitted FROM orders) GROUP BY 1""")
def b18(spark, sf_dir):
    ranges = intake.allowed_ranges(nation_ranges(spark, sf_dir))
    return intake.admitted(peers(spark, sf_dir), ranges).groupBy("admitted").agg(F.count("*").alias("n"))


def host_connections(spark, sf_dir):
    k = F.col("n_nationkey")
    return tb.table(spark, sf_dir, "nation").select(
        (F.lit(2000) + k % 5).alias("listener_port"), tb.text("10.", k % 7, ".", k, ".", k % 16).alias("inbound_address"),
        F.when(k % 2 == 0, "HTTP").otherwise("TCP/IP").alias("inbound_transport"),
        tb.text("010.", k % 7, ".", k, ".", k % 16).alias("inbound_source"))


@query("b19_known_host", """SELECT known, CAST(count(*) AS BIGINT) AS n FROM (SELECT EXISTS (SELECT 1 FROM nation
  WHERE n_nationkey % 7 = o_custkey % 7 AND n_nationkey = o_custkey % 256 AND n_nationkey % 16 = o_custkey % 16
    AND n_nationkey % 5 = o_custkey % 5) AS known FROM orders) GROUP BY 1""")
def b19(spark, sf_dir):
    rows, hosts = peers(spark, sf_dir), host_connections(spark, sf_dir)
    yes = intake.known_hosts(rows, hosts).select(F.lit(True).alias("known"))
    no = intake.known_hosts(rows, hosts, False).select(F.lit(False).alias("known"))
    return yes.unionByName(no).groupBy("known").agg(F.count("*").alias("n"))


@query("b20_http_sender", """SELECT o_orderkey AS session FROM orders WHERE EXISTS (SELECT 1 FROM nation
  WHERE n_nationkey % 2 = 0 AND n_nationkey % 7 = o_custkey % 7 AND n_nationkey = o_custkey % 256
    AND n_nationkey % 16 = o_custkey % 16)""")
def b20(spark, sf_dir):
    rows = peers(spark, sf_dir).withColumnRenamed("peer", "source_id")
    return intake.http_senders(rows, host_connections(spark, sf_dir)).select("session")


def requests(spark, sf_dir):
    key = F.col("o_orderkey")
    return tb.spread(tb.table(spark, sf_dir, "orders")).select(
        "o_orderkey", F.when(key % 5 == 0, "10.9.9.9").otherwise("10.0.0.1").alias("remote"),
        (key % 70000).cast("int").alias("remote_port"),
        F.when(key % 3 == 0, tb.text("1.1.1.1, 2.2.2.", key % 200, " ,10.0.0.2")).when(key % 3 == 1, " ")
        .otherwise(tb.text("nobody,10.0.0.2")).alias("forwarded"),
        F.when(key % 2 == 0, "3.3.3.3").otherwise("none").alias("real_ip"),
        F.when(key % 4 == 0, (key % 66000).cast("string")).when(key % 4 == 1, "x").alias("forwarded_port"),
        F.array(F.lit("10.0.0.1"), F.lit("10.0.0.2")).alias("trusted"))


@query("b21_client_address", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '10.9.9.9'
  WHEN o_orderkey % 3 = 0 THEN '2.2.2.' || (o_orderkey % 200) WHEN o_orderkey % 3 = 2 THEN '10.0.0.1'
  WHEN o_orderkey % 2 = 0 THEN '3.3.3.3' ELSE '10.0.0.1' END AS address FROM orders""")
def b21(spark, sf_dir):
    return requests(spark, sf_dir).select("o_orderkey", intake.client_address(
        F.col("remote"), F.col("forwarded"), F.col("real_ip"), F.col("trusted")).alias("address"))


@query("b22_client_port", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0
    THEN CASE WHEN o_orderkey % 70000 BETWEEN 1 AND 65535 THEN CAST(o_orderkey % 70000 AS INTEGER) END
  WHEN o_orderkey % 4 = 0 AND o_orderkey % 66000 BETWEEN 1 AND 65535 THEN CAST(o_orderkey % 66000 AS INTEGER)
  END AS port FROM orders""")
def b22(spark, sf_dir):
    cols = [F.col(c) for c in ("remote", "remote_port", "forwarded", "real_ip", "forwarded_port", "trusted")]
    return requests(spark, sf_dir).select("o_orderkey", intake.client_port(*cols).alias("port"))


@query("b23_payload_charset", """SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'ÿA' || doc_id END) AS h
FROM documents""")
def b23(spark, sf_dir):
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(
        F.concat(F.unhex(F.lit("FF41")), F.encode(F.col("doc_id").cast("string"), "UTF-8")))
    return tb.table(spark, sf_dir, "documents").select("doc_id", F.sha2(intake.message_text(content), 256).alias("h"))


# --- frames: one session per orders row, three record frames and a closing one --------------------------------------


def wire_frames(spark, sf_dir):
    """Sessions with a bad checksum (key%7=1), a repeated frame (2), a skipped number (3), no end frame (4), no end
    of transmission (5); the rest are good."""
    key = F.col("o_orderkey")
    o = tb.spread(tb.table(spark, sf_dir, "orders"))
    texts = F.array(F.lit("H|\\^&\r"), tb.text("O|1|F", key, "\r"), tb.text("R|1|^^^T|", key % 100, "\r"), F.lit("L|1|N\r"))
    kind = key % 7
    plan = (
        F.when(kind == 2, F.array(*map(F.lit, (1, 2, 2, 3, 4)))).when(kind == 3, F.array(*map(F.lit, (1, 2, 4))))
        .when(kind == 4, F.array(*map(F.lit, (1, 2, 3)))).otherwise(F.array(*map(F.lit, (1, 2, 3, 4))))
    )
    rows = o.select(tb.text("s", key).alias("session_id"), kind.alias("kind"), texts.alias("texts"),
                    F.posexplode(plan).alias("seq", "no"))
    text = F.element_at("texts", F.col("no"))
    end = F.when((F.col("no") == 4), "ETX").otherwise("ETB")
    checksum = frames.checksum_of(F.col("no"), text, end)
    checksum = F.when((F.col("kind") == 1) & (F.col("no") == 3), "00x").otherwise(F.lower(checksum))
    body = F.concat(F.col("no").cast("string"), text, F.when(end == "ETX", "\u0003").otherwise("\u0017"),
                    F.substring(checksum, 1, 2), F.lit("\r\n"))
    return frames.parsed(rows.select("session_id", "kind", "seq", F.encode(body, "ISO-8859-1").alias("bytes")))


_RTEXT = "'R|1|^^^T|' || (o_orderkey % 100) || chr(13)"


@query("b24_frame_validation", f"""SELECT issue, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT NULL AS issue, CASE o_orderkey % 7 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 4 END AS n FROM orders
  UNION ALL SELECT 'checksum', 1 FROM orders WHERE o_orderkey % 7 = 1) GROUP BY 1""")
def b24(spark, sf_dir):
    return wire_frames(spark, sf_dir).groupBy(frames.frame_issue().alias("issue")).agg(F.count("*").alias("n"))


SESSION_SQL = """ses AS (SELECT 's' || o_orderkey AS session_id, o_orderkey % 7 AS kind, o_orderkey,
  CASE o_orderkey % 7 WHEN 1 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 4 END AS n_frames,
  CASE o_orderkey % 7 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS refused,
  CASE WHEN o_orderkey % 7 = 2 THEN 1 ELSE 0 END AS repeated,
  'H|\\^&' || chr(13) || 'O|1|F' || o_orderkey || chr(13)
    || CASE WHEN o_orderkey % 7 IN (1, 3) THEN '' ELSE 'R|1|^^^T|' || (o_orderkey % 100) || chr(13) END
    || CASE WHEN o_orderkey % 7 IN (1, 3, 4) THEN '' ELSE 'L|1|N' || chr(13) END AS raw_text FROM orders)"""


def sessions(spark, sf_dir):
    return frames.sequenced(wire_frames(spark, sf_dir), frames.frame_issue())


@query("b25_frame_sequence", f"WITH {SESSION_SQL} SELECT session_id, n_frames, refused, repeated FROM ses")
def b25(spark, sf_dir):
    return sessions(spark, sf_dir).select("session_id", F.size("accepted").alias("n_frames"), "refused", "repeated")


def messages(spark, sf_dir):
    ended = tb.table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 5").select(
        tb.text("s", F.col("o_orderkey")).alias("session_id"))
    return frames.assembled(sessions(spark, sf_dir), ended)


@query("b26_message_assembly", f"""WITH {SESSION_SQL} SELECT session_id, raw_text,
  CASE WHEN kind IN (1, 3, 4, 5) THEN 'INCOMPLETE_TRANSMISSION' ELSE 'COMPLETE' END AS state FROM ses""")
def b26(spark, sf_dir):
    return messages(spark, sf_dir).select("session_id", "raw_text", "state")


@query("b27_frame_records", f"WITH {SESSION_SQL} SELECT session_id, 0 AS record_no, raw_text AS record FROM ses")
def b27(spark, sf_dir):
    return frames.records_of(sessions(spark, sf_dir))


@query("b28_incomplete_held", f"""WITH {SESSION_SQL} SELECT session_id FROM ses
WHERE kind IN (1, 3, 4, 5) AND o_orderkey % 2 = 1""")
def b28(spark, sf_dir):
    # An odd session's sender sends nothing more; an even one's full message arrives later and replaces it.
    number = F.substring("session_id", 2, 20).cast("long")
    rows = messages(spark, sf_dir).withColumn("sender", F.col("session_id"))
    completed = tb.table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(
        tb.text("s", F.col("o_orderkey")).alias("sender"))
    return frames.held_incomplete(rows, completed).filter(number.isNotNull()).select("session_id")


@query("b29_mllp_unframing", """SELECT 'M' || o_orderkey AS session_id, n - 1 AS pos,
  CASE n WHEN 1 THEN 'MSH|a' || o_orderkey ELSE 'MSH|b' || chr(13) || 'PID' END AS message
FROM orders, (VALUES (1), (2)) t(n)""")
def b29(spark, sf_dir):
    captured = F.concat(F.lit("junk\x0bMSH|a"), F.col("o_orderkey").cast("string"), F.lit("\x1c\r\x0bMSH|b\rPID\x1c\r\x0bopen"))
    return tb.table(spark, sf_dir, "orders").select(
        tb.text("M", F.col("o_orderkey")).alias("session_id"),
        F.posexplode(frames.mllp_messages(captured)).alias("pos", "message"))
