"""Source attribution queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution
from . import testbed as tb
from .registry import query


def connections(spark, sf_dir):
    """One listening connection per supplier key pattern: 25 nations x four roles on five listeners.

    Per nation n (listener 2000 + n % 5): A has its own address; B and C share an address and differ by sender (C with
    a wildcard); D has no address and, for even n, no sender.
    """
    n = F.col("n_nationkey")
    port = (F.lit(2000) + n % 5).cast("int")

    def row(role, address, sender, pattern, transport="TCP/IP"):
        return F.struct(
            tb.text(f"{role}-", n).alias("connection_id"), port.alias("listener_port"), address.cast("string").alias("inbound_address"),
            sender.cast("string").alias("sender_id"), pattern.cast("string").alias("identifier_pattern"),
            F.lit("ASTM").alias("expected_protocol"), F.lit(transport).alias("inbound_transport"))

    none = F.lit(None)
    roles = F.array(
        row("A", tb.text("10.1.", n, ".1"), none, tb.text("MOD", n % 3)),
        row("B", tb.text("10.2.", n, ".1"), tb.text("lab", n), none),
        row("C", tb.text("10.2.", n, ".1"), tb.text("LAB", n, "^*X"), none),
        row("D", none, F.when(n % 2 == 1, tb.text("FREE", n)), F.when(n % 4 == 0, tb.text("K", n, "$")), "RS-232"),
    )
    return tb.table(spark, sf_dir, "nation").select(F.explode(roles).alias("c")).select("c.*")


def traffic(spark, sf_dir):
    """One message per order: which role it aims at is key % 6; the nation is the customer's number % 25."""
    key, n = F.col("o_orderkey"), (F.col("o_custkey") % 25)
    kind = key % 6
    source = F.when(kind == 0, tb.text("010.1.", n, ".1")).when(kind.isin(1, 2, 5), tb.text("10.2.", n, ".1")).otherwise("10.9.9.9")
    sender = (
        F.when(kind == 0, tb.text("any^MOD", key % 3)).when(kind == 1, tb.text(" Lab", n, "^M1")).when(kind == 2, tb.text("lab", n, "^zzx"))
        .when(kind == 3, tb.text("free", n, "^1")).when(kind == 4, F.when(key % 4 == 0, tb.text("K", n)).otherwise(" "))
        .otherwise("stranger")
    )
    port = F.when(key % 50 == 0, 2999).otherwise(F.lit(2000) + n % 5)
    return tb.table(spark, sf_dir, "orders").select(
        tb.text("M", key).alias("message_id"), port.cast("int").alias("listener_port"), source.alias("source_id"), sender.alias("sender_hint"),
        F.lit("ASTM").alias("protocol"), F.lit("TCP").alias("transport"))


# Expected resolution by brute force: every message against every connection of its listener, rung by rung.
LADDER_SQL = r"""con AS (SELECT role || '-' || n_nationkey AS id, 2000 + n_nationkey % 5 AS port, n_nationkey AS n,
    CASE role WHEN 'A' THEN '10.1.' || n_nationkey || '.1' WHEN 'D' THEN NULL ELSE '10.2.' || n_nationkey || '.1' END AS addr,
    CASE role WHEN 'B' THEN 'lab' || n_nationkey WHEN 'C' THEN 'LAB' || n_nationkey || '^*X'
      WHEN 'D' THEN CASE WHEN n_nationkey % 2 = 1 THEN 'FREE' || n_nationkey END END AS sender,
    CASE WHEN role = 'A' THEN 'MOD' || (n_nationkey % 3) WHEN role = 'D' AND n_nationkey % 4 = 0 THEN 'K' || n_nationkey || '$' END AS pat,
    CASE WHEN role = 'D' THEN 'RS-232' ELSE 'TCP/IP' END AS transport
  FROM nation, (VALUES ('A'), ('B'), ('C'), ('D')) t(role)),
msg AS (SELECT o_orderkey, 'M' || o_orderkey AS message_id, CASE WHEN o_orderkey % 50 = 0 THEN 2999 ELSE 2000 + (o_custkey % 25) % 5 END AS port,
    CASE WHEN o_orderkey % 6 = 0 THEN '10.1.' || (o_custkey % 25) || '.1' WHEN o_orderkey % 6 IN (1, 2, 5) THEN '10.2.' || (o_custkey % 25) || '.1' ELSE '10.9.9.9' END AS peer,
    CASE o_orderkey % 6 WHEN 0 THEN 'any^MOD' || (o_orderkey % 3) WHEN 1 THEN 'Lab' || (o_custkey % 25) || '^M1' WHEN 2 THEN 'lab' || (o_custkey % 25) || '^zzx'
      WHEN 3 THEN 'free' || (o_custkey % 25) || '^1' WHEN 4 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'K' || (o_custkey % 25) END ELSE 'stranger' END AS snd
  FROM orders),
lis AS (SELECT m.*, c.*, c.addr IS NOT NULL AND c.addr = m.peer AS by_addr FROM msg m JOIN con c ON c.port = m.port),
pool AS (SELECT *, count_if(by_addr) OVER (PARTITION BY message_id) AS n_addr FROM lis),
pool2 AS (SELECT * FROM pool WHERE CASE WHEN n_addr > 0 THEN by_addr ELSE addr IS NULL END),
snd1 AS (SELECT *, snd IS NOT NULL AND sender IS NOT NULL AND (CASE WHEN contains(sender, '*')
    THEN starts_with(lower(snd), lower(split_part(sender, '*', 1))) AND ends_with(lower(snd), lower(split_part(sender, '*', 2))) ELSE lower(sender) = lower(snd) END) AS whole,
    snd IS NOT NULL AND sender IS NOT NULL AND lower(sender) = lower(split_part(snd, '^', 1)) AND (pat IS NULL OR regexp_matches(snd, '(?i)' || pat)) AS first_part FROM pool2),
snd2 AS (SELECT *, count_if(whole) OVER w AS n_whole, count_if(first_part) OVER w AS n_first FROM snd1 WINDOW w AS (PARTITION BY message_id)),
snd3 AS (SELECT *, CASE WHEN snd IS NULL THEN 'blank' WHEN n_whole > 0 THEN 'whole' WHEN n_first > 0 THEN 'first' ELSE 'unnamed' END AS rung FROM snd2),
cand AS (SELECT *, count(*) OVER (PARTITION BY message_id) AS n_cand FROM snd3 WHERE CASE rung WHEN 'whole' THEN whole WHEN 'first' THEN first_part ELSE sender IS NULL END),
cand2 AS (SELECT * FROM cand WHERE n_cand = 1 OR pat IS NULL OR regexp_matches(coalesce(snd, ' '), '(?i)' || pat)),
res AS (SELECT m.message_id, m.o_orderkey, CAST(count(c.id) AS INTEGER) AS n, min(c.id) AS id, string_agg(c.id, ', ' ORDER BY c.id) AS ids, any_value(c.n_addr) AS n_addr,
    bool_or(c.rung IN ('whole', 'first') AND c.n_cand = 1) AS by_sender, any_value(c.transport) AS transport
  FROM msg m LEFT JOIN cand2 c USING (message_id) GROUP BY 1, 2),
out AS (SELECT message_id, CASE WHEN n = 1 THEN id END AS connection_id,
    CASE WHEN n = 1 THEN CASE WHEN by_sender THEN 'sender' WHEN n_addr = 1 THEN 'address' ELSE 'uniqueness' END END AS basis,
    CASE WHEN n = 0 THEN 'UNREGISTERED_SOURCE' WHEN n > 1 THEN 'AMBIGUOUS_SOURCE' END AS reason, CASE WHEN n > 1 THEN ids END AS candidates, transport FROM res)"""


def resolved(spark, sf_dir):
    return attribution.on_listener(traffic(spark, sf_dir), connections(spark, sf_dir))


def named_sources(spark, sf_dir):
    """File and host sources of the orders, and the bindings of 25 nations by key, alias and glob."""
    key, n = F.col("o_orderkey"), F.col("o_custkey") % 25
    source = (
        F.when(key % 4 == 0, tb.text("connection:c", n)).when(key % 4 == 1, tb.text("host", n))
        .when(key % 4 == 2, tb.text("/data/lab", n, "/run,", key, ".csv")).otherwise(tb.text("/other/", n, "/x", key, ".tsv"))
    )
    return tb.table(spark, sf_dir, "orders").select(tb.text("M", key).alias("message_id"), source.alias("source_id"))


def bindings(spark, sf_dir):
    n = F.col("n_nationkey")
    rows = F.array(
        F.struct(tb.text("connection:c", n).alias("binding_key"), tb.text("c", n).alias("connection_id"),
                 tb.text("host", n - n % 2).alias("inbound_source")),
        F.struct(tb.text("/data/lab", n, "/[!a-q]*,[0-9]*.{csv,tsv}").alias("binding_key"), tb.text("g", n).alias("connection_id"), F.lit(None).cast("string").alias("inbound_source")),
        F.struct(tb.text("*", n, ".tsv").alias("binding_key"), tb.text("t", n).alias("connection_id"), F.lit(None).cast("string").alias("inbound_source")),
    )
    return tb.table(spark, sf_dir, "nation").select(F.explode(rows).alias("b")).select("b.*")


# host<n>: aliases are shared by an even nation and the odd one after it, except 24 which stands alone.
_SOURCES = "SELECT 'M' || o_orderkey AS message_id, o_orderkey, o_custkey % 25 AS n FROM orders"


@query("c01_direct_binding", f"SELECT message_id, 'c' || n AS connection_id FROM ({_SOURCES}) WHERE o_orderkey % 4 = 0")
def c01(spark, sf_dir):
    return attribution.direct(named_sources(spark, sf_dir), bindings(spark, sf_dir)).filter("connection_id IS NOT NULL").select("message_id", "connection_id")


@query("c02_alias_binding", f"""SELECT message_id, CASE WHEN n = 24 THEN 'c24' END AS connection_id, CAST(CASE WHEN n = 24 THEN 1 WHEN n % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS claims
FROM ({_SOURCES}) WHERE o_orderkey % 4 = 1""")
def c02(spark, sf_dir):
    rows = named_sources(spark, sf_dir).filter("source_id LIKE 'host%'")
    return attribution.by_alias(rows, bindings(spark, sf_dir)).select("message_id", "connection_id", "claims")


@query("c03_glob_binding", f"""SELECT message_id, CASE WHEN o_orderkey % 4 = 2 THEN 'g' || n ELSE (SELECT 't' || n_nationkey FROM nation
   WHERE ends_with(CAST(o_orderkey AS VARCHAR), CAST(n_nationkey AS VARCHAR)) ORDER BY '*' || n_nationkey || '.tsv' LIMIT 1) END AS connection_id
FROM ({_SOURCES}) WHERE o_orderkey % 4 IN (2, 3)""")
def c03(spark, sf_dir):
    rows = named_sources(spark, sf_dir).filter("source_id LIKE '/%'")
    return attribution.by_glob(rows, bindings(spark, sf_dir)).select("message_id", "connection_id")


@query("c04_listener_pool", f"""WITH {LADDER_SQL} SELECT m.message_id, CAST(count(c.id) AS BIGINT) AS n_candidates FROM msg m LEFT JOIN con c ON c.port = m.port GROUP BY 1""")
def c04(spark, sf_dir):
    return attribution.listener_sizes(traffic(spark, sf_dir), connections(spark, sf_dir)).select("message_id", "n_candidates")


@query("c05_address_rung", f"WITH {LADDER_SQL} SELECT m.message_id, coalesce(any_value(p.n_addr), 0)::BIGINT AS n_by_address, CAST(count(p.message_id) AS BIGINT) AS n_pool FROM msg m LEFT JOIN pool2 p USING (message_id) GROUP BY 1")
def c05(spark, sf_dir):
    rows = attribution.address_pool(traffic(spark, sf_dir), connections(spark, sf_dir))
    return rows.select("message_id", "n_by_address", "n_pool")


@query("c06_sender_rung", f"WITH {LADDER_SQL} SELECT message_id, id AS connection_id FROM res WHERE n = 1 AND by_sender")
def c06(spark, sf_dir):
    return resolved(spark, sf_dir).filter("basis = 'sender'").select("message_id", "connection_id")


@query("c07_blank_sender", f"WITH {LADDER_SQL} SELECT r.message_id, r.n AS n_left FROM res r JOIN msg m USING (message_id) WHERE m.snd IS NULL")
def c07(spark, sf_dir):
    blank = traffic(spark, sf_dir).filter("trim(sender_hint) = ''")
    return attribution.on_listener(blank, connections(spark, sf_dir)).select("message_id", "n_left")


@query("c08_pattern_rung", f"WITH {LADDER_SQL} SELECT message_id, n AS n_left FROM res")
def c08(spark, sf_dir):
    return resolved(spark, sf_dir).select("message_id", "n_left")


@query("c09_resolution", f"""WITH {LADDER_SQL} SELECT message_id, connection_id, basis, reason, candidates,
  CASE reason WHEN 'UNREGISTERED_SOURCE' THEN 'none' WHEN 'AMBIGUOUS_SOURCE' THEN 'several' END AS found FROM out""")
def c09(spark, sf_dir):
    return resolved(spark, sf_dir).select("message_id", "connection_id", "basis", "reason", F.array_join("candidates", ", ").alias("candidates"), "detail.found")


@query("c10_transport_match", """SELECT protocol, transport, saved, matches, CAST(count(*) AS BIGINT) AS n FROM (SELECT protocol, transport, saved,
  CASE WHEN saved = 'TCP/IP' THEN transport = CASE WHEN protocol = 'HL7' THEN 'MLLP' ELSE 'TCP' END
    WHEN saved = 'RS-232' THEN transport = 'SERIAL' ELSE transport = saved END AS matches
  FROM (SELECT ['ASTM','HL7','CSV'][o_orderkey % 3 + 1] AS protocol, ['TCP','MLLP','SERIAL','HTTP'][o_orderkey % 4 + 1] AS transport,
    ['TCP/IP','RS-232','HTTP'][o_custkey % 3 + 1] AS saved FROM orders)) GROUP BY 1, 2, 3, 4""")
def c10(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    key = F.col("o_orderkey")
    rows = tb.table(spark, sf_dir, "orders").select(
        pick(("ASTM", "HL7", "CSV"), key).alias("protocol"), pick(("TCP", "MLLP", "SERIAL", "HTTP"), key).alias("transport"),
        pick(("TCP/IP", "RS-232", "HTTP"), F.col("o_custkey")).alias("saved"))
    expected = F.when(F.col("protocol") == "CSV", "FILE").otherwise(F.col("protocol"))
    ok = attribution.transport_matches(F.col("protocol"), F.col("transport"), expected, F.col("saved"))
    return rows.groupBy("protocol", "transport", "saved", ok.alias("matches")).agg(F.count("*").alias("n"))


@query("c11_hint_corroboration", """SELECT mode, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN l_linenumber % 3 = 0 THEN NULL
  WHEN l_suppkey % 25 = l_partkey % 25 THEN 'corroborated' ELSE 'mismatch' END AS mode FROM lineitem) GROUP BY 1""")
def c11(spark, sf_dir):
    hint = F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise(tb.text("LAB", F.col("l_suppkey") % 25, "^x"))
    pattern = tb.text("lab", F.col("l_partkey") % 25, "\\b")
    return tb.table(spark, sf_dir, "lineitem").groupBy(attribution.corroboration(hint, pattern).alias("mode")).agg(F.count("*").alias("n"))


def similar(spark, sf_dir):
    """Supplier connections in groups of four around one address, with literal and wildcard senders."""
    k = F.col("s_suppkey")
    sender = F.when(k % 4 == 0, tb.text("Sys", k % 8)).when(k % 4 == 1, tb.text("SYS", k % 8 - 1)).when(k % 4 == 2, tb.text("s*", k % 8 - 2)).otherwise("other*z")
    return tb.table(spark, sf_dir, "supplier").select(
        F.format_string("s%08d", k).alias("connection_id"), F.lit(3000).alias("listener_port"),
        tb.text("10.", F.floor(k / 4), ".0.1").alias("inbound_address"), sender.alias("sender_id"),
        F.when(k % 16 == 1, "P1").when(k % 16 == 0, "P2").cast("string").alias("identifier_pattern"))


# Suppliers 4g, 4g+1, 4g+2, 4g+3 share an address. Senders: Sys<r>, SYS<r>, s*<r> overlap pairwise; other*z does not.
SIMILAR_SQL = """sim AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey // 4 = b.s_suppkey // 4 AND a.s_suppkey < b.s_suppkey
  WHERE b.s_suppkey % 4 < 3 AND NOT (a.s_suppkey % 16 = 0 AND b.s_suppkey % 16 = 1))"""


@query("c12_indistinguishable", f"WITH {SIMILAR_SQL} SELECT printf('s%08d', a) AS connection_id, printf('s%08d', b) AS other_id FROM sim")
def c12(spark, sf_dir):
    return attribution.indistinguishable(similar(spark, sf_dir))


@query("c13_file_owner", """SELECT 'f' || o_orderkey AS file_id, CASE WHEN o_custkey % 40 >= 25 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'csv' || (o_custkey % 40) ELSE 'any' || (o_custkey % 40) END AS owner
FROM orders WHERE o_custkey % 40 < 25""")
def c13(spark, sf_dir):
    key = F.col("o_orderkey")
    files = tb.table(spark, sf_dir, "orders").select(
        tb.text("f", key).alias("file_id"), tb.text("/in/d", F.col("o_custkey") % 40, "/r", key, F.when(key % 2 == 0, ".csv").otherwise(".txt")).alias("path"))
    n = F.col("n_nationkey")
    regs = tb.table(spark, sf_dir, "nation").select(tb.text("/in/d", n).alias("directory"), F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("[!a]*[0-9].{csv,tsv}").alias("pattern"), tb.text("csv", n).alias("owner")),
        F.struct(F.lit(1).alias("ord"), F.lit("r*").alias("pattern"), tb.text("any", n).alias("owner")))).alias("r")).select("directory", "r.*")
    return attribution.file_owner(files, regs).select("file_id", "owner")


@query("c14_unique_file_connection", """SELECT 'an' || s_nationkey AS analyzer_id, min('c' || s_suppkey) AS connection_id FROM supplier WHERE s_suppkey % 3 = 0
GROUP BY 1 HAVING count(*) = 1""")
def c14(spark, sf_dir):
    s = tb.table(spark, sf_dir, "supplier").select(tb.text("an", F.col("s_nationkey")).alias("analyzer_id"), tb.text("c", F.col("s_suppkey")).alias("connection_id"),
                                                   F.when(F.col("s_suppkey") % 3 == 0, "FILE").otherwise("HL7").alias("expected_protocol"))
    return attribution.unique_file_connection(s)


ACTIVE_SQL = """act AS (SELECT user_id, event_id, ts AS active_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS active_to FROM events WHERE event_type = 'signup')"""


def activations(spark, sf_dir):
    from ..operators import connections as ops

    e = tb.table(spark, sf_dir, "events").filter("event_type = 'signup'")
    return ops.intervals(e.select(tb.text("u", F.col("user_id")).alias("connection_id"), F.col("event_id").alias("activation"), F.col("ts").alias("at")))


@query("c15_receipt_time_profile", f"""WITH {ACTIVE_SQL} SELECT e.event_id, a.event_id AS activation FROM events e LEFT JOIN act a ON a.user_id = e.user_id AND e.ts >= a.active_from
  AND (a.active_to IS NULL OR e.ts < a.active_to) WHERE e.event_type <> 'signup'""")
def c15(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "events").filter("event_type <> 'signup'").select(
        "event_id", tb.text("u", F.col("user_id")).alias("connection_id"), F.col("ts").alias("received_at"))
    return attribution.as_received(rows, activations(spark, sf_dir)).select("event_id", "activation")


@query("c16_profile_pin", """SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN l_partkey % 3 = 2 OR l_suppkey % 2 = 1 THEN 'UNPINNED_PROFILE' END AS reason FROM lineitem) GROUP BY 1""")
def c16(spark, sf_dir):
    pinned = tb.table(spark, sf_dir, "lineitem").select(tb.text("p", F.col("l_partkey")).alias("profile_id"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("revision"))
    catalog = tb.table(spark, sf_dir, "part").filter("p_partkey % 3 < 2").select(tb.text("p", F.col("p_partkey")).alias("profile_id"), F.lit(1).alias("revision"))
    return attribution.pinned(pinned, catalog).groupBy("reason").agg(F.count("*").alias("n"))


@query("c17_re_resolution", f"WITH {LADDER_SQL} SELECT message_id, connection_id, basis FROM out WHERE reason IS NULL AND CAST(substr(message_id, 2) AS BIGINT) % 10 = 3")
def c17(spark, sf_dir):
    rows = traffic(spark, sf_dir)
    asked = rows.filter(F.substring("message_id", 2, 20).cast("long") % 10 == 3).select("message_id")
    return attribution.re_resolved(rows, asked, connections(spark, sf_dir)).filter("reason IS NULL").select("message_id", "connection_id", "basis")


@query("c18_attribution_ladder", f"""WITH {LADDER_SQL} SELECT message_id, CASE WHEN transport = 'RS-232' THEN NULL ELSE connection_id END AS connection_id, basis,
  CASE WHEN connection_id IS NOT NULL AND transport = 'RS-232' THEN 'CONNECTION_TRANSPORT_MISMATCH' ELSE reason END AS reason FROM out""")
def c18(spark, sf_dir):
    return attribution.attributed(traffic(spark, sf_dir), connections(spark, sf_dir)).select("message_id", "connection_id", "basis", "reason")
