"""Profile and connection dimension queries (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connections as ops
from ..operators import fingerprint, profile_checks, profiles
from ..session import written_table
from . import profile_testbed as pt
from . import testbed as tb
from .registry import query


def parsed(spark, sf_dir):
    """The parsed catalog, written once like any table of record."""
    return written_table(spark, f"catalog {sf_dir}", lambda: profiles.read(tb.spread(pt.documents(spark, sf_dir))))


PART = "p AS (SELECT 'p' || p_partkey AS profile_id, 1 AS revision, p_partkey AS k, p_partkey % 40 AS d, CASE WHEN p_partkey % 40 = 5 THEN 'A1' ELSE 'B1' END AS second FROM part)"
NAMES = PART + """, nm AS (SELECT profile_id, revision, k, 'A1' AS code, 0 AS ord, unnest(['a' || k, 'alpha']) AS alias, generate_subscripts([1, 2], 1) AS pos FROM p
  UNION ALL SELECT profile_id, revision, k, second, 1, 'b' || k, 1 FROM p UNION ALL SELECT profile_id, revision, k, second, 1, 'A1', 2 FROM p WHERE d = 6)"""
SUPP = """s AS (SELECT 'c' || s_suppkey AS connection_id, s_suppkey AS k, s_suppkey % 6 AS m, s_suppkey % 40 AS d FROM supplier),
ov AS (SELECT connection_id, k, d, 'A1' AS profile_code, 'in' || k AS instrument_code, 0 AS ord FROM s WHERE m = 0 UNION ALL SELECT connection_id, k, d, 'B1', 'alpha', 0 FROM s WHERE m = 1
  UNION ALL SELECT connection_id, k, d, 'NOPE', 'x', 0 FROM s WHERE m = 2 UNION ALL SELECT connection_id, k, d, 'A1', 'same', 0 FROM s WHERE m = 3
  UNION ALL SELECT connection_id, k, d, 'B1', 'same', 1 FROM s WHERE m = 3 UNION ALL SELECT connection_id, k, d, 'A1', '', 0 FROM s WHERE m = 4)"""
CODES = f"""{NAMES}, {SUPP}, cm AS (SELECT connection_id, instrument_code, arg_max(profile_code, (rank, ord, pos)) AS profile_code FROM (
  SELECT connection_id, alias AS instrument_code, code AS profile_code, 0 AS rank, ord, pos FROM s JOIN nm USING (k)
  UNION ALL SELECT connection_id, instrument_code, profile_code, 1, ord, 0 FROM ov) GROUP BY 1, 2)"""
LOINCS = f"""{CODES}, lall AS (SELECT connection_id, alias AS instrument_code, ord, pos, CASE ord WHEN 0 THEN '1000-1' ELSE '2000-2' END AS loinc FROM s JOIN nm USING (k)
  UNION ALL SELECT connection_id, coalesce((SELECT instrument_code FROM ov WHERE ov.connection_id = s.connection_id AND ov.profile_code = 'A1'), 'A1'), 0, 0, '1000-1' FROM s
  UNION ALL SELECT connection_id, coalesce((SELECT instrument_code FROM ov WHERE ov.connection_id = s.connection_id AND ov.profile_code = CASE WHEN s.d = 5 THEN 'A1' ELSE 'B1' END), CASE WHEN s.d = 5 THEN 'A1' ELSE 'B1' END), 1, 0, '2000-2' FROM s),
lo AS (SELECT connection_id, instrument_code, arg_max(loinc, (ord, pos)) AS loinc, min((ord, pos)) AS first_seen FROM lall GROUP BY 1, 2)"""


@query("d01_test_mappings", f"WITH {PART} SELECT profile_id, 0 AS ord, 'A1' AS test_code FROM p UNION ALL SELECT profile_id, 1, second FROM p")
def d01(spark, sf_dir):
    return profiles.tests(parsed(spark, sf_dir)).select("profile_id", "ord", F.col("test.test_code").alias("test_code"))


@query("d02_alias_codes", f"WITH {NAMES} SELECT profile_id, alias AS instrument_code, arg_max(code, (ord, pos)) AS profile_code FROM nm GROUP BY 1, 2")
def d02(spark, sf_dir):
    return profiles.aliases(parsed(spark, sf_dir)).select("profile_id", "instrument_code", "profile_code")


@query("d03_code_overrides", f"WITH {CODES} SELECT * FROM cm")
def d03(spark, sf_dir):
    return profiles.code_map(parsed(spark, sf_dir), pt.connections(spark, sf_dir))


@query("d04_override_issues", f"""WITH {SUPP} SELECT connection_id, profile_code, instrument_code, issue FROM (SELECT *, CASE
  WHEN profile_code = 'NOPE' OR (profile_code = 'B1' AND d = 5) THEN 'undeclared_code' WHEN instrument_code = '' THEN 'blank_code'
  WHEN instrument_code = 'alpha' THEN 'used_by_other_test' WHEN ord = 1 THEN 'given_twice' END AS issue FROM ov) WHERE issue IS NOT NULL""")
def d04(spark, sf_dir):
    return profiles.override_issues(parsed(spark, sf_dir), pt.connections(spark, sf_dir))


@query("d05_code_to_loinc", f"WITH {LOINCS} SELECT connection_id, instrument_code, loinc FROM lo")
def d05(spark, sf_dir):
    return profiles.loinc_map(parsed(spark, sf_dir), pt.connections(spark, sf_dir)).drop("first_seen")


@query("d06_result_loinc", f"""WITH {LOINCS}, via AS (SELECT connection_id, profile_code AS test_code, arg_min(loinc, instrument_code) AS v FROM cm JOIN lo USING (connection_id, instrument_code) GROUP BY 1, 2),
r AS (SELECT 'c' || l_suppkey AS connection_id, CASE WHEN l_partkey % 2 = 0 THEN 'A1' ELSE 'B1' END AS test_code FROM lineitem)
SELECT r.test_code, coalesce(lo.loinc, via.v) AS loinc, CAST(count(*) AS BIGINT) AS n FROM r LEFT JOIN lo ON lo.connection_id = r.connection_id AND lo.instrument_code = r.test_code
LEFT JOIN via ON via.connection_id = r.connection_id AND via.test_code = r.test_code GROUP BY 1, 2""")
def d06(spark, sf_dir):
    p, c = parsed(spark, sf_dir), pt.connections(spark, sf_dir)
    results = tb.table(spark, sf_dir, "lineitem").select(
        tb.text("c", F.col("l_suppkey")).alias("connection_id"), F.when(F.col("l_partkey") % 2 == 0, "A1").otherwise("B1").alias("test_code"))
    return profiles.loinc_of_result(results, profiles.loinc_map(p, c), profiles.code_map(p, c)).groupBy("test_code", "loinc").agg(F.count("*").alias("n"))


@query("d07_order_codes", f"WITH {LOINCS} SELECT connection_id, loinc, arg_min(instrument_code, first_seen) AS instrument_code FROM lo GROUP BY 1, 2")
def d07(spark, sf_dir):
    return profiles.order_codes(profiles.loinc_map(parsed(spark, sf_dir), pt.connections(spark, sf_dir)))


@query("d08_components", f"""WITH {PART} SELECT profile_id, 'A1' AS test_code, n - 1 AS ord, CASE n WHEN 1 THEN 'call' WHEN 2 THEN CASE WHEN d = 17 THEN 'call' ELSE 'ct' END ELSE 'hl' END AS code,
  CASE n WHEN 1 THEN CASE WHEN d = 19 THEN 'C' ELSE '' END WHEN 2 THEN 'S1' ELSE CASE WHEN d = 18 THEN 'S1' ELSE 'S2' END END AS sub_identity FROM p, (VALUES (1), (2), (3)) t(n)""")
def d08(spark, sf_dir):
    return profiles.components(parsed(spark, sf_dir)).select("profile_id", "test_code", "ord", "code", "sub_identity")


@query("d09_run_failures", f"""WITH {PART} SELECT profile_id, code, '' AS sub_identity, value FROM (SELECT profile_id, unnest(['A1', 'a' || k, 'alpha']) AS code, 'ERR' AS value FROM p
  UNION ALL SELECT profile_id, unnest(['A1', 'a' || k, 'alpha']), 'POS' FROM p WHERE d = 12 UNION ALL SELECT profile_id, unnest(['A1', 'a' || k, 'alpha']), 'positif' || k FROM p WHERE d = 12)""")
def d09(spark, sf_dir):
    return profiles.run_failures(parsed(spark, sf_dir)).drop("revision")


@query("d10_answer_spellings", f"""WITH {PART} SELECT profile_id, 'A1' AS test_code, sub_identity, spelling, canonical, ambiguous FROM (
  SELECT profile_id, '' AS sub_identity, unnest(['POS', 'NEG', 'negatif']) AS spelling, unnest(['POS', 'NEG', 'NEG']) AS canonical, false AS ambiguous FROM p
  UNION ALL SELECT profile_id, '', 'positif' || k, CASE WHEN d = 15 THEN 'NEG' ELSE 'POS' END, d = 15 FROM p UNION ALL SELECT profile_id, '', 'peut', 'MAYBE', false FROM p WHERE d = 16
  UNION ALL SELECT profile_id, CASE WHEN d = 18 THEN 'S1' ELSE 'S2' END, unnest(['HI', 'LO']), unnest(['HI', 'LO']), false FROM p WHERE d <> 21)""")
def d10(spark, sf_dir):
    return profiles.answers(parsed(spark, sf_dir)).drop("revision")


@query("d11_value_codes", f"""WITH {PART} SELECT profile_id, 'A1' AS test_code, 'POS' AS answer, n - 1 AS ord, ['urn:a', 'urn:b'][n] AS system, 'P' || n AS code, CASE WHEN n = 2 THEN 'yes' END AS display
FROM p, (VALUES (1), (2)) t(n)""")
def d11(spark, sf_dir):
    return profiles.value_codes(parsed(spark, sf_dir)).drop("revision", "sub_identity")


@query("d12_test_codings", f"""WITH {PART} SELECT profile_id, second AS test_code, system, code, CAST(NULL AS VARCHAR) AS display FROM (
  SELECT profile_id, second, 'http://loinc.org' AS system, '2000-2' AS code FROM p UNION ALL SELECT profile_id, second, 'urn:local', 'L1' FROM p
  UNION ALL SELECT profile_id, second, 'http://loinc.org', '2000-3' FROM p WHERE d = 10 UNION ALL SELECT profile_id, second, 'http://loinc.org', 'x1' FROM p WHERE d = 11)""")
def d12(spark, sf_dir):
    return profiles.codings(parsed(spark, sf_dir)).drop("revision", "sub_identity")


@query("d13_sample_flags", f"""WITH {PART} SELECT profile_id, code, name, 'T' AS raised_value FROM (SELECT profile_id, 'FL' AS code, 'Flag' AS name FROM p
  UNION ALL SELECT profile_id, 'A1', 'a' FROM p WHERE d = 22 UNION ALL SELECT profile_id, 'GX', NULL FROM p WHERE d = 23)""")
def d13(spark, sf_dir):
    return profiles.sample_flags(parsed(spark, sf_dir)).drop("revision")


@query("d14_recognition_rules", f"""WITH {PART} SELECT profile_id, 'NONE' AS mode, CAST(NULL AS INTEGER) AS ord, NULL AS rule_key, NULL AS rule_type, NULL AS target_field, NULL AS operand, NULL AS control_level FROM p WHERE k % 5 = 0
UNION ALL SELECT profile_id, 'RULES', 0, 'zeta', 'SPECIMEN_ID_PATTERN', NULL, CASE WHEN k % 9 = 0 THEN 'Q[(' ELSE 'QC\\d+' END, NULL FROM p WHERE k % 5 > 1
UNION ALL SELECT profile_id, 'RULES', 1, 'alpha', 'FIELD_EQUALS', 'O.12', 'Q', 'L' || (k % 3) FROM p WHERE k % 5 > 1""")
def d14(spark, sf_dir):
    return profiles.recognition_rules(parsed(spark, sf_dir)).drop("revision")


@query("d15_part_references", f"""WITH {PART} SELECT profile_id, 'testCode' AS part, 'R' AS segment, 3 AS field, 4 AS component, true AS valid FROM p
UNION ALL SELECT profile_id, 'unit', 'R', 5, 0, true FROM p UNION ALL SELECT profile_id, 'call', CASE WHEN k % 7 > 0 THEN 'R' END, CASE WHEN k % 7 > 0 THEN 4 END, CASE WHEN k % 7 > 0 THEN 1 END, k % 7 > 0 FROM p""")
def d15(spark, sf_dir):
    return profiles.part_references(parsed(spark, sf_dir)).select("profile_id", "part", "segment", "field", "component", "valid")


def small_documents(spark, sf_dir):
    k = F.col("p_partkey")
    body = F.concat(F.lit('{ "b" : [1, {"z": null, "y": "é"}], "fingerprint": "old", "a" : "'), "p_name", F.lit('", "n": '), "p_size", F.lit(" }"))
    return tb.table(spark, sf_dir, "part").select(
        tb.text("p", k % 500).alias("profile_id"), (F.floor(k / 500) + 1).cast("int").alias("revision"), body.alias("body"),
        F.concat(F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.lit("  "), F.floor(k / 4)).alias("display_name"))


_CANON = """'sha256:' || sha256('{"a":"' || p_name || '","b":[1,{"y":"é","z":null}],"n":' || p_size || '}')"""


@query("d16_fingerprint", f"SELECT 'p' || (p_partkey % 500) AS profile_id, CAST(p_partkey // 500 + 1 AS INTEGER) AS revision, {_CANON} AS fingerprint FROM part")
def d16(spark, sf_dir):
    return small_documents(spark, sf_dir).select("profile_id", "revision", fingerprint.fingerprint(F.col("body")).alias("fingerprint"))


@query("d17_latest_revision", "SELECT 'p' || (p_partkey % 500) AS profile_id, CAST(max(p_partkey // 500) + 1 AS INTEGER) AS revision FROM part GROUP BY 1")
def d17(spark, sf_dir):
    return profiles.latest(small_documents(spark, sf_dir)).select("profile_id", "revision")


@query("d18_revision_history", """SELECT 'p' || (p_partkey % 500) AS profile_id, CAST(p_partkey // 500 + 1 AS INTEGER) AS revision,
  CAST(row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_partkey) AS INTEGER) AS position FROM part""")
def d18(spark, sf_dir):
    return profiles.revision_history(small_documents(spark, sf_dir))


@query("d18_duplicate_revision", "SELECT 'p' || (l_partkey % 300) AS profile_id, l_linenumber AS revision, CAST(count(*) AS BIGINT) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def d18b(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "lineitem").select(tb.text("p", F.col("l_partkey") % 300).alias("profile_id"), F.col("l_linenumber").alias("revision"))
    return profiles.revision_issues(rows)


@query("d19_catalog_fingerprint", f"""WITH l AS (SELECT 'p' || (p_partkey % 500) AS profile_id, max(p_partkey // 500) + 1 AS revision, arg_max({_CANON}, p_partkey) AS fp FROM part GROUP BY 1),
b AS (SELECT substr(sha256(profile_id), 1, 3) AS bucket, sha256(string_agg(profile_id || chr(10) || revision || chr(10) || fp, chr(10) ORDER BY profile_id || chr(10) || revision || chr(10) || fp)) AS h, count(*) AS n FROM l GROUP BY 1)
SELECT 'sha256:' || sha256(string_agg(bucket || h, chr(10) ORDER BY bucket || h)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_profiles FROM b""")
def d19(spark, sf_dir):
    rows = profiles.latest(small_documents(spark, sf_dir)).withColumn("fingerprint", fingerprint.fingerprint(F.col("body")))
    return fingerprint.catalog_fingerprint(rows)


@query("d20_duplicate_names", """WITH k AS (SELECT DISTINCT 'p' || (p_partkey % 500) AS profile_id, lower(p_name) || ' ' || (p_partkey // 4) AS name_key FROM part)
SELECT profile_id, name_key, n_profiles FROM (SELECT *, count(*) OVER (PARTITION BY name_key) AS n_profiles FROM k) WHERE n_profiles > 1""")
def d20(spark, sf_dir):
    return profiles.duplicate_names(small_documents(spark, sf_dir)).select("profile_id", "name_key", "n_profiles")


@query("d21_folded_codings", f"""WITH {PART} SELECT profile_id, second AS test_code, system, code, display FROM (SELECT profile_id, second, 'urn:local' AS system, 'L1' AS code, 'again' AS display FROM p
  UNION ALL SELECT profile_id, second, 'http://loinc.org', '2000-2', NULL FROM p UNION ALL SELECT profile_id, second, 'http://loinc.org', '2000-3', NULL FROM p WHERE d = 10
  UNION ALL SELECT profile_id, second, 'http://loinc.org', 'x1', NULL FROM p WHERE d = 11)""")
def d21(spark, sf_dir):
    return profiles.folded_codings(parsed(spark, sf_dir)).drop("revision")


@query("d22_column_mapping", f"""WITH {PART} SELECT profile_id, n - 1 AS ord, ['Sample', 'Test', 'Val', 'Ct'][n] AS header, ['sampleId', 'testCode', 'result', 'ctValue'][n] AS field
FROM p, (VALUES (1), (2), (3), (4)) t(n) WHERE n < 4 OR d <> 25""")
def d22(spark, sf_dir):
    return profiles.column_mappings(parsed(spark, sf_dir)).drop("revision")


@query("d23_test_code_values", f"""WITH {PART} SELECT profile_id, raw, test_code, sub_identity FROM (SELECT profile_id, 'one' AS raw, 'A1' AS test_code, NULL AS sub_identity FROM p
  UNION ALL SELECT profile_id, 'two', 'A1', 'S1' FROM p UNION ALL SELECT profile_id, 'bad', 'NOPE', NULL FROM p WHERE d = 27 UNION ALL SELECT profile_id, 'worse', 'A1', 'S9' FROM p WHERE d = 28)""")
def d23(spark, sf_dir):
    return profiles.test_code_values(parsed(spark, sf_dir)).drop("revision")


@query("d24_file_test_code", f"""WITH {PART} SELECT profile_id, CASE WHEN k % 3 = 1 THEN 'A1' END AS code, CASE WHEN k % 3 = 2 THEN 'not_declared' END AS error FROM p""")
def d24(spark, sf_dir):
    k = F.substring("profile_id", 2, 20).cast("long")
    chosen = F.when(k % 3 == 1, "A1").when(k % 3 == 2, "ZZ")
    return parsed(spark, sf_dir).select("profile_id", profiles.file_test_code(F.col("doc"), chosen).alias("c")).select("profile_id", "c.*")


def value_requests(spark, sf_dir):
    k = F.col("s_suppkey")
    m = F.create_map
    lit = F.lit
    return tb.table(spark, sf_dir, "supplier").select(
        tb.text("c", k).alias("connection_id"), m(lit("transport"), lit("TCP/IP"), lit("connectionRole"), lit("SERVER"), lit("skipRows"), lit("2")).alias("defaults"),
        F.when(k % 3 > 0, m(lit("host"), tb.text("10.0.0.", k), lit("connectionRole"), lit("SERVER"), lit("port"), lit("99"), lit("gone"), lit("x"), lit("codeOverrides"), lit("{}"))).alias("existing"),
        F.when(k % 2 == 0, m(lit("connectionRole"), lit("CLIENT"), lit("host"), lit("new"))).otherwise(m(lit("skipRows"), lit("5"))).alias("supplied"),
        F.array(*map(lit, ("transport", "connectionRole", "host", "port", "skipRows"))).alias("declared"))


@query("d25_effective_values", """SELECT 'c' || s_suppkey AS connection_id, CASE WHEN s_suppkey % 2 = 0 THEN 'CLIENT' ELSE 'SERVER' END AS role,
  CASE WHEN s_suppkey % 2 = 0 THEN 'new' WHEN s_suppkey % 3 > 0 THEN '10.0.0.' || s_suppkey END AS host, CASE WHEN s_suppkey % 2 = 0 THEN '2' ELSE '5' END AS skip,
  CAST(NULL AS VARCHAR) AS port, CASE WHEN s_suppkey % 3 > 0 THEN '{}' END AS overrides, CAST(NULL AS VARCHAR) AS gone FROM supplier""")
def d25(spark, sf_dir):
    rows = ops.effective_values(value_requests(spark, sf_dir))
    get = lambda key: F.try_element_at("values", F.lit(key))
    return rows.select("connection_id", get("connectionRole").alias("role"), get("host").alias("host"), get("skipRows").alias("skip"), get("port").alias("port"),
                       get("codeOverrides").alias("overrides"), get("gone").alias("gone"))


def saved_values(spark, sf_dir):
    k = F.col("s_suppkey")
    pairs = F.array(
        F.struct(F.lit("transport").alias("k"), F.when(k % 4 > 0, F.when(k % 4 == 1, "RS-232").otherwise("TCP/IP")).alias("v")),
        F.struct(F.lit("connectionRole").alias("k"), F.when(k % 3 == 0, "CLIENT").when(k % 3 == 1, "SERVER").otherwise(" ").alias("v")))
    values = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    return tb.table(spark, sf_dir, "supplier").select(tb.text("c", k).alias("connection_id"), tb.text("p", k).alias("profile_id"), F.lit(1).alias("revision"), values.alias("values"))


def with_missing(spark, sf_dir):
    rows = saved_values(spark, sf_dir).join(ops.pinned_fields(parsed(spark, sf_dir)), ["profile_id", "revision"])
    return ops.missing_required(rows)


# connectionRole shows unless the transport is RS-232 (or, with defect 2, an undeclared field differs: it always does);
# host shows when the role shows and is CLIENT.
MISSING = """miss AS (SELECT 'c' || s_suppkey AS connection_id, s_suppkey AS k, concat_ws(',',
  CASE WHEN role_shown AND s_suppkey % 3 = 2 THEN 'connectionRole' END, CASE WHEN role_shown AND s_suppkey % 3 = 0 THEN 'host' END, CASE WHEN s_suppkey % 4 = 0 THEN 'transport' END) AS missing
  FROM (SELECT *, s_suppkey % 4 <> 1 OR s_suppkey % 40 = 2 AS role_shown FROM supplier))"""


@query("d26_missing_required", f"WITH {MISSING} SELECT connection_id, missing FROM miss")
def d26(spark, sf_dir):
    return with_missing(spark, sf_dir).select("connection_id", F.array_join("missing", ",").alias("missing"))


@query("d27_value_checks", """SELECT 'c' || s_suppkey AS connection_id, ['port', 'transport', 'ghost', 'host', 'loop', 'transport', 'port'][s_suppkey % 8] AS key,
  ['port_range', 'choice', 'undeclared', 'null', 'type', 'type', 'port_range'][s_suppkey % 8] AS issue FROM supplier WHERE s_suppkey % 8 > 0""")
def d27(spark, sf_dir):
    k = F.col("s_suppkey")
    bad = F.element_at(F.array(*[F.struct(F.lit(a).alias("k"), F.lit(b).alias("v")) for a, b in (
        ("port", "70000"), ("transport", '"USB"'), ("ghost", '"x"'), ("host", "null"), ("loop", '"seven"'), ("transport", "3"), ("port", '"80"'))]),
        F.greatest(F.lit(1), (k % 8).cast("int")))
    values = F.when(k % 8 > 0, F.map_from_entries(F.array(bad))).otherwise(F.create_map(F.lit("port"), F.lit("2575"), F.lit("host"), F.lit('"h"'), F.lit("codeOverrides"), F.lit("{}")))
    descriptors = [("transport", "SELECT", ("TCP/IP", "RS-232")), ("host", "TEXT", ()), ("loop", "NUMBER", ())]
    as_array = F.array(*[F.struct(F.lit(n).alias("key"), F.lit(t).alias("input_kind"), F.array(*map(F.lit, c)).cast("array<string>").alias("choices")) for n, t, c in descriptors])
    # The port takes part as an undeclared field of instrument protocols, so it is declared here to be checked.
    as_array = F.concat(as_array, F.array(F.struct(F.lit("port").alias("key"), F.when(k % 8 == 7, "TEXT").otherwise("NUMBER").alias("input_kind"), F.array().cast("array<string>").alias("choices"))))
    rows = tb.table(spark, sf_dir, "supplier").select(tb.text("c", k).alias("connection_id"), values.alias("values"), as_array.alias("descriptors"), F.lit("ASTM").alias("protocol"))
    return ops.value_issues(rows)


@query("d28_active_connections", """SELECT 'c' || s_suppkey AS connection_id, 'FILE' AS expected_protocol, 2 AS n_tests, CAST(CASE WHEN s_suppkey % 5 > 1 THEN 2 ELSE 0 END AS INTEGER) AS n_rules,
  4 - (s_suppkey % 40 = 25)::INT AS n_columns FROM supplier""")
def d28(spark, sf_dir):
    rows = profiles.active_connections(parsed(spark, sf_dir), pt.connections(spark, sf_dir))
    n_tests = F.size(F.filter("definitions", lambda d: d["sub"] == ""))
    return rows.select("connection_id", "expected_protocol", n_tests.alias("n_tests"), F.size("rules").alias("n_rules"), F.size("column_mapping").alias("n_columns"))


@query("d29_config_upsert", """SELECT 'c' || c_custkey AS connection_id, CASE WHEN c_custkey % 5 = 0 THEN 'CREATED' WHEN c_custkey % 3 = 0 THEN 'CONFLICT' WHEN c_custkey % 2 = 0 THEN 'UNCHANGED' ELSE 'UPDATED' END AS result,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN 1 WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 1 THEN 8 ELSE 7 END AS INTEGER) AS revision FROM customer""")
def d29(spark, sf_dir):
    k = F.col("c_custkey")
    c = tb.table(spark, sf_dir, "customer")
    current = c.filter(k % 5 > 0).select(tb.text("c", k).alias("connection_id"), F.lit(7).alias("revision"), F.sha2("c_name", 256).alias("fingerprint"))
    requests = c.select(tb.text("c", k).alias("connection_id"), F.when(k % 3 == 0, 6).otherwise(7).alias("expected_revision"),
                        F.sha2(F.when(k % 2 == 0, F.col("c_name")).otherwise("changed"), 256).alias("fingerprint"))
    return ops.upserts(current, requests).select("connection_id", "result", "revision")


COMMANDS = """cmd AS (SELECT 'u' || user_id AS connection_id, 'k' || (event_id % 4000) AS command_id, event_id, ts, CASE event_type WHEN 'click' THEN 'ACTIVATE' WHEN 'view' THEN 'START_SETUP' ELSE 'DEACTIVATE' END AS action,
  event_id % 11 = 0 AS stale, event_id % 7 > 0 AS ready FROM events),
num AS (SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY ts, command_id) AS rn, ts > min(ts) OVER (PARTITION BY connection_id, command_id) AS repeated,
  CASE action WHEN 'ACTIVATE' THEN 'ROUTINE' WHEN 'START_SETUP' THEN 'SETUP' ELSE 'INACTIVE' END AS wanted FROM cmd),
fold AS (SELECT connection_id, 0::BIGINT AS rn, 'INACTIVE' AS st, 1 AS rev, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT connection_id FROM num)
  UNION ALL SELECT f.connection_id, m.rn, CASE WHEN m.stale OR m.repeated OR (m.action <> 'DEACTIVATE' AND NOT m.ready) THEN f.st ELSE m.wanted END,
    CASE WHEN m.stale OR m.repeated OR (m.action <> 'DEACTIVATE' AND NOT m.ready) OR m.wanted = f.st THEN f.rev ELSE f.rev + 1 END,
    CASE WHEN m.stale THEN 'CONFLICT' WHEN m.repeated THEN 'REPEATED' WHEN m.action <> 'DEACTIVATE' AND NOT m.ready THEN 'REJECTED' WHEN m.wanted = f.st THEN 'ALREADY_APPLIED' ELSE 'APPLIED' END
  FROM fold f JOIN num m ON m.connection_id = f.connection_id AND m.rn = f.rn + 1)"""


@query("d30_activation_history", f"WITH RECURSIVE {COMMANDS} SELECT m.event_id, f.outcome, f.rev AS runtime_revision FROM fold f JOIN num m USING (connection_id, rn)")
def d30(spark, sf_dir):
    e = tb.table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "click", "ACTIVATE").when(F.col("event_type") == "view", "START_SETUP").otherwise("DEACTIVATE")
    commands = e.select(tb.text("u", F.col("user_id")).alias("connection_id"), tb.text("k", F.col("event_id") % 4000).alias("command_id"), "event_id", F.col("ts").alias("at"), action.alias("action"),
                        F.when(F.col("event_id") % 11 == 0, 1).otherwise(2).alias("expected_revision"), F.lit(2).alias("config_revision"), (F.col("event_id") % 7 > 0).alias("ready"))
    return ops.activation_history(commands).select("event_id", "outcome", "runtime_revision")


def _check(name):
    def run(spark, sf_dir):
        return profile_checks.findings(parsed(spark, sf_dir), name).select("profile_id", "path")

    return run


def _one(defect, path):
    return f"SELECT profile_id, {path} AS path FROM p WHERE d = {defect}"


CHECKS = {
    "d31_field_keys": [(0, "'duplicate:token'"), (1, "'secret_default:token'"), (2, "'undeclared:connectionRole'")],
    "d32_visibility_cycle": [(3, "'cycle'")],
    "d33_value_order_columns": [(25, "'ctValue'")],
    "d34_code_values_declared": [(27, "'bad'"), (28, "'worse'")],
    "d35_record_kinds": [(22, "'flag_is_test:A1'"), (23, "'unnamed:GX'"), (24, "'name_of_no_flag:ZZ'")],
    "d36_file_glob": [(4, "'.txt'"), (26, "'.zip'")],
    "d37_identities": [(5, "'name:A1'"), (6, "'name:A1'")],
    "d38_result_descriptions": [(7, "'tests.A1:call_component'"), (8, "'tests.B1:hint'"), (9, "'tests.A1:result_type'")],
    "d39_loinc_codes": [(10, "'tests.B1:many'"), (11, "'tests.B1:many'"), (11, "'tests.B1:shape:x1'")],
    "d40_value_sets": [(12, "'tests.A1:failure_is_value:POS'"), (13, "'tests.A1:value_codes:MAYBE'"), (14, "'tests.A1:value_defaults:MAYBE'"),
                       (15, "'tests.A1:two_values:positif' || k"), (16, "'tests.A1:translations:MAYBE'")],
    "d41_component_rules": [(17, "'tests.A1:code:call'"), (18, "'tests.A1:sub_identity:S1'"), (19, "'tests.A1:call_has_sub_identity'"), (19, "'tests.A1:no_values:call'"),
                            (20, "'tests.A1:call_unknown'"), (21, "'tests.A1:no_values:hl'")],
    "d42_archive_rules": [(26, "'zip'"), (29, "'zip'"), (29, "'group:sampleId'"), (29, "'group:serial'")],
}
for _name, _found in CHECKS.items():
    query(_name, f"WITH {PART} " + " UNION ALL ".join(_one(*f) for f in _found))(_check(_name[:3].upper()))


@query("d42_broken_patterns", f"WITH {PART} SELECT profile_id, 'zeta' AS rule_key, 'Q[(' AS pattern FROM p WHERE k % 9 = 0 AND k % 5 > 1")
def d42b(spark, sf_dir):
    rules = profiles.recognition_rules(parsed(spark, sf_dir)).filter("mode = 'RULES'")
    return profile_checks.broken_patterns(rules).drop("revision")


@query("d43_listener_port", """SELECT port, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE s_suppkey % 4 WHEN 0 THEN 2575 WHEN 1 THEN 12001 WHEN 2 THEN 12011 END AS port FROM supplier) GROUP BY 1""")
def d43(spark, sf_dir):
    m = (F.col("s_suppkey") % 4 + 1).cast("int")
    protocol = F.element_at(F.array(*map(F.lit, ("HL7", "ASTM", "ASTM", "FILE"))), m)
    layer = F.element_at(F.array(*map(F.lit, ("", "LIS01_A", "E1381_95", ""))), m)
    return tb.table(spark, sf_dir, "supplier").groupBy(ops.listener_port(protocol, layer).alias("port")).agg(F.count("*").alias("n"))


@query("d44_refused_activation", """WITH sim AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey // 4 = b.s_suppkey // 4 AND a.s_suppkey < b.s_suppkey
  WHERE b.s_suppkey % 4 < 3 AND NOT (a.s_suppkey % 16 = 0 AND b.s_suppkey % 16 = 1))
SELECT DISTINCT printf('s%08d', b) AS connection_id FROM sim WHERE a % 4 = 0""")
def d44(spark, sf_dir):
    from .attribution_queries import similar

    rows = similar(spark, sf_dir)
    number = F.substring("connection_id", 2, 8).cast("int")
    return ops.refused_activations(rows.filter(number % 4 > 0), rows.filter(number % 4 == 0)).select("connection_id")
