"""HL7 segment queries (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.joins import join_dimension
from ..functions.times import hl7_time
from ..operators import hl7
from . import testbed as tb
from .registry import query

HL7 = tb.HL7_SQL
READ_COLUMNS = ("connection_id", "hl7_parts", "decimal_separator", "specimen_position", "selection_mode",
                "selection_target", "excluded", "flag_names", "flag_raised")


def group_rows(spark, sf_dir, *carry):
    return hl7.patient_groups(tb.hl7_messages(spark, sf_dir), "connection_id", *carry)


def observation_rows(spark, sf_dir):
    return hl7.observations(group_rows(spark, sf_dir), "connection_id")


def with_reading(rows, spark, sf_dir):
    return join_dimension(rows, tb.message_readings(spark, sf_dir).select(*READ_COLUMNS), ["connection_id"])


def received_rows(spark, sf_dir):
    """Observations the profile receives, with the flag each one reports (if any)."""
    rows = with_reading(observation_rows(spark, sf_dir), spark, sf_dir)
    target = hl7.read(F.col("selection_target"))
    return hl7.flag_reading(rows.filter(hl7.received(target, F.col("selection_mode"), F.col("excluded"))))


def parted_rows(spark, sf_dir):
    return hl7.with_parts(received_rows(spark, sf_dir).filter(F.col("flag").isNull()))


@query("f01_segment_split", f"""WITH {HL7}
SELECT rec_type, CAST(sum(c) AS BIGINT) AS n FROM (
  SELECT 'MSH' AS rec_type, count(*) AS c FROM orders
  UNION ALL SELECT 'PID', count(*) FROM hl7_grp
  UNION ALL SELECT 'OBR', count_if(group_no = 2 OR o_orderkey % 7 <> 6) FROM hl7_grp
  UNION ALL SELECT 'OBX', count(*) FROM hl7_obs
  UNION ALL SELECT 'NTE', 2 * count(*) FROM orders
  UNION ALL SELECT 'ZXX', count(*) FROM orders UNION ALL SELECT 'PV2', count_if(o_orderkey % 5 = 1) FROM orders
  UNION ALL SELECT 'SPM', count_if(o_orderkey % 2 = 0) FROM orders) GROUP BY 1 HAVING sum(c) > 0""")
def f01(spark, sf_dir):
    return hl7.segments(tb.hl7_messages(spark, sf_dir)).groupBy("rec_type").agg(F.count("*").alias("n"))


@query("f02_patient_groups", f"WITH {HL7} SELECT message_id, CAST(n_groups AS INTEGER) AS n_groups, group_no FROM hl7_grp")
def f02(spark, sf_dir):
    return group_rows(spark, sf_dir).select("message_id", "n_groups", "group_no")


_TIME = "strftime(o_orderdate, '%Y%m%d%H%M%S')"
_HEADER = f"""'MSH|^~\\&|APP' || k || '|FAC|||' || {_TIME} || '||ORU^R01|' || o_orderkey || '|'
  || CASE WHEN o_orderpriority LIKE '1%' THEN 'Q' ELSE 'P' END || '|2.3.1'"""
_GROUP1 = f"""concat_ws(chr(13), {_HEADER}, 'PID|1|||PID' || o_custkey || '||FAM' || o_custkey || '^GIV',
  CASE WHEN o_orderkey % 7 <> 6 THEN 'OBR|1|P' || o_orderkey || '|' || CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE 'F' || o_orderkey END END,
  'ZXX|1|z' || (o_orderkey % 3), CASE WHEN o_orderkey % 5 = 1 THEN 'PV2|1||ward^x' END,
  'OBX|1|NM|TOT^Total^L||' || CAST(o_totalprice AS DECIMAL(18,2)) || '|USD|||0-100000|N~ H||F|||' || {_TIME} || '.5+0230||op^x|||I' || k,
  'NTE|1|||note ' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'SPM|1|||||SER' || k END,
  'OBX|2|SN|RATIO^Ratio||' || ['>^100', '^1^:^128', '=^5.5', '<=^7'][o_orderkey % 4 + 1] || '|x||||||P', 'NTE|1|||',
  'OBX|3|ST|CALL^Call||' || CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'POS' ELSE 'NEGATIF' END || '|u|sub',
  'OBX|4|IS|FLG^Warned||' || CASE WHEN o_orderkey % 3 = 0 THEN 'T' ELSE 'F' END, 'OBX|5|NM|MODE7^Mode||1')"""
_GROUP2 = f"""{_HEADER} || chr(13) || 'PID|2|||PIDB' || o_custkey
  || chr(13) || 'OBR|2||G' || o_orderkey || chr(13) || 'OBX|1|NM|TOT^Total||1.50|USD'"""


@query("f03_group_hash", f"""WITH {HL7}
SELECT message_id, group_no, sha256(CASE WHEN group_no = 2 THEN {_GROUP2} ELSE {_GROUP1} END) AS content_hash FROM hl7_grp""")
def f03(spark, sf_dir):
    return group_rows(spark, sf_dir).select("message_id", "group_no", "content_hash")


@query("f04_delimiters", f"""SELECT '|' AS fs, '^' AS cs, '~' AS rs, '\\&' AS declared, '&' AS ss,
  CAST(count(*) AS BIGINT) AS n FROM (SELECT 1 FROM orders UNION ALL SELECT 1 FROM orders WHERE o_orderkey % 4 = 0)""")
def f04(spark, sf_dir):
    header = F.substring_index("raw_text", "\r", 1)
    groups = hl7.sectioned(group_rows(spark, sf_dir))
    declared = tb.hl7_messages(spark, sf_dir).select("message_id", F.substring(header, 7, 2).alias("declared"))
    return groups.join(declared, "message_id").groupBy("fs", "cs", "rs", "ss", "declared").agg(F.count("*").alias("n"))


def _path(segment, field, component=0, sub=0):
    return F.struct(F.lit(segment).alias("segment"), F.lit(field).alias("field"), F.lit(component).alias("component"),
                    F.lit(sub).alias("sub"))


@query("f05_field_paths", f"""WITH {HL7}
SELECT message_id, group_no, n - 1 AS obs_no, '|' AS msh1, '^~\\&' AS msh2, 'ORU' AS msh9, test_code AS code,
  CASE WHEN n = 1 AND group_no = 1 THEN 'N~ H' ELSE '' END AS flags,
  CASE WHEN n = 1 AND group_no = 1 THEN 'op' ELSE '' END AS operator
FROM hl7_obs""")
def f05(spark, sf_dir):
    paths = {"msh1": ("MSH", 1), "msh2": ("MSH", 2), "msh9": ("MSH", 9, 1, 1), "code": ("OBX", 3, 1),
             "flags": ("OBX", 10), "operator": ("OBX", 17, 1)}
    return observation_rows(spark, sf_dir).select(
        "message_id", "group_no", "obs_no", *[hl7.read(_path(*p)).alias(n) for n, p in paths.items()])


@query("f06_segment_context", f"""WITH {HL7}
SELECT message_id, group_no, n - 1 AS obs_no, specimen_id,
  CASE WHEN group_no = 2 THEN 'PIDB' ELSE 'PID' END || o_custkey AS patient,
  CASE WHEN group_no = 1 AND n > 1 AND o_orderkey % 2 = 0 THEN 'SER' || k ELSE '' END AS specimen,
  CASE WHEN group_no = 1 AND n = 2 THEN 'note ' || o_orderkey ELSE '' END AS note FROM hl7_obs""")
def f06(spark, sf_dir):
    return observation_rows(spark, sf_dir).select(
        "message_id", "group_no", "obs_no", "specimen_id", hl7.read(_path("PID", 4)).alias("patient"),
        hl7.read(_path("SPM", 6)).alias("specimen"), hl7.read(_path("NTE", 4)).alias("note"))


@query("f07_following_specimen", f"""WITH {HL7}
SELECT message_id, group_no, n - 1 AS obs_no,
  CASE WHEN group_no = 1 AND o_orderkey % 2 = 0 AND (CASE WHEN k % 2 = 0 THEN n > 1 ELSE n = 1 END)
       THEN 'SER' || k ELSE '' END AS specimen FROM hl7_obs""")
def f07(spark, sf_dir):
    rows = with_reading(observation_rows(spark, sf_dir), spark, sf_dir)
    bound = hl7.specimen_lines(F.col("specimen_position"))
    return rows.select("message_id", "group_no", "obs_no", hl7.read(_path("SPM", 6), columns=bound).alias("specimen"))


@query("f08_accession", f"""WITH {HL7}
SELECT message_id, group_no, coalesce(specimen_id, 'HL7-UNKNOWN') AS accession FROM hl7_grp""")
def f08(spark, sf_dir):
    return hl7.headers(group_rows(spark, sf_dir)).select("message_id", "group_no", "accession")


@query("f09_record_exclusion", f"""WITH {HL7}
SELECT test_code, CAST(count(*) AS BIGINT) AS n FROM hl7_obs WHERE test_code <> 'MODE7' GROUP BY 1""")
def f09(spark, sf_dir):
    code = hl7.read(_path("OBX", 3, 1))
    return received_rows(spark, sf_dir).groupBy(code.alias("test_code")).agg(F.count("*").alias("n"))


@query("f10_established_reading", f"""WITH {HL7}
SELECT message_id, group_no, n - 1 AS obs_no, accession, test_code, value AS raw_value, n IN (1, 5) AS is_numeric,
  CASE WHEN n = 1 THEN 'USD' END AS units FROM hl7_obs WHERE value IS NOT NULL""")
def f10(spark, sf_dir):
    return hl7.established(observation_rows(spark, sf_dir)).select(
        "message_id", "group_no", "obs_no", "accession", "test_code", "raw_value", "is_numeric", "units")


@query("f11_parts_reading", f"""WITH {HL7}
SELECT message_id, group_no, n - 1 AS obs_no, test_code, CASE WHEN n = 3 THEN 'sub' ELSE '' END AS sub_identity,
  CASE WHEN n = 2 AND o_orderkey % 4 = 1 THEN value WHEN n = 3 THEN value END AS call,
  CASE n WHEN 1 THEN value WHEN 2 THEN ['100', NULL, '5.5', '7'][o_orderkey % 4 + 1] END AS number,
  CASE WHEN n = 1 AND group_no = 1 THEN '0-100000' END AS range_text,
  CASE WHEN group_no = 2 THEN NULL WHEN n = 1 THEN 'F' WHEN n = 2 THEN 'P' END AS status,
  CASE WHEN n = 1 AND group_no = 1 THEN 'op' END AS operator,
  CASE WHEN n = 1 AND group_no = 1 THEN 'I' || k END AS instrument,
  CASE WHEN n = 1 THEN 'USD' WHEN n = 2 AND o_orderkey % 4 <> 1 THEN 'x' END AS units,
  CASE WHEN n = 1 AND group_no = 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:30' END AS effective
FROM hl7_obs WHERE n <= 3 AND value IS NOT NULL""")
def f11(spark, sf_dir):
    return parted_rows(spark, sf_dir).select(
        "message_id", "group_no", "obs_no", "test_code", "sub_identity", "call", "number", "range_text", "status",
        "operator", "instrument", "units", "effective")


@query("f12_structured_numeric", f"""WITH {HL7}
SELECT comparator, number, raw_value, CAST(count(*) AS BIGINT) AS n FROM (SELECT
  ['>', NULL, NULL, '<='][o_orderkey % 4 + 1] AS comparator, ['100', NULL, '5.5', '7'][o_orderkey % 4 + 1] AS number,
  ['100', '^1^:^128', '5.5', '7'][o_orderkey % 4 + 1] AS raw_value FROM hl7_obs WHERE n = 2) GROUP BY ALL""")
def f12(spark, sf_dir):
    return parted_rows(spark, sf_dir).filter("test_code = 'RATIO'").groupBy("comparator", "number", "raw_value").agg(
        F.count("*").alias("n"))


@query("f13_flag_repetitions", f"""WITH {HL7}
SELECT flags, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN n = 1 AND group_no = 1 THEN 'N,H' ELSE '' END AS flags FROM hl7_obs
  WHERE n <= 3 AND value IS NOT NULL) GROUP BY 1""")
def f13(spark, sf_dir):
    return parted_rows(spark, sf_dir).groupBy(F.array_join("flags", ",").alias("flags")).agg(F.count("*").alias("n"))


@query("f14_patient", f"""WITH {HL7}
SELECT message_id, group_no, CASE WHEN group_no = 1 THEN 'PID' ELSE 'PIDB' END || o_custkey AS identifier,
  CASE WHEN group_no = 1 THEN 'FAM' || o_custkey END AS family, CASE WHEN group_no = 1 THEN 'GIV' END AS given
FROM hl7_grp""")
def f14(spark, sf_dir):
    rows = with_reading(hl7.headers(group_rows(spark, sf_dir), "connection_id"), spark, sf_dir)
    who = hl7.patient(F.col("hl7_parts.patientId"), F.col("hl7_parts.patientName"))
    return rows.select("message_id", "group_no", who.alias("p")).select("message_id", "group_no", "p.*")


@query("f15_specimen_descriptor", f"""WITH {HL7}
SELECT message_id, group_no, CASE WHEN group_no = 1 AND o_orderkey % 2 = 0 THEN 'SER' || k END AS descriptor
FROM hl7_grp""")
def f15(spark, sf_dir):
    rows = with_reading(hl7.headers(group_rows(spark, sf_dir), "connection_id"), spark, sf_dir)
    d = hl7.specimen_descriptor(F.col("hl7_parts.specimenDescriptor"))
    return rows.select("message_id", "group_no", d.alias("descriptor"))


@query("f16_note_attach", f"""WITH {HL7}
SELECT message_id, group_no, n - 1 AS obs_no,
  CASE WHEN n = 1 AND group_no = 1 THEN 'note ' || o_orderkey ELSE '' END AS notes
FROM hl7_obs WHERE n <= 3 AND value IS NOT NULL""")
def f16(spark, sf_dir):
    notes = hl7.notes(F.col("hl7_parts.note"), F.col("specimen_position"))
    return parted_rows(spark, sf_dir).select("message_id", "group_no", "obs_no", F.array_join(notes, "; ").alias("notes"))


@query("f17_sample_flags", f"""WITH {HL7}
SELECT message_id, 'FLG' AS code, 'Warned' AS name, value FROM hl7_obs WHERE n = 4 AND value = 'T'""")
def f17(spark, sf_dir):
    return received_rows(spark, sf_dir).filter("flag.raised").select(
        "message_id", "flag.code", "flag.name", "flag.value")


@query("f18_observation_time", """SELECT raw, effective, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT strftime(o_orderdate, '%Y%m%d') || s AS raw, CASE
    WHEN s = '' THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN s = '07' THEN strftime(o_orderdate, '%Y-%m-%dT07:00:00Z')
    WHEN s = '0709.25' THEN strftime(o_orderdate, '%Y-%m-%dT07:09:00Z')
    WHEN s = '070911-0530' THEN strftime(o_orderdate, '%Y-%m-%dT07:09:11-05:30') END AS effective
  FROM orders, (VALUES (''), ('07'), ('0709.25'), ('070911-0530'), ('2509'), ('x')) t(s)) GROUP BY 1, 2""")
def f18(spark, sf_dir):
    tails = F.array(*map(F.lit, ("", "07", "0709.25", "070911-0530", "2509", "x")))
    rows = tb.table(spark, sf_dir, "orders").select("o_orderdate", F.explode(tails).alias("tail"))
    rows = rows.select(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), "tail").alias("raw"))
    return rows.groupBy("raw").agg(F.count("*").alias("n")).select("raw", hl7_time(F.col("raw")).alias("effective"), "n")
