"""ASTM record queries (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.joins import join_dimension
from ..operators import astm
from . import testbed as tb
from .registry import query

ASTM = tb.ASTM_SQL
READ_COLUMNS = ("connection_id", "parts", "decimal_separator", "flag_names", "flag_raised")


def result_rows(spark, sf_dir, **carry):
    return astm.result_records(tb.astm_messages(spark, sf_dir).withColumns(carry), "connection_id", *carry)


def parted_rows(spark, sf_dir, **carry):
    """Result records read by their profile's declared parts, flag records left out."""
    readings = tb.message_readings(spark, sf_dir).select(*READ_COLUMNS)
    rows = astm.flag_reading(join_dimension(result_rows(spark, sf_dir, **carry), readings, ["connection_id"]))
    return astm.with_parts(rows.filter(F.col("flag").isNull()))


@query("e01_record_split", f"""WITH {ASTM}
SELECT rec_type, CAST(sum(c) AS BIGINT) AS n, max(last_seq) AS last_seq FROM (
  SELECT 'H' AS rec_type, count(*) AS c, 0 AS last_seq FROM astm_msg
  UNION ALL SELECT 'P', count(*), 1 FROM astm_msg
  UNION ALL SELECT 'O', count(*) + count_if(l_linenumber % 3 = 0),
     max(CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_returnflag = 'R' THEN 6 ELSE 5 END ELSE 2 END) FROM astm_msg
  UNION ALL SELECT 'R', 5 * count(*), max(7 + (l_linenumber % 3 = 0)::INT + (l_returnflag = 'R')::INT) FROM astm_msg
  UNION ALL SELECT 'C', count_if(l_returnflag = 'R'), 4 FROM astm_msg
  UNION ALL SELECT 'L', count(*), max(8 + (l_linenumber % 3 = 0)::INT + (l_returnflag = 'R')::INT) FROM astm_msg)
GROUP BY rec_type""")
def e01(spark, sf_dir):
    return astm.records(tb.astm_messages(spark, sf_dir)).groupBy("rec_type").agg(
        F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query("e02_field_read", f"""WITH {ASTM}
SELECT test_code, analyte, CAST(count(*) AS BIGINT) AS n, min(value) AS low, max(instrument) AS instrument FROM (
  SELECT test_code, CASE WHEN n = 3 THEN 'AN' ELSE '' END AS analyte,
    CASE WHEN n IN (1, 2, 3) THEN coalesce(value, '') ELSE '' END AS value,
    CASE WHEN n = 1 THEN 'I' || k ELSE '' END AS instrument FROM astm_rec) GROUP BY 1, 2""")
def e02(spark, sf_dir):
    readings = tb.message_readings(spark, sf_dir).select("connection_id", "parts")
    rows = join_dimension(result_rows(spark, sf_dir), readings, ["connection_id"])
    get = lambda p: astm.field(F.col("fields"), F.col(f"parts.{p}"))
    return rows.select(get("testCode").alias("test_code"), get("analyte").alias("analyte"), get("number").alias("v"),
                       get("instrument").alias("i")).groupBy("test_code", "analyte").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("i").alias("instrument"))


@query("e03_accession", f"""WITH {ASTM}
SELECT accession, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'S' || spec AS accession FROM astm_msg
  UNION ALL SELECT CASE WHEN l_linenumber = 3 THEN 'T' || spec END FROM astm_msg WHERE l_linenumber % 3 = 0)
GROUP BY 1""")
def e03(spark, sf_dir):
    orders = astm.records(tb.astm_messages(spark, sf_dir)).filter("rec_type = 'O'")
    return orders.select(astm.accession(F.col("line")).alias("accession")).groupBy("accession").agg(
        F.count("*").alias("n"))


@query("e04_order_context", f"""WITH {ASTM}
SELECT message_id, n - 1 AS record_no, specimen_id FROM astm_rec""")
def e04(spark, sf_dir):
    return result_rows(spark, sf_dir).select("message_id", "record_no", "specimen_id")


@query("e05_message_accession", f"WITH {ASTM} SELECT message_id, accession FROM astm_msg")
def e05(spark, sf_dir):
    return astm.headers(tb.astm_messages(spark, sf_dir)).select("message_id", "accession")


@query("e06_record_selection", f"""WITH {ASTM}
SELECT mode, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN k % 2 = 0 THEN 'ALL' ELSE 'FIELD_NON_BLANK' END AS mode, n FROM astm_rec
  WHERE k % 2 = 0 OR n = 3) GROUP BY 1""")
def e06(spark, sf_dir):
    rows = result_rows(spark, sf_dir)
    k = F.split_part("connection_id", F.lit("-"), F.lit(2)).cast("int")
    mode = F.when(k % 2 == 0, "ALL").otherwise("FIELD_NON_BLANK")
    return rows.withColumn("mode", mode).filter(
        astm.selected(F.col("fields"), F.col("mode"), F.lit(3), F.lit(7))
    ).groupBy("mode").agg(F.count("*").alias("n"))


@query("e07_established_reading", f"""WITH {ASTM}
SELECT message_id, n - 1 AS record_no, accession, specimen_id, test_code, value AS raw_value, n <= 3 AS is_numeric,
  CASE n WHEN 1 THEN 'U' WHEN 2 THEN 'USD' WHEN 3 THEN 'pct' END AS units,
  CASE n WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN '2024-02-29' END AS effective
FROM astm_res""")
def e07(spark, sf_dir):
    return astm.established(result_rows(spark, sf_dir)).select(
        "message_id", "record_no", "accession", "specimen_id", "test_code", "raw_value", "is_numeric", "units",
        "effective")


@query("e08_parts_reading", f"""WITH {ASTM}
SELECT message_id, n - 1 AS record_no, test_code, value AS raw_value,
  CASE WHEN n = 4 THEN value END AS call, CASE WHEN n <= 3 THEN value END AS number,
  CASE n WHEN 1 THEN 'U' WHEN 2 THEN 'USD' WHEN 3 THEN 'pct' END AS units,
  CASE WHEN n = 1 THEN '1.00 to 50.00' WHEN n = 4 THEN '40.00 to 90.00' END AS range_text,
  CASE WHEN n = 1 THEN l_linestatus END AS status, CASE WHEN n = 1 THEN 'I' || k END AS instrument,
  CASE WHEN n = 1 AND l_returnflag <> 'R' THEN l_returnflag ELSE '' END AS flags,
  CASE WHEN n = 2 THEN 'Assay P' END AS assay_name, CASE WHEN n = 2 THEN '2' END AS assay_version
FROM astm_res WHERE n <= 4""")
def e08(spark, sf_dir):
    return parted_rows(spark, sf_dir).select(
        "message_id", "record_no", "test_code", "raw_value", "call", "number", "units", "range_text", "status",
        "instrument", F.array_join("flags", ",").alias("flags"), "assay_name", "assay_version")


@query("e09_sub_identity", f"""WITH {ASTM}
SELECT test_code, CASE WHEN n = 3 THEN 'AN&Ct' ELSE '' END AS sub_identity, CAST(count(*) AS BIGINT) AS n
FROM astm_res WHERE n <= 4 GROUP BY 1, 2""")
def e09(spark, sf_dir):
    return parted_rows(spark, sf_dir).groupBy("test_code", "sub_identity").agg(F.count("*").alias("n"))


@query("e10_off_scale", f"""WITH {ASTM}
SELECT message_id, n - 1 AS record_no, CASE WHEN n = 1 THEN '>' ELSE '<' END AS comparator,
  CASE WHEN n = 4 THEN '40.00' END AS lim FROM astm_res
WHERE (n = 1 AND l_returnflag = 'R') OR (n = 4 AND cents = 0)""")
def e10(spark, sf_dir):
    return parted_rows(spark, sf_dir).filter("comparator IS NOT NULL").select(
        "message_id", "record_no", "comparator", "lim")


@query("e11_operator_none", f"""WITH {ASTM}
SELECT operator, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN n = 1 AND l_linenumber % 2 = 1 THEN 'op' || l_suppkey END AS operator FROM astm_res WHERE n <= 4)
GROUP BY 1""")
def e11(spark, sf_dir):
    return parted_rows(spark, sf_dir).groupBy("operator").agg(F.count("*").alias("n"))


@query("e12_test_time", f"""WITH {ASTM}
SELECT effective, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE n WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN '2024-02-29' END AS effective
  FROM astm_res WHERE n <= 4) GROUP BY 1""")
def e12(spark, sf_dir):
    return parted_rows(spark, sf_dir).groupBy("effective").agg(F.count("*").alias("n"))


def headed(spark, sf_dir):
    readings = tb.message_readings(spark, sf_dir).select("connection_id", "parts")
    return join_dimension(astm.headers(tb.astm_messages(spark, sf_dir), "connection_id"), readings, ["connection_id"])


@query("e13_patient", f"""WITH {ASTM}
SELECT message_id, 'PT' || l_orderkey AS identifier, 'FAM' || (l_partkey % 7) AS family, 'GIV' AS given FROM astm_msg""")
def e13(spark, sf_dir):
    who = astm.patient(F.col("last_patient"), F.col("parts.patientId"), F.col("parts.patientName"))
    return headed(spark, sf_dir).select("message_id", who.alias("p")).select("message_id", "p.*")


@query("e14_specimen_descriptor", f"""WITH {ASTM}
SELECT descriptor, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN l_linenumber % 3 <> 0 THEN 'blood' || k END AS descriptor FROM astm_msg) GROUP BY 1""")
def e14(spark, sf_dir):
    d = astm.specimen_descriptor(F.col("last_order"), F.col("parts.specimenDescriptor"))
    return headed(spark, sf_dir).select(d.alias("descriptor")).groupBy("descriptor").agg(F.count("*").alias("n"))


NOTE = """CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'plain ' || l_partkey
  WHEN l_returnflag = 'R' THEN 'E' || l_partkey || ' 2: Descr (Det) at ' || strftime(l_shipdate, '%Y-%m-%d') END"""


@query("e15_note_text", f"""WITH {ASTM}
SELECT note, CAST(count(*) AS BIGINT) AS n FROM (SELECT {NOTE} AS note FROM astm_msg) WHERE note IS NOT NULL
GROUP BY 1""")
def e15(spark, sf_dir):
    comments = astm.records(tb.astm_messages(spark, sf_dir)).filter("rec_type = 'C'")
    k = F.substring_index("message_id", ".", -1).cast("long") % tb.N_CONNECTIONS
    ref = F.struct(tb.by_layout(k, lambda at: F.lit(at["note"])).alias("field"), F.lit(0).alias("component"))
    return comments.select(astm.note_text(F.col("line"), ref).alias("note")).groupBy("note").agg(
        F.count("*").alias("n"))


@query("e16_note_attach", f"""WITH {ASTM}
SELECT message_id, n - 1 AS record_no, coalesce(CASE WHEN n = 1 THEN {NOTE} END, '') AS notes
FROM astm_res WHERE n <= 4""")
def e16(spark, sf_dir):
    return parted_rows(spark, sf_dir).select(
        "message_id", "record_no",
        F.array_join(astm.notes(F.col("following"), F.col("parts.note")), "; ").alias("notes"))


@query("e17_sample_flags", f"""WITH {ASTM}
SELECT DISTINCT message_id, accession, 'IC' AS code, 'Internal control ' || k AS name, 'BAD' AS value,
  4 AS first_record FROM astm_res WHERE n = 5 AND value = 'BAD'""")
def e17(spark, sf_dir):
    readings = tb.message_readings(spark, sf_dir).select(*READ_COLUMNS)
    rows = join_dimension(result_rows(spark, sf_dir), readings, ["connection_id"])
    return astm.raised_flags(astm.flag_reading(rows))


@query("e18_result_ordinal", f"""WITH {ASTM}
SELECT message_id, record_no, CAST(1 + (CASE WHEN record_no > 0 THEN 1 ELSE 0 END) + (CASE WHEN record_no > 1 THEN 1 ELSE 0 END)
   + (CASE WHEN record_no > 2 AND has3 THEN 1 ELSE 0 END) AS INTEGER) AS ordinal FROM (
  SELECT message_id, n - 1 AS record_no, l_discount > 0 AS has3 FROM astm_res WHERE n <= 4)""")
def e18(spark, sf_dir):
    return astm.numbered(parted_rows(spark, sf_dir, row=astm.message_row()), "row").select("message_id", "record_no", "ordinal")
