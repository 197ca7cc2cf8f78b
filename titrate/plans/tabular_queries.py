"""Tabular queries (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.joins import join_dimension
from ..operators import tabular
from . import testbed as tb
from .registry import query

CSV = tb.CSV_SQL


def files(spark, sf_dir):
    return tb.csv_files(spark, sf_dir).withColumn("content_hash", F.sha2("content", 256))


def file_readings(spark, sf_dir):
    return tb.message_readings(spark, sf_dir).filter("expected_protocol = 'FILE'")


def row_table(spark, sf_dir):
    """Data rows of every file with their semantic fields."""
    readings = file_readings(spark, sf_dir).select(*tabular.READING)
    rows = tabular.delimited_rows(join_dimension(files(spark, sf_dir), readings, ["connection_id"]), "connection_id")
    return join_dimension(tabular.semantic_fields(rows), readings, ["connection_id"])


def all_rows(spark, sf_dir):
    return tabular.delimited_results(files(spark, sf_dir), file_readings(spark, sf_dir))


def tabular_results(spark, sf_dir):
    return all_rows(spark, sf_dir).filter("flag IS NULL")


@query("g01_header_marker", f"WITH {CSV} SELECT DISTINCT path, 3 AS header_line FROM csv_row")
def g01(spark, sf_dir):
    readings = file_readings(spark, sf_dir).select("connection_id", "delimiter", "skip_rows", "layout")
    rows = join_dimension(files(spark, sf_dir), readings, ["connection_id"])
    at = tabular.header_line(tabular.lines(tabular.text_of(F.col("content"))), F.col("layout.header_marker"),
                             F.col("delimiter"), F.col("skip_rows"), F.col("layout.max_rows_to_scan"))
    return rows.select("path", at.alias("header_line"))


@query("g05_semantic_fields", f"""WITH {CSV}
SELECT path, n - 1 AS row_no, sample_id, raw_code AS code, units, qc_task,
  CASE WHEN n IN (1, 3, 4, 7) THEN value WHEN n = 5 THEN value END AS ct_value,
  CASE WHEN n = 1 THEN '33.1' WHEN n = 2 THEN value END AS result,
  CASE WHEN n = 2 THEN 'POS' END AS call FROM csv_row""")
def g05(spark, sf_dir):
    return row_table(spark, sf_dir).select(
        "path", "row_no", F.col("sampleId").alias("sample_id"), F.col("testCode").alias("code"), "units",
        F.col("qcTask").alias("qc_task"), "result", F.col("ctValue").alias("ct_value"),
        F.col("interpretation").alias("call"))


@query("g06_code_translation", f"""WITH {CSV}
SELECT raw_code, code, sub, CAST(count(*) AS BIGINT) AS n FROM (SELECT raw_code,
  CASE WHEN raw_code = 'chan2' THEN 'T2' ELSE raw_code END AS code, CASE WHEN raw_code = 'chan2' THEN 'two' END AS sub
  FROM csv_row) GROUP BY 1, 2, 3""")
def g06(spark, sf_dir):
    code, sub = tabular.translated(F.col("testCode"), F.col("code_values"))
    return row_table(spark, sf_dir).groupBy(F.col("testCode").alias("raw_code"), code.alias("code"), sub.alias("sub")).agg(
        F.count("*").alias("n"))


@query("g07_row_rules", f"""WITH {CSV}
SELECT path, n - 1 AS row_no, sample_id, test_code FROM csv_row WHERE sample_id IS NOT NULL AND value IS NOT NULL""")
def g07(spark, sf_dir):
    return tabular.rows_to_results(row_table(spark, sf_dir)).select(
        "path", "row_no", F.col("specimen_id").alias("sample_id"), "test_code")


@query("g08_value_precedence", f"""WITH {CSV}
SELECT path, n - 1 AS row_no, value FROM csv_row WHERE sample_id IS NOT NULL AND value IS NOT NULL""")
def g08(spark, sf_dir):
    return tabular.rows_to_results(row_table(spark, sf_dir)).select("path", "row_no", F.col("raw_value").alias("value"))


@query("g09_sample_groups", f"""WITH {CSV}
SELECT path, sample_id AS accession, CAST(count(*) AS BIGINT) AS n, min(n) - 1 AS first_row, max(n) - 1 AS last_row
FROM csv_row WHERE sample_id IS NOT NULL AND value IS NOT NULL AND n <> 5 GROUP BY 1, 2""")
def g09(spark, sf_dir):
    return tabular_results(spark, sf_dir).groupBy("path", F.col("specimen_id").alias("accession")).agg(
        F.count("*").alias("n"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))


@query("g12_file_flags", f"""WITH {CSV}
SELECT path, sample_id AS accession, 'IC' AS code, 'Internal control' AS name, value FROM csv_row
WHERE n = 5 AND value = 'Unclear'""")
def g12(spark, sf_dir):
    return all_rows(spark, sf_dir).filter("flag.raised").select(
        "path", F.col("specimen_id").alias("accession"), "flag.code", "flag.name", "flag.value")


@query("g13_tabular_reading", f"""WITH {CSV}
SELECT path, n - 1 AS row_no, test_code, CASE WHEN n = 2 THEN 'two' ELSE '' END AS sub_identity,
  CASE WHEN value <> 'ERROR' THEN value END AS number, CAST(NULL AS VARCHAR) AS call, value = 'ERROR' AS run_failed,
  units, CASE WHEN n = 3 THEN 'CONTROL' ELSE 'PATIENT' END AS classification
FROM csv_row WHERE sample_id IS NOT NULL AND value IS NOT NULL AND n <> 5""")
def g13(spark, sf_dir):
    return tabular_results(spark, sf_dir).select(
        "path", "row_no", "test_code", "sub_identity", "number", "call", "run_failed", "units", "classification")


# --- workbook cells: a grid of eight rows in one of two sheets per orders row --------------------------------------


def cells(spark, sf_dir):
    """Cells of one workbook per order: a notes sheet, then the results sheet (named so in half of the files)."""
    o = tb.spread(tb.table(spark, sf_dir, "orders"))
    key = F.col("o_orderkey")
    results = F.when(key % 2 == 0, "Readings").otherwise("Data")
    grid = [("Notes", 0, 0, F.lit("Batch")), ("Notes", 0, 1, key.cast("string")), ("Notes", 1, 0, F.lit("Slot "))]
    start = (key % 3 + 1).cast("int")
    for col, head in enumerate(("Slot", "Tube", "Channel", "Amount", "Amount")):
        grid.append((results, start, col, F.lit(head)))
    for r in (1, 2):
        row = (tb.text("A", str(r)), tb.text("W", key), F.lit(f"C{r}"), F.lit("0"), tb.money("o_totalprice"))
        for col, value in enumerate(row):
            grid.append((results, start + r, col, value))
    as_struct = [
        F.struct((F.lit(0 if s == "Notes" else 1) if isinstance(s, str) else F.lit(1)).alias("sheet_no"),
                 (F.lit(s) if isinstance(s, str) else s).alias("sheet_name"),
                 (F.lit(r) if isinstance(r, int) else r).alias("row_no"), F.lit(c).alias("col_no"), v.alias("text"))
        for s, r, c, v in grid
    ]
    return o.select(tb.text("wb-", key).alias("file_id"), F.explode(F.array(*as_struct)).alias("c")).select("file_id", "c.*")


def layouts(spark, sf_dir):
    o = tb.table(spark, sf_dir, "orders")
    return o.select(tb.text("wb-", F.col("o_orderkey")).alias("file_id"), F.array(F.lit("Readings")).alias("preferred_sheet_names"),
                    F.lit("Slot").alias("header_marker"),
                    F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(2).alias("max_sheets_to_scan"),
                    F.lit(20).alias("max_rows_to_scan"))


# Preferred name found first; otherwise the notes sheet (whose second row also starts with the marker) comes first.
WORKBOOK_SQL = """wb AS (
  SELECT *, 'wb-' || o_orderkey AS file_id, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS sheet_no,
    CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 + 1 ELSE 1 END AS INTEGER) AS header_row FROM orders)"""


@query("g02_sheet_choice", f"WITH {WORKBOOK_SQL} SELECT file_id, sheet_no, header_row FROM wb")
def g02(spark, sf_dir):
    return tabular.header_rows(cells(spark, sf_dir), layouts(spark, sf_dir))


@query("g03_table_header", """SELECT 'wb-' || o_orderkey AS file_id,
  CAST(o_orderkey % 3 + 1 AS INTEGER) AS header_row FROM orders""")
def g03(spark, sf_dir):
    # The notes sheet of every workbook is an empty table here: the results sheet is the first with any text.
    data = cells(spark, sf_dir).withColumn("text", F.when(F.col("sheet_no") > 0, F.col("text")))
    by_marker = F.regexp_extract("file_id", r"(\d+)", 1).cast("long") % 2 == 0
    chosen = layouts(spark, sf_dir).withColumn("header_marker", F.when(by_marker, F.col("header_marker")))
    mapping = F.array(F.struct(F.lit("Tube").alias("header"), F.lit("sampleId").alias("field")),
                      F.struct(F.lit("Amount").alias("header"), F.lit("result").alias("field")))
    maps = chosen.select("file_id", F.inline(mapping))
    return tabular.ods_header_rows(data, chosen, maps)


@query("g04_header_index", f"""WITH {WORKBOOK_SQL}
SELECT file_id, header, col_no FROM wb, (VALUES ('Slot', 0), ('Tube', 1), ('Channel', 2), ('Amount', 4))
  t(header, col_no) WHERE o_orderkey % 2 = 0
UNION ALL SELECT file_id, 'Slot', 0 FROM wb WHERE o_orderkey % 2 = 1""")
def g04(spark, sf_dir):
    data = cells(spark, sf_dir)
    return tabular.header_index(data, tabular.header_rows(data, layouts(spark, sf_dir)))


@query("g16_cells_to_results", """SELECT 'wb-' || o_orderkey AS file_id, n AS row_no, 'W' || o_orderkey AS sample_id, CASE n WHEN 1 THEN 'C1' ELSE 'T2' END AS test_code,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS raw_value FROM orders, (VALUES (1), (2)) t(n) WHERE o_orderkey % 2 = 0""")
def g16(spark, sf_dir):
    """Sheet, header, pivot and row rules in one: cells of workbooks to results. Odd workbooks hold their marker in the notes sheet and give none."""
    data = cells(spark, sf_dir).withColumn("text", F.when(F.col("text") == "C2", "chan2").otherwise(F.col("text")))
    rows = tabular.cell_rows(data, tabular.header_rows(data, layouts(spark, sf_dir)))
    rows = join_dimension(rows.withColumn("connection_id", F.lit("file-0")), file_readings(spark, sf_dir).select(*tabular.READING), ["connection_id"])
    return tabular.rows_to_results(tabular.semantic_fields(rows)).select("file_id", "row_no", F.col("specimen_id").alias("sample_id"), "test_code", "raw_value")


EXPORT = "CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE 'R' || o_custkey || '_' || o_orderkey || '_SN' || (o_orderkey % 9) END"


def exports(spark, sf_dir):
    o = tb.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    name = F.when(key % 7 == 0, "bad").otherwise(tb.text("R", F.col("o_custkey"), "_", key, "_SN", key % 9))
    record = F.to_json(F.struct(F.when(key % 5 == 0, "other").otherwise(tb.text(" ", F.col("o_custkey"), " ")).alias("sampleNo")))
    held = F.when(key % 11 == 0, "Serial none").otherwise(tb.text("Serial SN", key % 9))
    return o.select(tb.text("z-", key).alias("file_id"), name.alias("export_name"),
                    F.lit(r"R(\d+)_(\d+)_(SN\d)").alias("name_pattern"), F.lit(1).alias("sample_group"),
                    record.alias("run_record"), F.lit("sampleNo").alias("sample_field"),
                    F.array(F.struct(F.lit(3).alias("group"), held.alias("held"))).alias("named_cells"))


EXPORT_SQL = """SELECT 'z-' || o_orderkey AS file_id, CASE WHEN o_orderkey % 7 = 0 THEN 'name'
  WHEN o_orderkey % 5 = 0 THEN 'sample' WHEN o_orderkey % 11 = 0 THEN 'cell' END AS mismatch,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(o_custkey AS VARCHAR) END
    AS sample_number FROM orders"""


@query("g10_archive_identity", f"SELECT file_id, mismatch FROM ({EXPORT_SQL})")
def g10(spark, sf_dir):
    return tabular.archive_identity(exports(spark, sf_dir)).select("file_id", "mismatch")


@query("g11_archive_sample", f"SELECT sample_number, CAST(count(*) AS BIGINT) AS n FROM ({EXPORT_SQL}) WHERE mismatch IS NULL GROUP BY 1")
def g11(spark, sf_dir):
    good = tabular.archive_identity(exports(spark, sf_dir)).filter("mismatch IS NULL")
    return good.groupBy("sample_number").agg(F.count("*").alias("n"))


@query("g14_file_kind", """SELECT ['delimited','delimited','delimited','workbook','opendocument','archive','unsupported']
  [o_orderkey % 7 + 1] AS kind, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def g14(spark, sf_dir):
    ext = F.array(*map(F.lit, (".csv", ".TSV", ".txt", ".xlsx", ".ods", ".Zip", ".xls")))
    path = F.concat(F.lit("/in.d/run"), F.col("o_orderkey"), F.element_at(ext, (F.col("o_orderkey") % 7 + 1).cast("int")))
    return tb.table(spark, sf_dir, "orders").groupBy(tabular.kind_of(path).alias("kind")).agg(F.count("*").alias("n"))


@query("g15_http_eligibility", """SELECT CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 2 AND o_orderkey % 5 <> 1
  THEN NULL ELSE 'UNPINNED_PROFILE' END AS reason, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def g15(spark, sf_dir):
    key = F.col("o_orderkey")
    reason = tabular.http_eligibility(
        F.when(key % 2 == 0, "HTTP").otherwise("TCP"), F.lit("HTTP"), F.lit("FILE"),
        F.element_at(F.array(F.lit("CSV"), F.lit("TSV"), F.lit("XLSX")), (key % 3 + 1).cast("int")), key % 5 != 1)
    return tb.table(spark, sf_dir, "orders").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
