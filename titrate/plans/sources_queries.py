"""Source and sink queries (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.joins import join_dimension
from ..operators import delivery, orders, tabular
from ..session import written_table
from ..sources import messages, sinks, workbook
from . import testbed as tb
from .registry import query


@query("a01_message_scan", """SELECT protocol, transport, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'HL7' AS protocol, 'MLLP' AS transport FROM orders) GROUP BY 1, 2""")
def a01(spark, sf_dir):
    rows = written_table(spark, f"a01 {sf_dir}", lambda: tb.hl7_messages(spark, sf_dir))
    stored = messages.raw_messages(spark, rows.inputFiles()[0].rsplit("/", 1)[0])
    return stored.groupBy("protocol", "transport").agg(F.count("*").alias("n"))


@query("a02_text_lines", """SELECT doc_id AS path, line_no - 1 AS line_no, line FROM (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, string_split(regexp_replace(CASE WHEN doc_id % 3 = 0
    THEN regexp_replace(text, '\\r?\\n', chr(10), 'g') ELSE regexp_replace(text, '\\r\\n', chr(10), 'g') END, '\\n+$', ''), chr(10)) AS ls FROM documents))""")
def a02(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"\r?\n", "\r\n")).otherwise(F.col("text"))  # a third with CRLF
    files = d.select(F.col("doc_id").alias("path"), F.encode(F.concat(F.lit("﻿"), body), "UTF-8").alias("content"))
    return messages.text_lines(files)


@query("a03_delimited_scan", f"""WITH {tb.CSV_SQL}
SELECT path, n - 1 AS row_no, 'A' || n AS well, CASE WHEN k % 2 = 0 THEN 'FAM' || o_custkey || ', GIV'
  ELSE 'FAM' || o_custkey END AS patient, 9 AS n_cells FROM csv_row""")
def a03(spark, sf_dir):
    readings = tb.message_readings(spark, sf_dir).filter("expected_protocol = 'FILE'").select(
        "connection_id", "delimiter", "skip_rows", "layout")
    rows = tabular.delimited_rows(join_dimension(tb.csv_files(spark, sf_dir), readings, ["connection_id"]))
    return rows.select("path", "row_no", F.get("cells", F.lit(0)).alias("well"), F.get("cells", F.lit(2)).alias("patient"),
                       F.size("cells").alias("n_cells"))


def zip_of(parts):
    """Pandas batch function: one ZIP file per row from its (entry, text) pairs."""
    import io
    import zipfile

    def build(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as archive:
                    for name, text in parts(row):
                        archive.writestr(name, text)
                out.append((row["path"], buffer.getvalue()))
            yield __import__("pandas").DataFrame(out, columns=["path", "content"])

    return build


def _xlsx_parts(row):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
    cells = (f'<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>{row["key"]}.0</v></c>'
             f'<c r="AB2" t="inlineStr"><is><t>{row["name"]}</t></is></c><c r="B2" t="b"><v>1</v></c></row>')
    return [
        ("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
         'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
         '<sheet name="Notes" r:id="r1"/><sheet name="Results" r:id="r2"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r2" Target="worksheets/s2.xml"/>'
         '<Relationship Id="r1" Target="/xl/worksheets/s1.xml"/></Relationships>'),
        ("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
         "<si><t>Wel</t><r><t>l</t></r></si></sst>"),
        ("xl/worksheets/s1.xml", sheet.format("")), ("xl/worksheets/s2.xml", sheet.format(cells)),
    ]


def customers(spark, sf_dir):
    return tb.spread(tb.table(spark, sf_dir, "customer")).select(
        tb.text("f-", F.col("c_custkey")).alias("path"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))


@query("a04_workbook_cells", """SELECT 'f-' || c_custkey AS file_id, 1 AS sheet_no, 'Results' AS sheet_name, 1 AS row_no,
  [0, 2, 27, 1][n] AS col_no, ['Well', CAST(c_custkey AS VARCHAR), c_name, 'TRUE'][n] AS text
FROM customer, (VALUES (1), (2), (3), (4)) t(n)""")
def a04(spark, sf_dir):
    files = customers(spark, sf_dir).mapInPandas(zip_of(_xlsx_parts), "path STRING, content BINARY")
    return workbook.workbook_cells(files).drop("issue")


def _ods_parts(row):
    table = "urn:oasis:names:tc:opendocument:xmlns:table:1.0"
    cell = "<t:table-cell{}>{}</t:table-cell>"
    repeat = ' t:number-columns-repeated="{}"'
    body = (cell.format("", f"<x:p>{row['name']}</x:p><x:p>b</x:p>") + cell.format(repeat.format(70), "")
            + cell.format(repeat.format(3), "<x:p>v</x:p>") + cell.format(repeat.format(2), ""))
    return [("content.xml", f'<d xmlns:t="{table}" xmlns:x="urn:oasis:names:tc:opendocument:xmlns:text:1.0">'
             f'<t:table t:name="Empty"><t:table-row>{cell.format("", "")}</t:table-row></t:table>'
             f'<t:table t:name="Data"><t:table-row>{body}</t:table-row></t:table></d>')]


@query("a05_opendocument_cells", """SELECT 'f-' || c_custkey AS file_id, 1 AS sheet_no, 'Data' AS sheet_name, 0 AS row_no,
  n - 1 AS col_no, CASE WHEN n = 1 THEN c_name || chr(10) || 'b' WHEN n BETWEEN 3 AND 5 THEN 'v' ELSE '' END AS text
FROM customer, (VALUES (1), (2), (3), (4), (5), (6), (7)) t(n)""")
def a05(spark, sf_dir):
    files = customers(spark, sf_dir).mapInPandas(zip_of(_ods_parts), "path STRING, content BINARY")
    return workbook.expanded(workbook.ods_runs(files)).filter("issue IS NULL").drop("issue")


def _export_parts(row):
    folder = "" if row["key"] % 5 == 1 else f"out/R{row['key']}/"
    parts = [(folder + "results.xlsx", "x"), (folder + "run.json", '{"n": 1}')]
    if row["key"] % 5 == 2:
        parts = parts[:1]
    if row["key"] % 5 == 3:
        parts.append(("other/run.json", "{}"))
    return parts


@query("a06_archive_parts", """SELECT 'f-' || c_custkey AS path, CASE c_custkey % 5 WHEN 1 THEN 'no_folder'
  WHEN 2 THEN 'missing' WHEN 3 THEN 'duplicate' END AS mismatch,
  CASE WHEN c_custkey % 5 <> 1 THEN 'R' || c_custkey END AS export_name FROM customer""")
def a06(spark, sf_dir):
    files = customers(spark, sf_dir).mapInPandas(zip_of(_export_parts), "path STRING, content BINARY")
    found = workbook.archive_parts(workbook.archive_entries(files), "results.xlsx", "run.json")
    return found.select("path", "mismatch", "export_name")


@query("a07_directory_scan", "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM lineitem")
def a07(spark, sf_dir):
    names = messages.directory_files(spark, sf_dir, "line*.parquet").select("path", "name")
    stored = spark.read.parquet(sf_dir + "/lineitem.parquet").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    # Rows are counted by file before the join: its key has one value for each file, whose rows would meet in one task.
    # An inner join with distinct names, as the optimizer moves a semi join below the count.
    counted = stored.groupBy("name").agg(F.count("*").alias("n"))
    return counted.join(names.select("name").distinct(), "name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def offered(spark, sf_dir):
    key = F.col("o_orderkey")
    return tb.table(spark, sf_dir, "orders").select(
        tb.text("/lab/in", key % 40, "/sub", key % 3, "/r", key, ".csv").alias("path"), (key * 4096).alias("length"))


@query("a08_pending_directory", """SELECT 'an' || (o_orderkey % 40) AS analyzer_id, CAST(count(*) AS BIGINT) AS n
FROM orders WHERE o_orderkey % 40 < 25 AND o_orderkey % 3 = 0 GROUP BY 1""")
def a08(spark, sf_dir):
    k = F.col("n_nationkey")
    registered = tb.table(spark, sf_dir, "nation").select(
        F.explode(F.array(tb.text("/lab/in", k, "/sub0"), tb.text("/lab/later", k))).alias("directory"),
        tb.text("an", k).alias("analyzer_id"))
    return messages.claimed(offered(spark, sf_dir), registered).groupBy("analyzer_id").agg(F.count("*").alias("n"))


@query("a09_size_cap", """SELECT o_orderkey * 4096 > 20971520 AS parked, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def a09(spark, sf_dir):
    readable, parked = messages.within_size(offered(spark, sf_dir))
    rows = readable.select(F.lit(False).alias("parked")).unionByName(parked.select(F.lit(True).alias("parked")))
    return rows.groupBy("parked").agg(F.count("*").alias("n"))


@query("a10_import_roots", """SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 40 < 25""")
def a10(spark, sf_dir):
    roots = tb.table(spark, sf_dir, "nation").select(tb.text("/lab/in", F.col("n_nationkey"), "/").alias("root"))
    return messages.within_roots(offered(spark, sf_dir), roots).agg(F.count("*").alias("n"))


def stored_documents(spark, sf_dir):
    k = F.col("p_partkey")
    good = F.to_json(F.struct(
        F.struct(tb.text("p", k).alias("id"), F.col("p_name").alias("displayName")).alias("profileMeta"),
        F.struct((k % 3 + 1).alias("revision")).alias("catalog")))
    body = F.when(k % 10 == 0, "{broken").when(k % 10 == 1, "[1]").otherwise(good)
    return tb.table(spark, sf_dir, "part").select(tb.text("cat/", k, ".json").alias("path"), body.alias("body"))


@query("a11_profile_catalog", """SELECT 'p' || p_partkey AS profile_id, CAST(p_partkey % 3 + 1 AS INTEGER) AS revision,
  p_name AS display_name, CAST(NULL AS VARCHAR) AS reason FROM part WHERE p_partkey % 10 > 1
UNION ALL SELECT NULL, NULL, NULL, CASE WHEN p_partkey % 10 = 0 THEN 'unreadable' ELSE 'not_an_object' END FROM part
WHERE p_partkey % 10 <= 1""")
def a11(spark, sf_dir):
    good, bad = messages.catalog(stored_documents(spark, sf_dir))
    rows = messages.profile_rows(good).select("profile_id", "revision", "display_name").withColumn("reason", F.lit(None).cast("string"))
    return rows.unionByName(bad.select("reason"), allowMissingColumns=True)


@query("a12_connection_scan", """SELECT 'c' || s_suppkey AS connection_id, 'p' || (s_suppkey % 7) AS profile_id,
  CAST(1 + s_suppkey % 2 AS INTEGER) AS revision, '10.0.0.' || s_nationkey AS host FROM supplier""")
def a12(spark, sf_dir):
    k = F.col("s_suppkey")
    body = F.to_json(F.struct(
        tb.text("c", k).alias("connectionId"), F.struct(tb.text("p", k % 7).alias("profileId"), (k % 2 + 1).alias("revision")).alias("profileRef"),
        F.struct(tb.text("10.0.0.", F.col("s_nationkey")).alias("host")).alias("values")))
    docs = tb.table(spark, sf_dir, "supplier").select(body.alias("body"))
    return messages.connection_rows(messages.catalog(docs)[0]).select("connection_id", "profile_id", "revision", F.col("values.host").alias("host"))


def bundle_rows(spark, sf_dir):
    o = tb.table(spark, sf_dir, "orders")
    return o.select(tb.text("d", F.col("o_orderkey")).alias("delivery_id"), tb.text("S", F.col("o_orderkey")).alias("accession"),
                    F.to_json(F.struct("o_custkey")).alias("bundle"), F.col("o_orderdate").alias("received_at"))


@query("a13_bundle_sink", """SELECT year(o_orderdate)::INTEGER AS y, CAST(count(*) AS BIGINT) AS n, max(length('{"o_custkey":' || o_custkey || '}'))::INTEGER AS longest
FROM orders GROUP BY 1""")
def a13(spark, sf_dir):
    path = _fresh(spark)
    sinks.write_bundles(bundle_rows(spark, sf_dir).coalesce(4).withColumn("received_at", F.date_trunc("year", "received_at")), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.year("received_on").alias("y")).agg(F.count("*").alias("n"), F.max(F.length("bundle")).alias("longest"))


def _fresh(spark):
    """A new folder below the shared checkpoint folder."""
    import uuid

    from ..session import checkpoint_dir

    return f"{checkpoint_dir(spark)}/titrate-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@query("a14_dead_message_sink", """SELECT ['RENDER_ERROR','PARSE_NO_RESULTS','UNPINNED_PROFILE'][doc_id % 3 + 1] AS failure_reason,
  CAST(count(*) AS BIGINT) AS n, max(least(length(text), 1000))::INTEGER AS longest FROM documents GROUP BY 1""")
def a14(spark, sf_dir):
    path = _fresh(spark)
    d = tb.table(spark, sf_dir, "documents")
    reason = F.element_at(F.array(*map(F.lit, ("RENDER_ERROR", "PARSE_NO_RESULTS", "UNPINNED_PROFILE"))), (F.col("doc_id") % 3 + 1).cast("int"))
    sinks.write_dead_messages(d.select(F.col("doc_id").alias("delivery_id"), reason.alias("reason"), F.col("text").alias("detail"),
                                       F.col("source").alias("payload")), path)
    back = spark.read.parquet(path)
    return back.groupBy("failure_reason").agg(F.count("*").alias("n"), F.max(F.length("last_error")).alias("longest"))


@query("a15_attempt_log", """SELECT 'd' || user_id AS delivery_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS INTEGER) AS last_no
FROM events GROUP BY 1""")
def a15(spark, sf_dir):
    path = _fresh(spark)
    from .delivery_queries import attempts

    log = attempts(spark, sf_dir)
    sinks.write_attempts(log.filter("attempt_id % 2 = 0").coalesce(2), path)
    sinks.write_attempts(log.filter("attempt_id % 2 = 1").coalesce(2), path)
    rows = delivery.numbered_attempts(spark.read.parquet(path))
    return rows.groupBy("delivery_id").agg(F.count("*").alias("n"), F.max("attempt_no").alias("last_no"))


@query("a16_order_sink", """SELECT 'c' || (o_custkey % 25) AS connection_id, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def a16(spark, sf_dir):
    path = _fresh(spark)
    o = tb.table(spark, sf_dir, "orders")
    codes = F.array(F.lit("T1"), tb.text("T", F.col("o_orderkey") % 5))
    message = orders.astm_order(tb.text("S", F.col("o_orderkey")), tb.text("P", F.col("o_custkey")), codes)
    sinks.write_orders(o.select(tb.text("c", F.col("o_custkey") % 25).alias("connection_id"), tb.text("S", F.col("o_orderkey")).alias("accession"),
                                message.alias("message")), path)
    return spark.read.parquet(path).groupBy("connection_id").agg(F.count("*").alias("n"))
