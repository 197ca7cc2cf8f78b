"""Shared interpretation queries (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, text, times
from ..operators import interpret
from . import testbed as tb
from .delivery_queries import NOW_SQL, now
from .registry import query

ASTM = tb.ASTM_SQL


def lines(spark, sf_dir):
    return tb.table(spark, sf_dir, "lineitem")


def pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


_NUMBERS = ("{}", "+{}.5", "-.{}", "{}.", "{}e3", "1e{}", "{},5", " {}", "{}x", "", "12345678901234567890.{}")


@query("h01_bounded_decimal", "SELECT raw, regexp_full_match(raw, '[+-]?(\\d{1,18}(\\.\\d{0,18})?|\\.\\d{1,18})([eE][+-]?\\d{1,3})?') AND length(raw) <= 48 AS numeric, CAST(count(*) AS BIGINT) AS n FROM (SELECT replace(["
       + ", ".join(f"'{v}'" for v in _NUMBERS) + "][l_orderkey % 11 + 1], '{}', CAST(l_partkey AS VARCHAR)) AS raw FROM lineitem) GROUP BY 1, 2")
def h01(spark, sf_dir):
    raw = F.replace(pick(_NUMBERS, F.col("l_orderkey")), F.lit("{}"), F.col("l_partkey").cast("string"))
    rows = lines(spark, sf_dir).groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))
    return rows.select("raw", text.is_bounded_decimal(F.col("raw")).alias("numeric"), "n")


@query("h02_canonical_number", "SELECT DISTINCT CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS number FROM lineitem")
def h02(spark, sf_dir):
    sep = pick((".", ",", ";"), F.col("l_orderkey"))
    written = F.replace(tb.money("l_discount"), F.lit("."), sep)
    return lines(spark, sf_dir).select(text.canonical_number(written, sep).alias("number")).distinct()


@query("h03_astm_time", """SELECT raw, CASE WHEN length(raw) = 8 THEN strftime(d, '%Y-%m-%d') WHEN length(raw) = 12 THEN strftime(d, '%Y-%m-%dT11:22:00Z') WHEN length(raw) = 14 AND raw NOT LIKE '%60' THEN strftime(d, '%Y-%m-%dT11:22:33Z') END AS iso,
  CAST(count(*) AS BIGINT) AS n FROM (SELECT y || lpad(CAST(m AS VARCHAR), 2, '0') || '31' || ['', '1122', '112233', '11', '112260'][k % 5 + 1] AS raw, last_day(make_date(y, m, 1)) AS d
  FROM (SELECT l_orderkey AS k, 1990 + l_partkey % 30 AS y, 1 + l_suppkey % 12 AS m FROM lineitem)) GROUP BY 1, 2""")
def h03(spark, sf_dir):
    day = F.concat((F.lit(1990) + F.col("l_partkey") % 30).cast("string"), F.lpad((F.lit(1) + F.col("l_suppkey") % 12).cast("string"), 2, "0"), F.lit("31"))
    raw = F.concat(day, pick(("", "1122", "112233", "11", "112260"), F.col("l_orderkey")))
    rows = lines(spark, sf_dir).groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))
    return rows.select("raw", times.astm_time(F.col("raw")).alias("iso"), "n")


def with_reading(rows, spark, sf_dir):
    from ..functions.joins import join_dimension

    r = tb.message_readings(spark, sf_dir).select("connection_id", "alias_codes", "failures", "definitions")
    return join_dimension(rows.withColumn("connection_id", tb.text("astm-", F.col("l_suppkey") % 25)), r, ["connection_id"])


@query("h04_profile_code", "SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT ['QUANTITY', 'PRICE', 'OVERRIDDEN', 'NONE'][l_orderkey % 4 + 1] AS code FROM lineitem) GROUP BY 1")
def h04(spark, sf_dir):
    code = pick(("QTY", "PRICE", "own", "NONE"), F.col("l_orderkey"))
    found = interpret.profile_code(code, F.col("alias_codes"), F.create_map(F.lit("OVERRIDDEN"), F.lit(" own ")))
    return with_reading(lines(spark, sf_dir), spark, sf_dir).groupBy(found.alias("code")).agg(F.count("*").alias("n"))


@query("h05_run_failure", "SELECT failed, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_orderkey % 4 = 0 AS failed FROM lineitem) GROUP BY 1")
def h05(spark, sf_dir):
    code, value = pick(("TAX", "TAX", "PRICE", "TAX"), F.col("l_orderkey")), pick(("ERROR", "HIGH", "ERROR", "error"), F.col("l_orderkey"))
    failed = interpret.is_run_failure(code, F.lit(""), value, F.col("failures"))
    return with_reading(lines(spark, sf_dir), spark, sf_dir).groupBy(failed.alias("failed")).agg(F.count("*").alias("n"))


@query("h06_canonical_answer", "SELECT answer, CAST(count(*) AS BIGINT) AS n FROM (SELECT ['HIGH', 'HIGH', 'NEG', 'odd'][l_orderkey % 4 + 1] AS answer FROM lineitem) GROUP BY 1")
def h06(spark, sf_dir):
    spelled = pick(("HIGH", "HAUT", "NEG", "odd"), F.col("l_orderkey"))
    answer = interpret.canonical_answer(F.lit("TAX"), F.lit(""), spelled, F.col("definitions"))
    return with_reading(lines(spark, sf_dir), spark, sf_dir).groupBy(answer.alias("answer")).agg(F.count("*").alias("n"))


@query("h07_range_limits", """SELECT l_partkey, l_linenumber % 4 AS kind, CASE WHEN l_linenumber % 4 < 3 THEN l_partkey || CASE WHEN l_linenumber % 4 = 1 THEN '.5' ELSE '' END END AS low,
  CASE WHEN l_linenumber % 4 < 3 THEN CAST(l_partkey + 1 AS VARCHAR) END AS high FROM lineitem""")
def h07(spark, sf_dir):
    part, kind = F.col("l_partkey"), F.col("l_linenumber") % 4
    raw = F.when(kind == 0, tb.text(" ", part, "-", part + 1)).when(kind == 1, tb.text(part, ",5 to ", part + 1, " ")).when(kind == 2, tb.text(part, " - ", part + 1)).otherwise(tb.text("<", part))
    low, high = codes.range_limits(raw)
    return lines(spark, sf_dir).select("l_partkey", kind.alias("kind"), low.alias("low"), high.alias("high"))


@query("h08_call_codes", "SELECT code, display, CAST(count(*) AS BIGINT) AS n FROM (SELECT ['DET', 'ND', 'POS', 'NEG', 'IND', NULL][l_orderkey % 6 + 1] AS code, ['Detected', 'Not detected', 'Positive', 'Negative', 'Indeterminate', NULL][l_orderkey % 6 + 1] AS display FROM lineitem) GROUP BY 1, 2")
def h08(spark, sf_dir):
    call = pick(("Detected", " not detected", "POS", "neg", "INDETERMINATE", "maybe"), F.col("l_orderkey"))
    return lines(spark, sf_dir).groupBy(codes.call_code(call).alias("code"), codes.call_display(call).alias("display")).agg(F.count("*").alias("n"))


@query("h09_observation_status", "SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT ['final', 'preliminary', 'corrected', 'cancelled', 'registered', 'unknown'][l_orderkey % 6 + 1] AS status FROM lineitem) GROUP BY 1")
def h09(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(codes.observation_status(pick(("F", "P", "C", "X", "I", "f"), F.col("l_orderkey"))).alias("status")).agg(F.count("*").alias("n"))


@query("h10_value_slot", """SELECT kind, comparator, quantity, text, interpretation, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_linenumber AS k, CASE WHEN l_linenumber = 1 THEN 'absent' WHEN l_linenumber IN (2, 3, 5) THEN 'quantity' ELSE 'text' END AS kind,
  CASE WHEN l_linenumber = 3 THEN '<' END AS comparator, CASE l_linenumber WHEN 2 THEN '5' WHEN 3 THEN '40' WHEN 5 THEN '5' END AS quantity, CASE WHEN l_linenumber IN (4, 6, 7) THEN 'call' END AS text,
  CASE WHEN l_linenumber = 3 THEN 'call' END AS interpretation FROM lineitem) GROUP BY ALL""")
def h10(spark, sf_dir):
    k = F.col("l_linenumber")
    slot = interpret.value_slot(k == 1, F.when(k.isin(1, 2, 5), "5"), F.when(k == 3, "40"), F.when(k == 3, "<").when(k == 5, "<="), F.when(~k.isin(2, 5), "call"), F.lit("u"))
    return lines(spark, sf_dir).select(slot.alias("s")).groupBy("s.kind", "s.comparator", "s.quantity", "s.text", "s.interpretation").agg(F.count("*").alias("n"))


@query("h11_answer_coding", "SELECT canonical, code, CAST(count(*) AS BIGINT) AS n FROM (SELECT ['HIGH', 'HIGH', 'NEG', NULL][l_orderkey % 4 + 1] AS canonical, CASE WHEN l_orderkey % 4 < 2 THEN 'A' || (l_suppkey % 25) END AS code FROM lineitem) GROUP BY 1, 2")
def h11(spark, sf_dir):
    spelled = pick(("HIGH", "HAUT", "NEG", ""), F.col("l_orderkey"))
    answer = interpret.answer_coding(F.lit("TAX"), F.lit(""), F.when(spelled != "", spelled), F.col("definitions"))
    rows = with_reading(lines(spark, sf_dir), spark, sf_dir).select(answer.alias("a"))
    return rows.groupBy("a.canonical", F.get("a.codings", F.lit(0))["code"].alias("code")).agg(F.count("*").alias("n"))


GLOBS = ("*.csv", "run-?.{csv,tsv}", "**/x*", "run-1[0-4].csv", "[!a]*", "run-1,2.{csv,tsv}")


@query("h12_glob_match", """SELECT pattern, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['*.csv', 'run-?.{csv,tsv}', '**/x*', 'run-1[0-4].csv', '[!a]*', 'run-1,2.{csv,tsv}']) AS pattern,
  o_orderkey % 4 AS kind, o_orderkey % 20 AS m FROM orders) WHERE CASE pattern WHEN '*.csv' THEN kind IN (0, 3) WHEN '**/x*' THEN kind = 2 WHEN 'run-1[0-4].csv' THEN kind = 0 AND m BETWEEN 10 AND 14
  WHEN '[!a]*' THEN kind <> 2 WHEN 'run-1,2.{csv,tsv}' THEN kind = 3 ELSE kind < 2 AND m < 10 END GROUP BY 1""")
def h12(spark, sf_dir):
    key = F.col("o_orderkey")
    path = F.element_at(F.array(tb.text("run-", key % 20, ".csv"), tb.text("run-", key % 20, ".tsv"), tb.text("a/b/x", key), F.lit("run-1,2.csv")), (key % 4 + 1).cast("int"))
    globs = spark.createDataFrame([(g,) for g in GLOBS], "pattern string").select("pattern", text.glob_regex(F.col("pattern")).alias("regex"))
    listed = globs.agg(F.collect_list(F.struct("pattern", "regex")).alias("g")).first()["g"]  # the six patterns above
    hits = F.array(*[F.when(F.rlike(path, F.lit(x["regex"])), F.lit(x["pattern"])) for x in listed])
    return tb.table(spark, sf_dir, "orders").select(F.explode(hits).alias("pattern")).filter("pattern IS NOT NULL").groupBy("pattern").agg(F.count("*").alias("n"))


@query("h13_truncation", "SELECT doc_id, least(length(text), 1000)::INTEGER AS error, least(length(text), 2000)::INTEGER AS response, substr(text, 1, 800) AS snippet FROM documents")
def h13(spark, sf_dir):
    t = F.col("text")
    return tb.table(spark, sf_dir, "documents").select("doc_id", F.length(text.error_text(t)).alias("error"), F.length(text.response_text(t)).alias("response"), text.snippet(t).alias("snippet"))


@query("h14_age_seconds", f"SELECT o_orderkey, CAST(greatest(0, epoch({NOW_SQL} - INTERVAL 8000 DAY) - epoch(o_orderdate)) AS BIGINT) AS age FROM orders")
def h14(spark, sf_dir):
    then = now() - F.make_dt_interval(F.lit(8000))
    return tb.table(spark, sf_dir, "orders").select("o_orderkey", text.age_seconds(F.col("o_orderdate"), then).alias("age"))
