"""ASTM records are cut by compiled code, and read once for all that a query asks of them."""

from pyspark.sql import functions as F

from titrate.functions import times
from titrate.functions.text import clip, clip_column
from titrate.operators import astm
from titrate.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def messages(spark):
    text = "H|\rP|1\rO|1|S1^x\rR|1|a\rC|1|n\rR|2|b\rO|2|T1\rR|3|c"
    return spark.createDataFrame([("m", text), ("m", text), ("n", "H|\rR|1|z"), ("o", "H|")], "message_id string, raw_text string")


def test_records_are_cut_outside_the_explode(spark):
    rows = astm.result_records(messages(spark))
    exploding = [line for line in plan(rows).split("\n") if "Generate posexplode" in line]
    assert len(exploding) == 1 and "lambda" not in exploding[0]
    got = [tuple(r) for r in rows.select("message_id", "record_no", F.col("fields")[2], "following", "order_line", "specimen_id").orderBy(
        "message_id", "record_no").collect()]
    one = [("m", 0, "a", "\rC|1|n", "O|1|S1^x", "S1"), ("m", 1, "b", "\rO|2|T1", "O|1|S1^x", "S1"), ("m", 2, "c", "", "O|2|T1", "T1")]
    assert got == [r for r in one for _ in range(2)] + [("n", 0, "z", "", None, None)]


def test_time_of_a_column_needs_no_lambda(spark):
    raw = {"20240230": "2024-02-29", "00010101": "0001-01-01", "00000101": None, "20241301": None, "20240100": None, "20240132": None,
           "202401012359": "2024-01-01T23:59:00Z", "202401012400": None, "20240231112233": "2024-02-29T11:22:33Z", "20240101112260": None,
           "2024010111": None, "2024-1-1": None, "": None}
    rows = spark.createDataFrame([(r,) for r in raw], "raw string")
    read = rows.select("raw", times.astm_time_of(F.col("raw")).alias("iso"), times.astm_time(F.col("raw")).alias("same"))
    assert "lambda" not in plan(read.select("raw", "iso"))
    assert {r["raw"]: r["iso"] for r in read.collect()} == raw and all(r["iso"] == r["same"] for r in read.collect())


def test_components_and_ends(spark):
    rows = spark.createDataFrame([("a^b^c", 2), ("a^b^c", 3), ("a^b^c", 4), ("a", 1), ("a", 2), ("", 1), ("^", 2), (None, 1)], "t string, n int")
    assert [r[0] for r in rows.select(astm.component(F.col("t"), F.col("n"))).collect()] == ["b", "c", "", "a", "", "", "", None]
    texts = spark.createDataFrame([(t,) for t in ("", " ", "a", " a", "a\t", "\x00é\x1f", "é", " a", "a b", None)], "t string")
    assert all(r[0] == r[1] for r in texts.select(clip(F.col("t")), clip_column(F.col("t"))).collect())


def test_results_are_numbered_from_one_reading(spark):
    rows = astm.result_records(messages(spark).withColumn("row", astm.message_row()), "row")
    numbered = astm.numbered(rows.filter("record_no <> 1"), "row")
    assert plan(numbered).count("Generate posexplode") == 1
    got = sorted(tuple(r) for r in numbered.select("message_id", "record_no", "ordinal").collect())
    assert got == [("m", 0, 1), ("m", 0, 1), ("m", 2, 2), ("m", 2, 2), ("n", 0, 1)]


def test_flags_and_results_are_classified_in_one_reading(spark):
    """One reading of declared parts and one of profiles without, not a third for the flags."""
    assert plan(registry.QUERIES["i07_classification"](spark, SF)).count("Generate posexplode") == 2
