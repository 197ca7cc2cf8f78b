"""Wide expressions stay in a projection that Spark cuts into methods the JVM compiles."""

from pyspark.sql import functions as F

from titrate.functions.text import computed_once
from titrate.operators import astm


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_expressions_are_not_fused(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("a"))
    for columns in ({"b": F.concat("a", F.lit("x"))}, {"b": F.concat("a", F.lit("x")), "c": F.upper("a")}):
        rows = computed_once(df, columns)
        _, lines = plan(rows)
        holding = [line for line in lines if "concat(" in line]
        assert len(holding) == 1 and "*(" not in holding[0].split("Project")[0] and "Project" in holding[0]
        assert sorted(r["b"] for r in rows.collect()) == ["0x", "1x", "2x"]


def test_parts_of_a_record_are_read_once(spark):
    ref = F.struct(F.lit(3).alias("field"), F.lit(4).alias("component"))
    parts = F.struct(*[ref.alias(p) for p in astm.ON_RESULT])
    rows = spark.createDataFrame([(["R", "1", "^^^QTY"], "S1")], "fields array<string>, specimen_id string").select(
        "*", parts.alias("parts"), F.lit(".").alias("decimal_separator"), F.lit("BAD").alias("flag_raised"),
        F.expr("cast(array() as array<struct<code:string,name:string>>)").alias("flag_names"))
    read = astm.with_parts(astm.flag_reading(rows).filter("flag IS NULL"))
    assert plan(read)[0].count("Generate explode") == 1
    assert read.select("test_code", "raw_value").first() == ("QTY", "QTY")


def test_records_of_a_block_are_counted(spark):
    texts = ["\rO|1|S\rR|1\rR|2\rC|R|\rR|", "\rR|\rR|", "", "\rO|R|"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", astm._count(F.col("t"), "R").alias("n"))
    assert [r["n"] for r in got.orderBy("i").collect()] == [3, 2, 0, 0]
