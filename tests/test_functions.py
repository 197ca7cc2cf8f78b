import hashlib

import pytest
from pyspark.sql import functions as F

from titrate.functions import codes, identity, net, text, times


def column(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


def test_lenient_dates(spark):
    got = column(spark, ["20240230", "20230230112233", "202401011260", "20240132", "2024010112", "x2345678"], times.astm_time)
    assert got == ["2024-02-29", "2023-02-28T11:22:33Z", None, None, None, None]


def test_hl7_times(spark):
    got = column(spark, ["20240101", "2024010107", "20240101070911.25-0530", "2024010125", "20240101+0100", ""], times.hl7_time)
    assert got == ["2024-01-01", "2024-01-01T07:00:00Z", "2024-01-01T07:09:11-05:30", None, "2024-01-01", None]


def test_bounded_decimals(spark):
    good, bad = ["1", "-.5", "5.", "1e300", "+7.25E-3"], ["", " 1", "1,5", "1" * 19, ".", "1e1000", None]
    assert column(spark, good + bad, text.is_bounded_decimal) == [True] * len(good) + [False] * len(bad)


def test_addresses(spark):
    got = column(spark, ["010.001.0.255", "2001:DB8::1", "::ffff:1.2.3.4", "1::2::3", "host", "256.1.1.1", ":1:2:3:4:5:6:7"], net.canonical_ip)
    assert got == ["10.1.0.255", "2001:db8:0:0:0:0:0:1", "1.2.3.4", None, None, None, None]


def test_ranges(spark):
    low, high = zip(*[(a, b) for a, b in zip(column(spark, ["4.00-10.00", " 1,5 to 2 ", "<5", "1 2"], lambda c: codes.range_limits(c)[0]),
                                             column(spark, ["4.00-10.00", " 1,5 to 2 ", "<5", "1 2"], lambda c: codes.range_limits(c)[1]), strict=True)], strict=True)
    assert low == ("4.00", "1.5", None, None) and high == ("10.00", "2", None, None)


def test_identities_match_hashlib(spark):
    expected = hashlib.sha256()
    for part in ("c1", "ab", "é1"):
        raw = part.encode()
        expected.update(len(raw).to_bytes(4, "big") + raw)
    got = column(spark, ["é1"], lambda v: identity.delivery_id(F.lit("HL7"), F.lit("c1"), F.lit("ab"), v))
    assert got == ["hl7-v1:" + expected.hexdigest()]
    assert column(spark, ["h"], lambda v: identity.receipt_id(F.lit("s"), v)) == ["recv-v1:" + hashlib.sha256(b"s\0h").hexdigest()]
    assert column(spark, [" "], lambda v: identity.delivery_id(F.lit("HL7"), F.lit("c1"), F.lit("ab"), v)) == [None]


@pytest.mark.parametrize("glob,yes,no", [
    ("*.{csv,tsv}", "a.tsv", "b/a.tsv"), ("run-?.txt", "run-1.txt", "run-12.txt"), ("[!a]*", "bcd", "abc"), ("run[0-9].csv", "run7.csv", "runx.csv"),
    ("a,b.{csv,tsv}", "a,b.tsv", "a.tsv"), ("a,b.csv", "a,b.csv", "b.csv"), ("**/x[^a].csv", "p/q/x^.csv", "p/q/xb.csv"), ("a(b)+.txt", "a(b)+.txt", "abb.txt"),
    (r"q\*.csv", "q*.csv", "qq.csv"), ("{a,{b,c}}d", "cd", "c"), ("[[]x", "[x", "x"), ("open{a", "opena)", "open{a"), ("}.csv", "}.csv", ".csv"),
])
def test_globs(spark, glob, yes, no):
    found = spark.createDataFrame([(glob, yes, no)], "g string, y string, n string").select(
        F.rlike("y", text.glob_regex(F.col("g"))), F.rlike("n", text.glob_regex(F.col("g")))).first()
    assert tuple(found) == (glob != "open{a", False)


def test_a_broken_pattern_finds_nothing(spark):
    got = column(spark, ["Q[(", r"\p{L}+", "", None], lambda v: F.coalesce(text.safe_pattern(v), F.lit("~")))
    assert got == [text.NEVER, r"\p{L}+", "", "~"]
