import time

from pyspark.sql import functions as F

from titrate.schemas import ASTM_PARTS
from titrate.operators import astm, hl7

ASTM = "\r".join([
    "H|\\^&|||X", "P|1|||p1|L^F", "R|0|^^^EARLY|1", "O|1|S1^x", "R|1|^^^T1|^5.0^^|mg|||||||20240230|", "C|1|I|hello", "R|2|T2|pos",
    "O|2| ", "R|3|T3|7", "O|3|S3", "R|4|^A^b|1e3|u", "C|1|I|N^1^d^e^20200101", "O|4|S4", "C|9|I|late", "L|1",
])


def messages(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "message_id string, raw_text string")


def test_astm_order_context_and_established_reading(spark):
    rows = astm.established(astm.result_records(messages(spark, ASTM))).orderBy("record_no").collect()
    assert [(r.record_no, r.accession, r.specimen_id, r.test_code, r.raw_value, r.is_numeric, r.units, r.effective) for r in rows] == [
        (1, "S4", "S1", "T1", "5.0", True, "mg", "2024-02-29"), (2, "S4", "S1", "T2", "pos", False, None, None),
        (4, "S4", "S3", "A", "1e3", True, "u", None)]


def test_astm_notes_follow_their_result(spark):
    ref = F.struct(F.lit(4).alias("field"), F.lit(0).alias("component"))
    rows = astm.result_records(messages(spark, ASTM)).orderBy("record_no").select(astm.notes(F.col("following"), ref).alias("n")).collect()
    assert [r.n for r in rows] == [[], ["hello"], [], [], ["N 1: d (e) at 2020-01-01", "late"]]


def test_astm_without_orders_has_no_accession(spark):
    rows = messages(spark, "H|\\^&\nR|1|T|5")
    assert astm.headers(rows).first().accession == "ASTM-UNKNOWN" and astm.established(astm.result_records(rows)).count() == 0


HL7 = "\r\n".join([
    "MSH|^~\\&|APP|F|||20240101||ORU^R01|1|P|2.3.1", "PID|1||A", "OBR|1||ACC1", "OBX|1|NM|W^WBC||9.81|u", "NTE|1||one", "SPM|1|||S1", "NTE|2||two",
    "OBX|2|ST|X||", "NTE|1||lost", "PV1|1", "OBX|3|NM|Y||4", "ZZZ|1", "NTE|1||held", "OBR|2||ACC2", "NTE|3||after", "PID|2||B", "OBX|1|ST|Q||v",
])


def test_hl7_groups_and_accessions(spark):
    rows = hl7.headers(hl7.patient_groups(messages(spark, HL7))).orderBy("group_no").collect()
    assert [(r.group_no, r.n_groups, r.accession) for r in rows] == [(1, 2, "ACC2"), (2, 2, "HL7-UNKNOWN")]


def test_hl7_notes_by_specimen_position(spark):
    ref = F.struct(F.lit("NTE").alias("segment"), F.lit(3).alias("field"), F.lit(0).alias("component"), F.lit(0).alias("sub"))
    obs = hl7.observations(hl7.patient_groups(messages(spark, HL7)).filter("group_no = 1")).orderBy("obs_no")
    before = [r.n for r in obs.select(hl7.notes(ref, F.lit("PRECEDING")).alias("n")).collect()]
    after = [r.n for r in obs.select(hl7.notes(ref, F.lit("FOLLOWING_OBX")).alias("n")).collect()]
    assert before == [["one", "two"], ["lost"], []] and after == [["one", "two"], ["lost"], ["held"]]


def test_hl7_following_specimen_is_bound_to_its_observation(spark):
    obs = hl7.observations(hl7.patient_groups(messages(spark, HL7)).filter("group_no = 1")).orderBy("obs_no")
    path = F.struct(F.lit("SPM").alias("segment"), F.lit(4).alias("field"), F.lit(0).alias("component"), F.lit(0).alias("sub"))
    for position, expected in (("FOLLOWING_OBX", ["S1", "", ""]), ("PRECEDING", ["", "S1", "S1"])):
        got = [r[0] for r in obs.select(hl7.read(path, columns=hl7.specimen_lines(F.lit(position)))).collect()]
        assert got == expected


def test_hl7_other_delimiters(spark):
    text = "MSH!*~\\&!A!F\rOBR!1!!ACC\rOBX!1!NM!W*x!!5!mg*y\rOBX|1|NM|skipped||6"
    row = hl7.established(hl7.observations(hl7.patient_groups(messages(spark, text)))).collect()
    assert [(r.accession, r.test_code, r.raw_value, r.units) for r in row] == [("ACC", "W", "5", "mg")]


def test_structured_numbers(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([">^100", "^1^:^128", "=^5.5", "7", "~^3"])], "i int, v string").orderBy("i")
    got = rows.select(hl7.structured_number(F.col("v"), F.lit("^")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [(">", "100"), (None, ""), (None, "5.5"), ("7", ""), ("~", "")]


def test_hostile_inputs_stay_linear(spark):
    start = time.time()
    wide = "H|\\^&\rO|1|S\rR|1|T|" + "^" * 200_000 + "5"
    assert astm.established(astm.result_records(messages(spark, wide))).count() == 1
    many = "MSH|^~\\&|A|F\rPID|" + "|" * 150_000 + "\r" + "\r".join(f"NTE|{i}||n" for i in range(4_000)) + "\rOBX|1|NM|W||5"
    assert hl7.established(hl7.observations(hl7.patient_groups(messages(spark, many)))).count() == 1
    assert time.time() - start < 60


def test_off_scale_reading_by_declared_parts(spark):
    """Hand-derived: a call with a flag at the end of its range says a limit; a record with neither call nor number says nothing."""
    ref = lambda field, component=0: F.struct(F.lit("R").alias("segment"), F.lit(field).alias("field"), F.lit(component).alias("component"), F.lit(0).alias("sub"))
    places = {"testCode": ref(3, 4), "call": ref(4, 1), "number": ref(4, 2), "unit": ref(5), "range": ref(6), "flag": ref(7), "status": ref(9), "completed": ref(13)}
    parts = F.struct(*[places.get(p, ref(30)).alias(p) for p in ASTM_PARTS])
    text = "H|\\^&\rO|1|S1\rR|1|^^^VL|DETECTED^|copies/mL|40.00 to 10000000.00|<||F||||20221115084008\rR|2|^^^VL|^\rR|3|^^^VL|DETECTED^|copies/mL|40.00 to 10000000.00|>||F\rR|4|^^^VL|^1009.64|copies/mL||N||F"
    rows = astm.result_records(messages(spark, text)).withColumns({"parts": parts, "decimal_separator": F.lit("."), "flag": F.lit(None).cast("string")})
    got = astm.with_parts(rows).orderBy("record_no").select("record_no", "call", "number", "comparator", "lim", "units", "flags", "status", "effective").collect()
    assert [tuple(r) for r in got] == [
        (0, "DETECTED", None, "<", "40.00", "copies/mL", [], "F", "2022-11-15T08:40:08Z"), (2, "DETECTED", None, ">", "10000000.00", "copies/mL", [], "F", None),
        (3, None, "1009.64", None, None, "copies/mL", ["N"], "F", None)]
