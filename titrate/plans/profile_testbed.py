"""Profile documents derived from the part table: one document per part, some with one planted defect.

Which defect a document has is ``p_partkey % 40``; 30 and above have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .testbed import table, text

DEFECTS = 40


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d = k % DEFECTS
    js = lambda s: F.lit(s)

    def when(number: int, then: str, otherwise: str = ""):
        return F.when(d == number, then).otherwise(otherwise)

    coding = '{"system": "http://loinc.org", "code": "'
    values = F.concat(
        js('"values": ["POS", "NEG"], "value_codes": {"POS": [{"system": "urn:a", "code": "P1"}, {"system": "urn:b", "code": "P2", "display": "yes"}]'),
        when(13, ', "MAYBE": []'), js('}, "value_defaults": {'), when(14, '"MAYBE": "x"'),
        js('}, "translations": {"POS": ["positif'), k.cast("string"), js('"], "NEG": ["negatif"'), when(15, F.concat(js(', "positif'), k.cast("string"), js('"'))),
        js(']'), when(16, ', "MAYBE": ["peut"]'), js('}, "run_failure_values": ["ERR"'), when(12, ', "POS"'), js(']'),
    )
    components = F.concat(
        js('[{"code": "call", "result_type": "qualitative"'), when(19, ', "sub_identity": "C"'), js('}, {"code": '), when(17, '"call"', '"ct"'),
        js(', "sub_identity": "S1", "result_type": "quantitative"}, {"code": "hl", "sub_identity": '), when(18, '"S1"', '"S2"'),
        js(', "result_type": "qualitative"'), F.when(d == 21, "").otherwise(', "values": ["HI", "LO"]'), js('}]'),
    )
    second = F.concat(
        js('{"test_code": '), when(5, '"A1"', '"B1"'), js(', "aliases": ["b'), k.cast("string"), js('"'), when(6, ', "A1"'),
        js('], "result_type": "quantitative"'), when(8, ', "specimen_type_hint": "blood"'),
        js(', "codings": ['), js(coding + '2000-2"}'), when(10, ', ' + coding + '2000-3"}'), when(11, ', ' + coding + 'x1"}'),
        js(', {"system": "urn:local", "code": "L1"}, {"system": "urn:local", "code": "L1", "display": "again"}], "normalized_coding": {"system": "urn:local", "code": "L1", "display": "local one"}}'),
    )
    first = F.concat(
        js('{"test_code": "A1", "aliases": ["a'), k.cast("string"), js('", "alpha"], "loinc": "1000-1"'),
        F.when(d == 9, "").otherwise(', "result_type": "quantitative"'), F.when(d == 7, "").when(d == 20, ', "call_component": "nowhere"')
        .otherwise(', "call_component": "call"'), js(", "), values, js(', "components": '), components, js("}"),
    )
    fields = F.concat(
        js('[{"key": "transport", "inputKind": "SELECT", "required": true, "choices": [{"value": "TCP/IP"}, {"value": "RS-232"}]}, '
           '{"key": "connectionRole", "inputKind": "SELECT", "required": true, "choices": [{"value": "SERVER"}, {"value": "CLIENT"}], '
           '"visibleWhen": {"fieldKey": '), when(2, '"ghost"', '"transport"'), js(', "operator": "NOT_EQUALS", "value": "RS-232"}}, '
           '{"key": "host", "inputKind": "TEXT", "required": true, "visibleWhen": {"fieldKey": "connectionRole", "operator": "IN", "value": ["CLIENT", "PEER"]}}, '
           '{"key": "token", "inputKind": '), when(1, '"SECRET"', '"TEXT"'), js(', "required": false'),
        when(3, ', "visibleWhen": {"fieldKey": "loop", "operator": "EQUALS", "value": "x"}'), js('}, {"key": '), when(0, '"token"', '"loop"'),
        js(', "inputKind": "NUMBER", "required": false'), when(3, ', "visibleWhen": {"fieldKey": "token", "operator": "EQUALS", "value": "x"}'), js("}]"),
    )
    body = F.concat(
        js('{"schemaVersion": "2.0", "profileMeta": {"id": "p'), k.cast("string"), js('", "displayName": "Reader '), (k % 97).cast("string"),
        js('"}, "protocol": {"name": "FILE"}, "supported_extensions": [".csv"'), when(4, ', ".txt"'), when(26, ', ".zip"'),
        js('], "capabilities": {"outboundOrders": true}, "default_test_mappings": ['), first, js(", "), second,
        js('], "sample_flags": {"raisedValue": "T", "codes": ["FL"'), when(22, ', "A1"'), when(23, ', "GX"'), js('], "names": {"FL": "Flag"'),
        when(22, ', "A1": "a"'), when(24, ', "ZZ": "z"'), js('}}, "column_mapping": {"Sample": "sampleId", "Test": "testCode", "Val": "result"'),
        F.when(d == 25, "").otherwise(', "Ct": "ctValue"'), js('}, "result_value_order": ["result", "ctValue"], "test_code_values": {"one": "A1", "two": {"test_code": "A1", "sub_identity": "S1"}'),
        when(27, ', "bad": "NOPE"'), when(28, ', "worse": {"test_code": "A1", "sub_identity": "S9"}'), js('}'),
        when(29, ', "archive": {"results_entry": "r", "run_record_entry": "j", "export_name_pattern": "R(?<runId>x)", "sample_id_field": "s", "name_cells": {"serial": "B1"}}'),
        js(', "configDefaults": {"filePattern": "*.csv", "transport": "TCP/IP", "connectionRole": "SERVER"'), when(1, ', "token": "secret"'),
        js(', "extractionOverrides": {"resultParts": {"testCode": "R.3.4", "call": '), F.when(k % 7 == 0, '"R.0"').otherwise('"R.4.1"'),
        js(', "unit": "R.5"}}}, "connectionFields": '), fields,
        js(', "controlResultRecognition": '),
        F.when(k % 5 == 0, '{"mode": "NONE", "affirmedNoControlResults": true}').when(k % 5 == 1, '{"mode": "NONE"}').otherwise(F.concat(
            js('{"mode": "RULES", "rules": {"zeta": {"ruleType": "SPECIMEN_ID_PATTERN", "operand": '), F.when(k % 9 == 0, '"Q[("').otherwise('"QC\\\\d+"'),
            js('}, "alpha": {"ruleType": "FIELD_EQUALS", "targetField": "O.12", "operand": "Q", "controlLevel": "L'), (k % 3).cast("string"), js('"}}}'))),
        js("}"),
    )
    return table(spark, sf_dir, "part").select(
        text("p", k).alias("profile_id"), F.lit(1).alias("revision"), text("Reader ", k % 97).alias("display_name"), "p_size", "p_brand", body.alias("body"))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One connection per supplier, pinned to the profile of the same number; some override an instrument code."""
    k = F.col("s_suppkey")
    m = k % 6
    overrides = (
        F.when(m == 0, F.create_map(F.lit("A1"), text(" in", k, " ")))
        .when(m == 1, F.create_map(F.lit("B1"), F.lit("alpha")))
        .when(m == 2, F.create_map(F.lit("NOPE"), F.lit("x")))
        .when(m == 3, F.create_map(F.lit("A1"), F.lit("same"), F.lit("B1"), F.lit("same")))
        .when(m == 4, F.create_map(F.lit("A1"), F.lit(" ")))
    )
    return table(spark, sf_dir, "supplier").select(
        text("c", k).alias("connection_id"), text("p", k).alias("profile_id"), F.lit(1).alias("revision"), text("an", F.col("s_nationkey")).alias("analyzer_id"),
        overrides.cast("map<string,string>").alias("code_overrides"))
