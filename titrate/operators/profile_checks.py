"""Data-quality checks of profile documents: one row (profile, revision, check, path) per failing place.

Every check looks at one document at a time, so all of them are array expressions over the parsed row: no join and
no shuffle, however many profiles there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compiles, filled, glob_regex
from .profiles import LOINC, PIN, _code_values, _strings

LOINC_CODE = r"\A[0-9]{1,7}-[0-9]\z"
_TEXTS = "array<string>"


def _none() -> Column:
    return F.array().cast(_TEXTS)


def _all(*lists: Column) -> Column:
    return F.concat(*[F.coalesce(x, _none()) for x in lists])


def _prefixed(prefix: Column | str, items: Column) -> Column:
    lead = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.transform(items, lambda i: F.concat(lead, i))


def _repeated(items: Column) -> Column:
    """Items that occur more than once, each once."""
    return F.filter(F.array_distinct(items), lambda i: F.size(F.filter(items, lambda j: j == i)) > 1)


def _per_test(doc: Column, check) -> Column:
    """Concatenated findings of ``check(path, test)`` over every declared test."""
    return F.flatten(F.transform(doc["default_test_mappings"], lambda t: check(F.concat(F.lit("tests."), t["test_code"]), t)))


def _keys(m: Column) -> Column:
    return F.coalesce(F.map_keys(m), _none())


def connection_fields(doc: Column) -> Column:
    """Keys unique, no default for a secret, ``visibleWhen`` names a declared field."""
    fields = doc["connectionFields"]
    keys = F.transform(fields, lambda f: f["key"])
    secrets = F.transform(F.filter(fields, lambda f: f["inputKind"] == "SECRET"), lambda f: f["key"])
    dangling = F.transform(
        F.filter(fields, lambda f: f["visibleWhen"]["fieldKey"].isNotNull() & ~F.array_contains(keys, f["visibleWhen"]["fieldKey"])),
        lambda f: f["key"])
    return _all(_prefixed("duplicate:", _repeated(keys)),
                _prefixed("secret_default:", F.filter(secrets, lambda s: F.col("default_keys").isNotNull() & F.array_contains("default_keys", s))),
                _prefixed("undeclared:", dangling))


def field_cycles(doc: Column) -> Column:
    """Fields whose visibility depends on itself. Each field has one controller, so following every field once
    per declared field ends at the top or goes round."""
    fields = doc["connectionFields"]
    edges = F.transform(fields, lambda f: F.struct(f["key"].alias("key"), f["visibleWhen"]["fieldKey"].alias("up")))

    def climb(ups: Column) -> Column:
        return F.transform(ups, lambda u: F.get(F.filter(edges, lambda e: e["key"] == u), F.lit(0))["up"])

    start = F.transform(edges, lambda e: e["up"])
    still = F.aggregate(edges, start, lambda ups, _: climb(ups))
    return F.when(F.exists(still, lambda u: u.isNotNull()), F.array(F.lit("cycle"))).otherwise(_none())


def value_order(doc: Column) -> Column:
    """Selected value fields have a mapped column."""
    order = F.when(F.coalesce(F.size(doc["result_value_order"]), F.lit(0)) > 0, doc["result_value_order"]).otherwise(F.array(F.lit("result")))
    mapped = F.map_values(doc["column_mapping"])
    return F.when(doc["protocol"]["name"] == "FILE", F.filter(order, lambda f: ~F.coalesce(F.array_contains(mapped, f), F.lit(False))))


def code_values(doc: Column) -> Column:
    """Raw codes stand for a declared test, component or flag, and need a test-code column."""
    tests = doc["default_test_mappings"]
    declared = _all(F.transform(tests, lambda t: t["test_code"]), doc["sample_flags"]["codes"])
    pairs = F.flatten(F.filter(F.transform(tests, lambda t: F.transform(
        t["components"], lambda c: F.concat_ws("\u0001", t["test_code"], c["sub_identity"]))), lambda x: x.isNotNull()))
    entries = _code_values(doc)
    unknown = F.filter(entries, lambda e: F.when(
        e["sub_identity"].isNotNull(), ~F.coalesce(F.array_contains(pairs, F.concat_ws("\u0001", e["test_code"], e["sub_identity"])), F.lit(False))
    ).otherwise(~F.array_contains(declared, e["test_code"])))
    column = F.array_contains(F.map_values(doc["column_mapping"]), "testCode")
    lacking = F.when((F.size(entries) > 0) & ~F.coalesce(column, F.lit(False)), F.array(F.lit("column")))
    return F.when(doc["protocol"]["name"] == "FILE", _all(lacking, F.transform(unknown, lambda e: e["raw"])))


def record_kinds(doc: Column) -> Column:
    """A code is a test, a flag or left out, never two of these; flags of file profiles are named."""
    tests = F.transform(doc["default_test_mappings"], lambda t: t["test_code"])
    flags = _strings(doc["sample_flags"]["codes"])
    selection = doc["configDefaults"]["extractionOverrides"]["resultRecordSelection"]
    excluded = F.when(selection["mode"] == "EXCLUDE", _strings(selection["values"])).otherwise(_none())
    names = doc["sample_flags"]["names"]
    blank = F.transform(F.filter(F.map_entries(names), lambda e: ~filled(e["value"])), lambda e: e["key"])
    unnamed = F.when(doc["protocol"]["name"] == "FILE", F.array_except(flags, _keys(names)))
    return _all(
        _prefixed("flag_is_test:", F.array_intersect(flags, tests)), _prefixed("flag_left_out:", F.array_intersect(flags, excluded)),
        _prefixed("test_left_out:", F.array_intersect(tests, excluded)), _prefixed("blank_name:", blank),
        _prefixed("name_of_no_flag:", F.array_except(_keys(names), flags)), _prefixed("unnamed:", unnamed))


def file_pattern(doc: Column) -> Column:
    """The file glob takes every supported extension."""
    glob = doc["configDefaults"]["filePattern"]
    missed = F.filter(_strings(doc["supported_extensions"]), lambda e: ~F.rlike(F.concat(F.lit("result"), e), glob_regex(glob)))
    return F.when(doc["protocol"]["name"] == "FILE", missed)


def identities(doc: Column) -> Column:
    """Codes and aliases name one thing; value hints name declared values."""
    names = F.flatten(F.transform(doc["default_test_mappings"], lambda t: F.concat(F.array(t["test_code"]), _strings(t["aliases"]))))
    hints = F.flatten(F.transform(doc["default_test_mappings"], lambda t: F.array_except(_keys(t["result_value_hints"]), _strings(t["values"]))))
    return _all(_prefixed("name:", _repeated(names)), _prefixed("hint:", hints))


def result_descriptions(doc: Column) -> Column:
    """What the current document version asks of each test."""

    def check(path: Column, t: Column) -> Column:
        found = F.array(
            F.when(t["specimen_type_hint"].isNotNull() | t["result_value_hints"].isNotNull(), F.lit("hint")),
            F.when(t["result_type"].isNull(), F.lit("result_type")),
            F.when((t["result_type"] == "quantitative") & t["values"].isNotNull() & t["call_component"].isNull(), F.lit("call_component")),
        )
        return _prefixed(F.concat(path, F.lit(":")), F.filter(found, lambda x: x.isNotNull()))

    return F.when(doc["schemaVersion"] == "2.0", _per_test(doc, check))


def loinc_codings(doc: Column) -> Column:
    """At most one LOINC code, of LOINC's shape."""

    def check(path: Column, t: Column) -> Column:
        coded = F.transform(F.filter(t["codings"], lambda c: c["system"] == LOINC), lambda c: c["code"])
        every = F.array_distinct(_all(F.when(t["loinc"] != "", F.array(t["loinc"])), coded))
        many = F.when(F.size(every) > 1, F.array(F.concat(path, F.lit(":many"))))
        return _all(many, _prefixed(F.concat(path, F.lit(":shape:")), F.filter(every, lambda c: ~c.rlike(LOINC_CODE))))

    return _per_test(doc, check)


def _value_set(path: Column, d: Column) -> Column:
    values, failures = _strings(d["values"]), _strings(d["run_failure_values"])
    translatable = F.concat(values, failures)
    spelled = F.flatten(F.transform(
        F.filter(F.map_entries(d["translations"]), lambda e: F.array_contains(translatable, e["key"])),
        lambda e: F.transform(e["value"], lambda s: F.struct(s.alias("text"), e["key"].alias("owner")))))
    owners = F.concat(F.transform(translatable, lambda v: F.struct(v.alias("text"), v.alias("owner"))),
                      F.coalesce(spelled, F.array().cast("array<struct<text:string,owner:string>>")))
    shared = F.filter(F.array_distinct(F.transform(owners, lambda o: o["text"])), lambda s: F.size(F.array_distinct(
        F.transform(F.filter(owners, lambda o: o["text"] == s), lambda o: o["owner"]))) > 1)
    at = lambda kind: F.concat(path, F.lit(f":{kind}:"))
    return _all(
        _prefixed(at("failure_is_value"), F.array_intersect(failures, values)), _prefixed(at("value_codes"), F.array_except(_keys(d["value_codes"]), values)),
        _prefixed(at("value_defaults"), F.array_except(_keys(d["value_defaults"]), values)),
        _prefixed(at("translations"), F.array_except(_keys(d["translations"]), translatable)), _prefixed(at("two_values"), shared))


def value_sets(doc: Column) -> Column:
    """Failure values, value codes, defaults and translations of tests and components name declared values."""

    def check(path: Column, t: Column) -> Column:
        parts = F.flatten(F.transform(t["components"], lambda c: _value_set(F.concat(path, F.lit("."), c["code"]), c)))
        return _all(_value_set(path, t), parts)

    return _per_test(doc, check)


def component_rules(doc: Column) -> Column:
    """Component codes and sub-identities unique; the call component exists and has no sub-identity."""

    def check(path: Column, t: Column) -> Column:
        codes = F.transform(t["components"], lambda c: c["code"])
        subs = F.filter(F.transform(t["components"], lambda c: c["sub_identity"]), lambda s: s.isNotNull())
        wordless = F.transform(
            F.filter(t["components"], lambda c: (c["result_type"] == "qualitative") & c["sub_identity"].isNotNull() & c["values"].isNull()), lambda c: c["code"])
        named = F.get(F.filter(t["components"], lambda c: c["code"] == t["call_component"]), F.lit(0))
        call = F.when(t["call_component"].isNotNull() & named.isNull(), F.array(F.lit("call_unknown"))).when(
            named["sub_identity"].isNotNull(), F.array(F.lit("call_has_sub_identity")))
        at = lambda kind: F.concat(path, F.lit(f":{kind}:"))
        return _all(_prefixed(at("code"), _repeated(codes)), _prefixed(at("sub_identity"), _repeated(subs)), _prefixed(at("no_values"), wordless),
                    _prefixed(F.concat(path, F.lit(":")), call))

    return _per_test(doc, check)


def archive_rules(doc: Column) -> Column:
    """An archive section goes with a .zip extension; its pattern captures the groups it needs."""
    zips = F.exists(_strings(doc["supported_extensions"]), lambda e: F.lower(e) == ".zip")
    archive = doc["archive"]
    groups = F.regexp_extract_all(archive["export_name_pattern"], F.lit(r"\(\?<([A-Za-z][A-Za-z0-9]*)>"), F.lit(1))
    needed = F.concat(F.array(F.lit("sampleId")), _keys(archive["name_cells"]))
    return _all(F.when(zips != archive.isNotNull(), F.array(F.lit("zip"))),
                F.when(archive.isNotNull(), _prefixed("group:", F.array_except(needed, groups))))


CHECKS = {
    "D31": connection_fields, "D32": field_cycles, "D33": value_order, "D34": code_values, "D35": record_kinds, "D36": file_pattern,
    "D37": identities, "D38": result_descriptions, "D39": loinc_codings, "D40": value_sets, "D41": component_rules, "D42": archive_rules,
}


def with_default_keys(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("default_keys", F.json_object_keys(F.get_json_object("body", "$.configDefaults")))


def findings(parsed: DataFrame, check: str) -> DataFrame:
    """Failing paths of one check."""
    rows = with_default_keys(parsed.filter("doc IS NOT NULL"))
    return rows.select(*PIN, F.lit(check).alias("check"), F.explode(CHECKS[check](F.col("doc"))).alias("path"))


def broken_patterns(rules: DataFrame) -> DataFrame:
    """Control rules whose specimen pattern does not compile."""
    used = rules.filter("rule_type = 'SPECIMEN_ID_PATTERN'").withColumnRenamed("operand", "pattern")
    return used.filter(~compiles(F.col("pattern"))).select(*PIN, "rule_key", "pattern")
