"""Profile documents -> dimension tables and the per-connection reading.

A catalog is one row per (profile_id, revision) with the JSON body. ``read`` parses it once; each dimension is an
explode of the parsed document, and ``reading`` keeps the same facts as arrays inside the profile's own row, so
that a result can be interpreted after a single equi join on its connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clip, filled, safe_pattern
from ..schemas import ASTM_PARTS, HL7_PARTS, PROFILE

LOINC = "http://loinc.org"
PIN = ("profile_id", "revision")
ASTM_REFERENCE = r"\A([A-Z])\.([1-9][0-9]*)(?:\.([1-9][0-9]*))?\z"
HL7_REFERENCE = r"\A(OBX|OBR|PID|NTE|SPM)\.([1-9][0-9]*)(?:\.([1-9][0-9]*))?(?:\.([1-9][0-9]*))?\z"
ANY_PATH = r"\A([A-Z][A-Z0-9]*)\.([1-9][0-9]*)(?:\.([1-9][0-9]*))?(?:\.([1-9][0-9]*))?\z"


def read(profiles: DataFrame) -> DataFrame:
    """Parsed catalog: pin columns, body and ``doc``; documents that do not parse have a NULL ``doc``."""
    parsed = F.from_json("body", PROFILE, {"mode": "PERMISSIVE"})
    readable = F.try_parse_json("body").isNotNull()
    return profiles.withColumn("doc", F.when(readable, parsed))


def _or_empty(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.array().cast(kind))


def _strings(array: Column) -> Column:
    return _or_empty(array, "array<string>")


def tests(parsed: DataFrame) -> DataFrame:
    """One row per declared test, in declared order."""
    return parsed.select(*PIN, F.posexplode("doc.default_test_mappings").alias("ord", "test"))


def aliases(parsed: DataFrame) -> DataFrame:
    """Instrument alias -> profile code; a later declaration of the same alias replaces an earlier one."""
    rows = tests(parsed).select(*PIN, "ord", F.col("test.test_code").alias("profile_code"),
                                F.posexplode("test.aliases").alias("alias_ord", "instrument_code"))
    return rows.groupBy(*PIN, "instrument_code").agg(
        F.max_by("profile_code", F.struct("ord", "alias_ord")).alias("profile_code")
    )


def code_map(parsed: DataFrame, connections: DataFrame) -> DataFrame:
    """Per connection, instrument code -> profile code; an override replaces an alias of the same text."""
    pinned = connections.select("connection_id", *PIN)
    declared = pinned.join(aliases(parsed), list(PIN)).select(
        "connection_id", "instrument_code", "profile_code", F.lit(0).alias("rank"), F.lit(0).alias("ord")
    )
    overrides = connections.select(
        "connection_id", F.posexplode(F.map_entries("code_overrides")).alias("ord", "o")
    ).select(
        "connection_id", clip(F.col("o.value")).alias("instrument_code"), F.col("o.key").alias("profile_code"),
        F.lit(1).alias("rank"), "ord",
    )
    return (
        declared.unionByName(overrides)
        .groupBy("connection_id", "instrument_code")
        .agg(F.max_by("profile_code", F.struct("rank", "ord")).alias("profile_code"))
    )


def override_issues(parsed: DataFrame, connections: DataFrame) -> DataFrame:
    """Undeclared code, blank instrument code, code used by another test, code given to two tests."""
    overrides = connections.select(
        "connection_id", *PIN, F.posexplode(F.map_entries("code_overrides")).alias("ord", "o")
    ).select("connection_id", *PIN, "ord", F.col("o.key").alias("profile_code"),
             clip(F.col("o.value")).alias("instrument_code"))
    declared = parsed.select(
        *PIN, F.transform("doc.default_test_mappings", lambda t: t["test_code"]).alias("codes"),
        F.flatten(F.transform("doc.default_test_mappings", lambda t: F.transform(
            F.concat(F.array(t["test_code"]), _strings(t["aliases"])),
            lambda a: F.struct(a.alias("text"), t["test_code"].alias("owner"))))).alias("owners"),
    )
    rows = overrides.join(declared, list(PIN), "left")
    owner = F.try_element_at(
        F.filter("owners", lambda e: e["text"] == F.col("instrument_code")), F.lit(-1)
    )["owner"]
    uses = overrides.groupBy("connection_id", "instrument_code").agg(F.min("ord").alias("first_ord"))
    rows = rows.join(uses, ["connection_id", "instrument_code"], "left")
    issue = (
        F.when(~F.coalesce(F.array_contains("codes", F.col("profile_code")), F.lit(False)), "undeclared_code")
        .when(~filled(F.col("instrument_code")), "blank_code")
        .when(owner != F.col("profile_code"), "used_by_other_test")
        .when(F.col("ord") > F.col("first_ord"), "given_twice")
    )
    return rows.select("connection_id", "profile_code", "instrument_code", issue.alias("issue")).filter(
        F.col("issue").isNotNull()
    )


def loinc_of(test: Column) -> Column:
    """Declared LOINC, else the first LOINC coding."""
    coded = F.get(F.filter(test["codings"], lambda c: c["system"] == LOINC), F.lit(0))["code"]
    return F.coalesce(F.when(test["loinc"] != "", test["loinc"]), coded)


def loinc_map(parsed: DataFrame, connections: DataFrame) -> DataFrame:
    """Per connection, (override or code, and aliases) -> LOINC."""
    rows = tests(parsed).withColumn("loinc", loinc_of(F.col("test"))).filter(F.col("loinc").isNotNull())
    rows = connections.select("connection_id", *PIN, "code_overrides").join(rows, list(PIN))
    own = F.coalesce(clip(F.try_element_at("code_overrides", F.col("test.test_code"))), F.col("test.test_code"))
    spelled = rows.select(
        "connection_id", "ord", "loinc",
        F.posexplode(F.concat(F.array(own), _strings(F.col("test.aliases")))).alias("pos", "instrument_code"),
    )
    return spelled.groupBy("connection_id", "instrument_code").agg(
        F.max_by("loinc", F.struct("ord", "pos")).alias("loinc"), F.min(F.struct("ord", "pos")).alias("first_seen")
    )


def loinc_of_result(results: DataFrame, loincs: DataFrame, codes: DataFrame) -> DataFrame:
    """LOINC of a result already under its profile code: direct, else through an instrument code of it."""
    direct = loincs.select("connection_id", F.col("instrument_code").alias("test_code"), F.col("loinc").alias("_direct"))
    via = (
        codes.join(loincs, ["connection_id", "instrument_code"])
        .groupBy("connection_id", F.col("profile_code").alias("test_code"))
        .agg(F.min_by("loinc", "instrument_code").alias("_via"))
    )
    return (
        results.join(direct, ["connection_id", "test_code"], "left")
        .join(via, ["connection_id", "test_code"], "left")
        .withColumn("loinc", F.coalesce("_direct", "_via"))
        .drop("_direct", "_via")
    )


def order_codes(loincs: DataFrame) -> DataFrame:
    """LOINC -> first instrument code, for orders."""
    return loincs.groupBy("connection_id", "loinc").agg(
        F.min_by("instrument_code", "first_seen").alias("instrument_code")
    )


def components(parsed: DataFrame) -> DataFrame:
    """One row per (test, sub-identity)."""
    rows = tests(parsed).select(
        *PIN, F.col("test.test_code").alias("test_code"), F.posexplode("test.components").alias("ord", "component")
    )
    return rows.select(*PIN, "test_code", "ord", F.col("component.code").alias("code"),
                       F.coalesce("component.sub_identity", F.lit("")).alias("sub_identity"), "component")


def _definitions(doc: Column) -> Column:
    """Every definition of the document as (code, sub, values, translations, failures, codings, value_codes)."""

    def entry(code: Column, sub: Column, d: Column) -> Column:
        return F.struct(
            code.alias("code"), F.coalesce(sub, F.lit("")).alias("sub"), _strings(d["values"]).alias("values"),
            F.coalesce(F.map_entries(d["translations"]),
                       F.array().cast("array<struct<key:string,value:array<string>>>")).alias("translations"),
            _strings(d["run_failure_values"]).alias("failures"), d["codings"].alias("codings"),
            F.coalesce(F.map_entries(d["value_codes"]),
                       F.array().cast("array<struct<key:string,value:array<struct<system:string,code:string,display:string>>>>")
                       ).alias("value_codes"),
        )

    def of_test(t: Column) -> Column:
        own = F.array(entry(t["test_code"], F.lit(""), t))
        # A component without a sub-identity is the test's own record: it adds failures but defines nothing.
        parts = F.transform(
            F.filter(t["components"], lambda c: F.coalesce(c["sub_identity"], F.lit("")) != ""),
            lambda c: entry(t["test_code"], c["sub_identity"], c),
        )
        return F.when(t["components"].isNull(), own).otherwise(F.concat(own, parts))

    return F.flatten(F.transform(doc["default_test_mappings"], of_test))


def _failures(doc: Column) -> Column:
    """D09 as an array of (code, sub, value): declared failure values and their translations."""

    def spelled(code: Column, sub: Column, d: Column) -> Column:
        return F.flatten(
            F.transform(
                _strings(d["run_failure_values"]),
                lambda v: F.transform(
                    F.concat(F.array(v), _strings(F.try_element_at(d["translations"], v))),
                    lambda text: F.struct(code.alias("code"), sub.alias("sub"), text.alias("value")),
                ),
            )
        )

    def of_test(t: Column) -> Column:
        names = F.concat(F.array(t["test_code"]), _strings(t["aliases"]))
        parts = F.coalesce(
            F.flatten(F.transform(t["components"], lambda c: spelled(
                t["test_code"], F.coalesce(c["sub_identity"], F.lit("")), c))),
            F.array().cast("array<struct<code:string,sub:string,value:string>>"),
        )
        base = F.concat(spelled(t["test_code"], F.lit(""), t), parts)
        return F.flatten(F.transform(names, lambda n: F.transform(base, lambda b: F.struct(
            n.alias("code"), b["sub"].alias("sub"), b["value"].alias("value")))))

    return F.flatten(F.transform(doc["default_test_mappings"], of_test))


def run_failures(parsed: DataFrame) -> DataFrame:
    """(code or alias, sub-identity, value) that mean a failed run."""
    return parsed.select(*PIN, F.explode(_failures(F.col("doc"))).alias("f")).select(
        *PIN, F.col("f.code").alias("code"), F.col("f.sub").alias("sub_identity"), F.col("f.value").alias("value")
    ).distinct()


def _spellings(definition: Column) -> Column:
    own = F.transform(definition["values"], lambda v: F.struct(v.alias("text"), v.alias("canonical")))
    translated = F.flatten(F.transform(definition["translations"], lambda e: F.transform(
        e["value"], lambda s: F.struct(s.alias("text"), e["key"].alias("canonical")))))
    return F.concat(own, translated)


def answers(parsed: DataFrame) -> DataFrame:
    """Spelling -> canonical answer; ``ambiguous`` when one spelling has two answers."""
    rows = parsed.select(*PIN, F.explode(_definitions(F.col("doc"))).alias("d"))
    rows = rows.select(*PIN, F.col("d.code").alias("test_code"), F.col("d.sub").alias("sub_identity"),
                       F.explode(_spellings(F.col("d"))).alias("s"))
    return rows.groupBy(*PIN, "test_code", "sub_identity", F.col("s.text").alias("spelling")).agg(
        F.min("s.canonical").alias("canonical"),
        (F.min("s.canonical") != F.max("s.canonical")).alias("ambiguous"),
    )


def value_codes(parsed: DataFrame) -> DataFrame:
    """Codes of each canonical answer."""
    rows = parsed.select(*PIN, F.explode(_definitions(F.col("doc"))).alias("d"))
    rows = rows.select(*PIN, F.col("d.code").alias("test_code"), F.col("d.sub").alias("sub_identity"),
                       F.explode("d.value_codes").alias("e"))
    return rows.select(*PIN, "test_code", "sub_identity", F.col("e.key").alias("answer"),
                       F.posexplode("e.value").alias("ord", "c")).filter(
        F.col("c.system").isNotNull() & F.col("c.code").isNotNull()
    ).select(*PIN, "test_code", "sub_identity", "answer", "ord", F.col("c.system").alias("system"),
             F.col("c.code").alias("code"), F.col("c.display").alias("display"))


def codings(parsed: DataFrame) -> DataFrame:
    """Codings of tests and components, one row per (system, code), first display kept."""
    rows = parsed.select(*PIN, F.explode(_definitions(F.col("doc"))).alias("d"))
    rows = rows.select(*PIN, F.col("d.code").alias("test_code"), F.col("d.sub").alias("sub_identity"),
                       F.posexplode("d.codings").alias("ord", "c"))
    rows = rows.filter(filled(F.col("c.system")) & filled(F.col("c.code")))
    return rows.groupBy(*PIN, "test_code", "sub_identity", F.col("c.system").alias("system"),
                        F.col("c.code").alias("code")).agg(F.min_by("c.display", "ord").alias("display"))


def _flag_names(doc: Column) -> Column:
    return F.coalesce(
        F.transform(doc["sample_flags"]["codes"], lambda c: F.struct(
            c.alias("code"), F.try_element_at(doc["sample_flags"]["names"], c).alias("name"))),
        F.array().cast("array<struct<code:string,name:string>>"),
    )


def sample_flags(parsed: DataFrame) -> DataFrame:
    """Flag codes with their names and the value that means raised."""
    return parsed.select(*PIN, F.col("doc.sample_flags.raisedValue").alias("raised_value"),
                         F.explode(_flag_names(F.col("doc"))).alias("f")).select(
        *PIN, F.col("f.code").alias("code"), F.col("f.name").alias("name"), "raised_value").distinct()


def reference(text: Column, pattern: str) -> Column:
    """A part reference as (segment, field, component, sub), 0 for a level not given; NULL when malformed."""
    ok = text.rlike(pattern)

    def level(group: int) -> Column:
        if group == 4 and pattern == ASTM_REFERENCE:
            return F.lit(0)
        return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("int"), F.lit(0))

    return F.when(ok, F.struct(F.regexp_extract(text, pattern, 1).alias("segment"), level(2).alias("field"),
                               level(3).alias("component"), level(4).alias("sub")))


def _rules(doc: Column) -> Column:
    """Declared rules in document order with their parsed target path."""
    return F.coalesce(
        F.transform(F.map_entries(doc["controlResultRecognition"]["rules"]), lambda e, i: F.struct(
            i.alias("ord"), e["key"].alias("key"), e["value"]["ruleType"].alias("rule_type"),
            blank_to_null(e["value"]["targetField"]).alias("target_field"),
            e["value"]["operand"].alias("operand"),
            blank_to_null(e["value"]["controlLevel"]).alias("control_level"),
            blank_to_null(e["value"]["controlType"]).alias("control_type"),
            reference(e["value"]["targetField"], ANY_PATH).alias("target"))),
        F.array().cast(
            "array<struct<ord:int,key:string,rule_type:string,target_field:string,operand:string,"
            "control_level:string,control_type:string,"
            "target:struct<segment:string,field:int,component:int,sub:int>>>"),
    )


def _usable_rules(doc: Column) -> Column:
    """Rules as results are judged by: a specimen pattern that does not compile finds nothing, and says so nowhere else."""
    return F.transform(_rules(doc), lambda r: r.withField("operand", F.when(r["rule_type"] == "SPECIMEN_ID_PATTERN", safe_pattern(r["operand"])).otherwise(r["operand"])))


def recognition_rules(parsed: DataFrame) -> DataFrame:
    """Rules in declared order; a NONE profile must affirm it and has no rules."""
    mode = F.col("doc.controlResultRecognition.mode")
    affirmed = F.coalesce("doc.controlResultRecognition.affirmedNoControlResults", F.lit(False))
    valid = (mode == "RULES") | ((mode == "NONE") & affirmed)
    return parsed.filter(valid).select(*PIN, mode.alias("mode"), F.explode_outer(
        F.when(mode == "RULES", _rules(F.col("doc")))).alias("r")).select(
        *PIN, "mode", F.col("r.ord").alias("ord"), F.col("r.key").alias("rule_key"),
        F.col("r.rule_type").alias("rule_type"), F.col("r.target_field").alias("target_field"),
        F.col("r.operand").alias("operand"), F.col("r.control_level").alias("control_level"))


def part_references(parsed: DataFrame) -> DataFrame:
    """One row per declared part, parsed; ``valid`` is false for a malformed reference."""
    parts = F.col("doc.configDefaults.extractionOverrides.resultParts")
    names = sorted(set(ASTM_PARTS) | set(HL7_PARTS))
    declared = F.filter(
        F.array(*[F.struct(F.lit(n).alias("part"), parts[n].alias("ref")) for n in names]),
        lambda e: F.coalesce(e["ref"], F.lit("")) != "",
    )
    is_hl7 = F.col("doc.protocol.name") == "HL7"
    rows = parsed.filter(parts.isNotNull()).select(*PIN, is_hl7.alias("_hl7"), F.explode(declared).alias("e"))
    parsed_ref = F.when(F.col("_hl7"), reference(F.col("e.ref"), HL7_REFERENCE)).otherwise(
        reference(F.col("e.ref"), ASTM_REFERENCE))
    return rows.select(*PIN, F.col("e.part").alias("part"), F.col("e.ref").alias("ref"), parsed_ref.alias("r")).select(
        *PIN, "part", "ref", F.col("r.segment").alias("segment"), F.col("r.field").alias("field"),
        F.col("r.component").alias("component"), F.col("r.sub").alias("sub"), F.col("r").isNotNull().alias("valid"))


def latest(profiles: DataFrame) -> DataFrame:
    """Latest revision per profile."""
    others = [c for c in profiles.columns if c not in PIN]
    best = profiles.groupBy("profile_id").agg(F.max_by(F.struct("revision", *others), "revision").alias("p"))
    return best.select("profile_id", "p.*")


def revision_issues(profiles: DataFrame) -> DataFrame:
    """The same (id, revision) published twice."""
    return profiles.groupBy(*PIN).agg(F.count("*").alias("copies")).filter("copies > 1")


def revision_history(profiles: DataFrame) -> DataFrame:
    """Revisions of each profile, numbered; revisions per profile are few and the key is the profile itself."""
    numbers = profiles.groupBy("profile_id").agg(F.sort_array(F.collect_set("revision")).alias("revisions"))
    return numbers.select("profile_id", F.posexplode("revisions").alias("pos", "revision")).select(
        "profile_id", "revision", (F.col("pos") + 1).alias("position"))


def display_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(clip(name), r"\s+", " "))


def duplicate_names(profiles: DataFrame) -> DataFrame:
    """Display names that differ only in case or spacing, with how many profiles share each.

    Counts first, then joins back to list the ids, so a name shared by very many profiles is never one row.
    """
    keyed = profiles.select("profile_id", display_key(F.col("display_name")).alias("name_key")).distinct()
    shared = keyed.groupBy("name_key").agg(F.count("*").alias("n_profiles")).filter("n_profiles > 1")
    return keyed.join(shared, "name_key")


def folded_codings(parsed: DataFrame) -> DataFrame:
    """The retired single coding joined into the list; a missing display is filled from it."""
    rows = tests(parsed)
    retired = F.col("test.normalized_coding")
    usable = retired["system"].isNotNull() & retired["code"].isNotNull()
    every = F.concat(
        F.coalesce(F.col("test.codings"), F.array().cast("array<struct<system:string,code:string,display:string>>")),
        F.when(usable, F.array(retired)).otherwise(F.array().cast("array<struct<system:string,code:string,display:string>>")),
    )
    rows = rows.select(*PIN, F.col("test.test_code").alias("test_code"), F.posexplode(every).alias("ord", "c"))
    return rows.groupBy(*PIN, "test_code", F.col("c.system").alias("system"), F.col("c.code").alias("code")).agg(
        F.min_by("c.display", F.when(F.col("c.display").isNotNull(), F.col("ord"))).alias("display"))


def column_mappings(parsed: DataFrame) -> DataFrame:
    """Header -> semantic field, in declared order."""
    return parsed.select(*PIN, F.posexplode(F.map_entries("doc.column_mapping")).alias("ord", "e")).select(
        *PIN, "ord", F.col("e.key").alias("header"), F.col("e.value").alias("field"))


def _code_values(doc: Column) -> Column:
    shape = "test_code STRING, sub_identity STRING"
    return F.coalesce(
        F.transform(F.map_entries(doc["test_code_values"]), lambda e: F.struct(
            e["key"].alias("raw"),
            F.when(e["value"].startswith("{"), F.from_json(e["value"], shape)["test_code"])
            .otherwise(e["value"]).alias("test_code"),
            F.when(e["value"].startswith("{"), F.from_json(e["value"], shape)["sub_identity"]).alias("sub_identity"))),
        F.array().cast("array<struct<raw:string,test_code:string,sub_identity:string>>"),
    )


def test_code_values(parsed: DataFrame) -> DataFrame:
    """What each raw test-code cell means: a test code, or the (test, sub-identity) of a component record."""
    return parsed.select(*PIN, F.explode(_code_values(F.col("doc"))).alias("e")).select(
        *PIN, F.col("e.raw").alias("raw"), F.col("e.test_code").alias("test_code"),
        F.col("e.sub_identity").alias("sub_identity"))


def file_test_code(doc: Column, chosen: Column) -> Column:
    """(code, error) of a file connection: the chosen code if declared, the only test, or none with a code column."""
    codes = F.transform(doc["default_test_mappings"], lambda t: t["test_code"])
    has_column = F.array_contains(F.map_values(doc["column_mapping"]), "testCode")
    chosen_ok = F.array_contains(codes, chosen)
    file = doc["protocol"]["name"] == "FILE"
    code = F.when(~file, None).when(chosen.isNotNull(), F.when(chosen_ok, chosen)).when(
        F.size(codes) == 1, F.get(codes, F.lit(0)))
    error = F.when(~file, None).when(chosen.isNotNull(), F.when(~chosen_ok, F.lit("not_declared"))).when(
        F.size(codes) == 1, None).when(has_column, None).otherwise("no_test_code_source")
    return F.struct(code.cast("string").alias("code"), error.cast("string").alias("error"))


def _parts_struct(doc: Column, names: tuple[str, ...], pattern: str) -> Column:
    parts = doc["configDefaults"]["extractionOverrides"]["resultParts"]
    return F.when(parts["testCode"].isNotNull(),
                  F.struct(*[reference(parts[n], pattern).alias(n) for n in names]))


def reading(parsed: DataFrame, chosen: Column | None = None, settings: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """D28 (profile half): everything needed to read results, as one row per pinned profile (or connection, with ``carry``).

    ``chosen``: the file-wide test code a connection selects; ``settings``: its own values by key, which go before the profile's defaults (D25).
    """
    own = (lambda key: F.try_element_at(settings, F.lit(key))) if settings is not None else (lambda key: F.lit(None).cast("string"))
    doc = F.col("doc")
    cfg = doc["configDefaults"]
    selection = cfg["extractionOverrides"]["resultRecordSelection"]
    is_hl7 = doc["protocol"]["name"] == "HL7"
    aliases_of = F.flatten(F.transform(doc["default_test_mappings"], lambda t: F.transform(
        _strings(t["aliases"]), lambda a: F.struct(a.alias("text"), t["test_code"].alias("code")))))
    loincs = F.flatten(F.transform(doc["default_test_mappings"], lambda t: F.transform(
        F.concat(F.array(t["test_code"]), _strings(t["aliases"])),
        lambda a: F.struct(a.alias("text"), t["test_code"].alias("code"), loinc_of(t).alias("loinc")))))
    return parsed.filter(doc.isNotNull()).select(
        *PIN, *carry,
        doc["protocol"]["name"].alias("expected_protocol"),
        safe_pattern(doc["identifier_pattern"]).alias("identifier_pattern"),
        F.coalesce(selection["mode"], F.when(is_hl7, "ALL")).alias("selection_mode"),
        reference(selection["targetField"], ANY_PATH).alias("selection_target"),
        _strings(selection["values"]).alias("excluded"),
        F.when(~is_hl7, _parts_struct(doc, ASTM_PARTS, ASTM_REFERENCE)).alias("parts"),
        F.when(is_hl7, _parts_struct(doc, HL7_PARTS, HL7_REFERENCE)).alias("hl7_parts"),
        F.coalesce(cfg["extractionOverrides"]["specimenPosition"], F.lit("PRECEDING")).alias("specimen_position"),
        F.substring(F.coalesce(own("numberFormat"), cfg["numberFormat"], F.lit(".")), 1, 1).alias("decimal_separator"),
        aliases_of.alias("alias_codes"), loincs.alias("loinc_codes"),
        _definitions(doc).alias("definitions"), _failures(doc).alias("failures"),
        _flag_names(doc).alias("flag_names"), doc["sample_flags"]["raisedValue"].alias("flag_raised"),
        doc["controlResultRecognition"]["mode"].alias("recognition_mode"), _usable_rules(doc).alias("rules"),
        F.map_entries(doc["column_mapping"]).alias("column_mapping"), _code_values(doc).alias("code_values"),
        F.coalesce(doc["result_value_order"], F.array(F.lit("result"))).alias("value_order"),
        doc["sheet_detection"].alias("layout"), F.coalesce(own("delimiter"), cfg["delimiter"]).alias("delimiter"),
        F.coalesce(own("skipRows").try_cast("int"), cfg["skipRows"], F.lit(0)).alias("skip_rows"),
        file_test_code(doc, F.lit(None).cast("string") if chosen is None else chosen)["code"].alias("file_test_code"),
    )


def active_connections(parsed: DataFrame, connections: DataFrame) -> DataFrame:
    """Connection x pinned profile, one row per connection, read with the connection's own values.

    Connections may carry code_overrides (map), chosen_test_code and settings (map); each is NULL where they do not.
    """
    optional = {"code_overrides": "map<string,string>", "chosen_test_code": "string", "settings": "map<string,string>"}
    for name, kind in optional.items():
        if name not in connections.columns:
            connections = connections.withColumn(name, F.lit(None).cast(kind))
    own = tuple(c for c in connections.columns if c not in PIN)
    bodies = parsed.select(*PIN, "doc")
    return reading(connections.join(bodies, list(PIN)), F.col("chosen_test_code"), F.col("settings"), own)
