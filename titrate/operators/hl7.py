"""HL7 v2 segments -> results, without a shuffle.

As with ASTM, each message is one row and its text is cut at segment boundaries, so "the last whole segment of
each type before this observation" is known before anything is exploded. Only the segment types passed in are
carried to the observations; ``named_segments`` gives those that some reading asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_dimension
from ..functions.text import (
    blank_to_null, canonical_number, clip, computed_once, empty_to_null, filled, is_bounded_decimal, let, literal_pattern, part,
    pieces,
)
from ..functions.times import hl7_time
from ..schemas import HL7_PARTS

UNKNOWN_ACCESSION = "HL7-UNKNOWN"
CONTEXT = ("MSH", "PID", "PV1", "ORC", "OBR", "SPM", "NTE")
ENDS_SPECIMEN = "(?:OBX|OBR|ORC|PID|MSH)"
SN_SIGNS = ("", "=", "<", ">", "<=", ">=")
PRECEDING, FOLLOWING = "PRECEDING", "FOLLOWING_OBX"


def lines(raw: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(raw, "\r\n|\n", "\r"), "\r"), filled)


def segments(messages: DataFrame) -> DataFrame:
    """one row per readable segment (four characters or more, the message's own field separator)."""
    rows = messages.select(
        "message_id",
        F.posexplode(lines(F.col("raw_text"))).alias("seq", "line"),
        _separator(_header_line(lines(F.col("raw_text"))), 4, "|").alias("fs"),
    )
    return rows.filter((F.length("line") >= 4) & (F.substring("line", 4, 1) == F.col("fs"))).select(
        "message_id", "seq", F.substring("line", 1, 3).alias("rec_type"), "line"
    )


def _header_line(all_lines: Column) -> Column:
    return F.get(F.filter(all_lines, lambda l: l.startswith("MSH") & (F.length(l) >= 8)), F.lit(0))


def _separator(header: Column, position: int, default: str) -> Column:
    return F.coalesce(empty_to_null(F.substring(header, position, 1)), F.lit(default))


def patient_groups(messages: DataFrame, *carry: str) -> DataFrame:
    """each PID opens a group behind the header segments; a message without or with one PID is one group."""
    cut = F.split(F.concat(F.lit("\r"), F.array_join(lines(F.col("raw_text")), "\r")), "\r(?=PID)")
    rows = messages.select("message_id", *carry, "raw_text", cut.alias("_cut")).select(
        "message_id", *carry, "raw_text", "_cut", F.substring(F.get("_cut", F.lit(0)), 2, 2_000_000_000).alias("_head")
    )
    lead = F.when(F.col("_head") == "", "").otherwise(F.concat(F.col("_head"), F.lit("\r")))
    texts = F.when(F.size("_cut") == 1, F.array(F.col("_head"))).otherwise(
        F.transform(F.slice("_cut", F.lit(2), F.size("_cut")), lambda body: F.concat(lead, body))
    )
    n_groups = F.greatest(F.size("_cut") - 1, F.lit(1))
    whole = F.when(n_groups == 1, F.sha2("raw_text", 256))
    return rows.select(
        "message_id", *carry, n_groups.alias("n_groups"), whole.alias("_whole"),
        F.posexplode_outer(texts).alias("_g", "group_text"),
    ).select(
        "message_id", *carry, "n_groups", (F.col("_g") + 1).alias("group_no"), "group_text",
        F.coalesce(F.col("_whole"), F.sha2("group_text", 256)).alias("content_hash"),
    )


def _cut(text: Column, segment: str, fs: Column) -> Column:
    """Cut before each segment of the type. Groups hold no LF, so that the cut needs no regular expression."""
    return F.split(F.replace(text, F.concat(F.lit(f"\r{segment}"), fs), F.concat(F.lit(f"\n{segment}"), fs)), "\n")


def _head(block: Column) -> Column:
    return F.substring_index(block, "\r", 1)


def fields_of(line: Column, fs: Column) -> Column:
    """Fields of a segment line (element 0 is the segment name)."""
    return F.when(fs == "|", F.split(line, r"\|")).otherwise(F.split(line, literal_pattern(fs)))


def nth(fields: Column, position: int) -> Column:
    return F.coalesce(F.get(fields, F.lit(position)), F.lit(""))


def obr_accession(fields: Column) -> Column:
    """OBR-3, else OBR-2."""
    return F.coalesce(
        empty_to_null(clip(blank_to_null(F.get(fields, F.lit(3))))),
        empty_to_null(clip(blank_to_null(F.get(fields, F.lit(2))))),
    )


def sectioned(groups: DataFrame, *carry: str) -> DataFrame:
    """groups with their delimiters and the text restricted to readable lines."""
    keys = ("message_id", "group_no", "n_groups", "content_hash")
    all_lines = F.split("group_text", "\r")
    rows = groups.select(*keys, *carry, all_lines.alias("_lines"), _header_line(all_lines).alias("_h"))
    return rows.select(
        *keys, *carry,
        F.concat(F.lit("\r"), F.array_join(F.filter("_lines", lambda l: F.length(l) >= 4), "\r")).alias("_text"),
        _separator(F.col("_h"), 4, "|").alias("fs"),
        _separator(F.col("_h"), 5, "^").alias("cs"),
        _separator(F.col("_h"), 6, "~").alias("rs"),
        _separator(F.col("_h"), 8, "&").alias("ss"),
    ).withColumn("std", (F.col("cs") == "^") & (F.col("rs") == "~") & (F.col("ss") == "&"))


def _last_line(text: Column, segment: str, fs: Column) -> Column:
    cut = _cut(text, segment, fs)
    return F.when(F.size(cut) > 1, _head(F.get(cut, F.size(cut) - 1)))


def headers(groups: DataFrame, *carry: str) -> DataFrame:
    """Accession (last OBR) and the last PID line of each group; delimiters and text stay for part reading."""
    rows = sectioned(groups, *carry)
    fs = F.col("fs")
    return rows.withColumn(
        "accession",
        F.coalesce(obr_accession(fields_of(_last_line(F.col("_text"), "OBR", fs), fs)), F.lit(UNKNOWN_ACCESSION)),
    ).withColumn("last_patient", fields_of(_last_line(F.col("_text"), "PID", fs), fs))


def named_segments(readings: DataFrame) -> tuple[str, ...]:
    """Segment types that readings name in declared parts, selections and rules, and those every reading needs.

    The profiles name them: types have three characters, so that few come to the driver whatever the number of connections.
    """
    parts = [F.col(f"hl7_parts.{p}.segment") for p in HL7_PARTS]
    named = readings.select(F.explode(F.concat(
        F.array(F.col("selection_target.segment"), *parts), F.coalesce(F.transform("rules", lambda r: r["target"]["segment"]), F.array().cast("array<string>")))).alias("s"))
    found = {r["s"] for r in named.filter("s IS NOT NULL AND length(s) = 3").distinct().collect()}
    return tuple(sorted((found | {"OBR", "SPM"}) - {"OBX"}))


def observations(
    groups: DataFrame, *carry: str, context: tuple[str, ...] = CONTEXT, descriptor_refs: DataFrame | None = None
) -> DataFrame:
    """one row per OBX with ``ctx_<SEG>`` field arrays (nearest preceding segment of each type), the lines
    after it and its specimen id. With ``descriptor_refs`` (connection_id, descriptor_ref) the group's specimen
    descriptor comes along."""
    keys = ("message_id", "group_no", "n_groups", "content_hash")
    rows = headers(groups, *carry)
    if descriptor_refs is not None:
        rows = join_dimension(rows, descriptor_refs, ["connection_id"]).withColumn(
            "descriptor", specimen_descriptor(F.col("descriptor_ref")))
        carry = (*carry, "descriptor")
    fs = F.col("fs")

    def context_of_each(segment: str) -> Column:
        return F.flatten(
            F.transform(
                _cut(F.col("_text"), segment, fs),
                lambda block, i: F.array_repeat(
                    F.struct(F.when(i > 0, fields_of(_head(block), fs)).alias("fields")),
                    F.size(_cut(F.concat(F.lit("\r"), block), "OBX", fs)) - 1,
                ),
            )
        )

    cut = _cut(F.col("_text"), "OBX", fs)
    zipped = F.arrays_zip(
        F.slice(cut, F.lit(2), F.size(cut)).alias("block"),
        *[context_of_each(s).alias(f"ctx_{s}") for s in context],
    )
    entries = F.transform(
        zipped,
        lambda e: F.struct(
            fields_of(_head(e["block"]), fs).alias("ctx_OBX"),
            F.substring(e["block"], F.length(_head(e["block"])) + 1, F.length(e["block"])).alias("following"),
            *[e[f"ctx_{s}"]["fields"].alias(f"ctx_{s}") for s in context],
            obr_accession(e["ctx_OBR"]["fields"]).alias("specimen_id"),
        ),
    )
    # Split into fields before the explode: the explode is the point behind which nothing is computed twice.
    return rows.select(
        *keys, *carry, "accession", "last_patient", "fs", "cs", "rs", "ss", "std",
        F.posexplode_outer(entries).alias("obs_no", "_e"),
    ).filter(F.col("obs_no").isNotNull()).select(
        *keys, *carry, "accession", "last_patient", "fs", "cs", "rs", "ss", "std", "obs_no", "_e.*"
    )


def path_text(fields: Column, is_header: Column, field_no: Column, component: Column, sub: Column) -> Column:
    """text of a field path in one segment; components come from the first repetition; '' when absent."""
    fs, cs, rs, ss = (F.col(c) for c in ("fs", "cs", "rs", "ss"))
    position = F.when(is_header, field_no - 1).otherwise(field_no)
    whole = F.when(is_header & (field_no == 1), fs).otherwise(F.get(fields, position))
    has_parts = ~(is_header & (field_no <= 2))

    def leaf(text: Column, repetition, comp, subcomp) -> Column:
        piece = part(part(text, repetition, 1), comp, component)
        return F.when(sub == 0, piece).otherwise(part(piece, subcomp, sub))

    def chosen(text: Column) -> Column:
        return F.when(component == 0, text).when(
            has_parts, F.when(F.col("std"), leaf(text, "~", "^", "&")).otherwise(leaf(text, rs, cs, ss))
        )

    return F.coalesce(clip(let(whole, chosen)), F.lit(""))


def read(ref: Column, context: tuple[str, ...] = CONTEXT, columns: dict[str, Column] | None = None) -> Column:
    """The text a reference struct (segment, field, component, sub) names at this observation; '' when absent."""
    columns = columns or {}
    fields = F.lit(None).cast("array<string>")
    for segment in reversed(("OBX", *context)):
        source = columns.get(segment, F.col(f"ctx_{segment}"))
        fields = F.when(ref["segment"] == segment, source).otherwise(fields)
    return path_text(fields, ref["segment"] == "MSH", ref["field"], ref["component"], ref["sub"])


def specimen_lines(position: Column) -> dict[str, Column]:
    """the SPM line that counts for recognition: nearest before the OBX, or bound after it."""
    tail = F.get(F.split("following", rf"\r(?={ENDS_SPECIMEN})"), F.lit(0))
    after = fields_of(_last_line(tail, "SPM", F.col("fs")), F.col("fs"))
    return {"SPM": F.when(position == FOLLOWING, after).otherwise(F.col("ctx_SPM"))}


def specimen_at_reading(position: Column) -> dict[str, Column]:
    """With FOLLOWING_OBX no specimen is known yet when the observation itself is read."""
    return {"SPM": F.when(position != FOLLOWING, F.col("ctx_SPM"))}


def received(target: Column, mode: Column, excluded: Column) -> Column:
    """EXCLUDE leaves out observations whose target field holds a listed value."""
    return F.coalesce((mode != "EXCLUDE") | ~F.array_contains(excluded, target), F.lit(True))


def established(obs: DataFrame) -> DataFrame:
    """the reading without declared parts."""
    cs = F.col("cs")
    fields = F.col("ctx_OBX")
    identifier = nth(fields, 3)
    last_filled = F.try_element_at(F.filter(F.split(identifier, literal_pattern(cs)), filled), F.lit(-1))
    rows = (
        obs.withColumn(
            "test_code",
            F.coalesce(
                clip(blank_to_null(part(identifier, cs, 1))),
                clip(blank_to_null(part(identifier, cs, 4))),
                clip(last_filled),
            ),
        )
        .withColumn("raw_value", empty_to_null(clip(nth(fields, 5))))
        .filter(F.col("test_code").isNotNull() & F.col("raw_value").isNotNull())
    )
    numeric = clip(nth(fields, 2)).isin("NM", "SN") & is_bounded_decimal(F.col("raw_value"))
    return rows.withColumn("is_numeric", numeric).withColumn(
        "units", F.when(F.col("is_numeric"), empty_to_null(clip(part(nth(fields, 6), cs, 1))))
    )


def structured_number(value: Column, cs: Column) -> Column:
    """(sign, number text) of comparator^number^separator^number; a ratio or range is no single number."""

    def of_pieces(p: Column) -> Column:
        sign = clip(F.get(p, F.lit(0)))
        single = ~filled(F.get(p, F.lit(2))) & sign.isin(*SN_SIGNS) & (F.size(p) > 1)
        return F.struct(
            F.when(~sign.isin("", "="), sign).alias("sign"),
            F.when(single, clip(F.get(p, F.lit(1)))).otherwise("").alias("number"),
        )

    return let(F.when(cs == "^", pieces(value, "^")).otherwise(pieces(value, cs)), of_pieces)


def with_parts(obs: DataFrame, context: tuple[str, ...] = CONTEXT, keep_flags: bool = False) -> DataFrame:
    """the reading by declared parts. Needs ``hl7_parts``, ``decimal_separator``, ``specimen_position``."""
    cs, rs = F.col("cs"), F.col("rs")
    at_reading = specimen_at_reading(F.col("specimen_position"))
    on_result = [p for p in HL7_PARTS if p not in ("note", "patientId", "patientName", "specimenDescriptor")]
    rows = computed_once(obs, {f"p_{p}": read(F.col(f"hl7_parts.{p}"), context, at_reading) for p in on_result})
    says = (F.col("p_testCode") != "") & (F.col("p_value") != "")
    rows = rows.filter(says | F.col("flag").isNotNull() if keep_flags else says)
    value_type = clip(nth(F.col("ctx_OBX"), 2))
    value = F.col("p_value")
    is_sn = value_type == "SN"
    rows = computed_once(rows, {"_sn": is_sn, "_s": F.when(is_sn, structured_number(value, cs))}).withColumns(
        {
            "_canonical": canonical_number(
                F.when(F.col("_sn"), F.col("_s.number")).otherwise(value), F.col("decimal_separator")
            ),
            "_sign": F.col("_s.sign"),
        }
    ).withColumn("is_numeric", value_type.isin("NM", "SN") & is_bounded_decimal(F.col("_canonical")))
    numeric = F.col("is_numeric")
    flags = F.filter(
        F.transform(F.split("p_flag", literal_pattern(rs)), lambda f: clip(f)), lambda f: f != ""
    )
    return rows.withColumns(
        {
            "test_code": F.col("p_testCode"),
            "sub_identity": F.col("p_subIdentity"),
            "raw_value": F.when(numeric & F.col("_sn"), F.col("_canonical")).otherwise(value),
            "reported_value": value,
            "call": F.when(~numeric, value),
            "number": F.when(numeric, F.col("_canonical")),
            "comparator": F.when(numeric, F.col("_sign")),
            "lim": F.lit(None).cast("string"),
            "range_text": empty_to_null(F.col("p_range")),
            "flags": flags,
            "assay_name": F.lit(None).cast("string"),
            "assay_version": F.lit(None).cast("string"),
            "operator": empty_to_null(F.col("p_operator")),
            "instrument": empty_to_null(F.col("p_instrument")),
            "status": empty_to_null(F.col("p_status")),
            "units": F.when(numeric, empty_to_null(F.col("p_unit"))),
            "effective": hl7_time(F.col("p_completed")),
        }
    ).drop("_canonical", "_sign", "_sn", "_s")


def notes(note_ref: Column, position: Column) -> Column:
    """F16: NTE texts that belong to the observation.

    Specimen before: the unbroken run of NTE and SPM segments after the OBX. Specimen after: every NTE until the
    next observation, order, patient or header segment.
    """
    run = F.get(F.split("following", r"\r(?!NTE|SPM|\z)"), F.lit(0))
    until_boundary = F.get(F.split("following", rf"\r(?={ENDS_SPECIMEN})"), F.lit(0))
    span = F.when(position == FOLLOWING, until_boundary).otherwise(run)
    comments = F.filter(F.split(span, "\r"), lambda l: l.startswith(F.concat(F.lit("NTE"), F.col("fs"))))
    texts = F.transform(
        comments,
        lambda l: path_text(fields_of(l, F.col("fs")), F.lit(False), note_ref["field"], note_ref["component"], note_ref["sub"]),
    )
    return F.filter(texts, lambda t: t != "")


def patient(id_ref: Column, name_ref: Column) -> Column:
    """(identifier, family, given) of the last PID segment."""
    line = F.col("last_patient")

    def piece(ref: Column, index: int | None) -> Column:
        component, sub = ref["component"], ref["sub"]
        if index is not None:
            sub = F.when(component > 0, F.lit(index)).otherwise(0)
            component = F.when(ref["component"] > 0, ref["component"]).otherwise(index)
        return path_text(line, F.lit(False), ref["field"], component, sub)

    identifier, family, given = piece(id_ref, None), piece(name_ref, 1), piece(name_ref, 2)
    any_part = (identifier != "") | (family != "") | (given != "")
    return F.when(
        line.isNotNull() & any_part,
        F.struct(
            empty_to_null(identifier).alias("identifier"),
            empty_to_null(family).alias("family"),
            empty_to_null(given).alias("given"),
        ),
    )


def specimen_descriptor(ref: Column) -> Column:
    """last non-empty descriptor seen in the group (over ``headers`` rows)."""
    fs = F.col("fs")
    of_type = F.filter(
        F.split("_text", "\r"), lambda l: l.startswith(F.concat(ref["segment"], fs))
    )
    texts = F.transform(
        of_type, lambda l: path_text(fields_of(l, fs), ref["segment"] == "MSH", ref["field"], ref["component"], ref["sub"])
    )
    return F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(-1))


def name_beside(code_ref: Column) -> Column:
    """Reference to the component after a three-part code path; NULL otherwise."""
    return F.when(
        (code_ref["component"] > 0) & (code_ref["sub"] == 0),
        F.struct(
            code_ref["segment"].alias("segment"), code_ref["field"].alias("field"),
            (code_ref["component"] + 1).alias("component"), code_ref["sub"].alias("sub"),
        ),
    )


def flag_reading(obs: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """what an observation says as a sample flag (struct, or NULL for an ordinary result)."""
    from .astm import flag_of

    at_reading = specimen_at_reading(F.col("specimen_position"))
    rows = computed_once(
        obs,
        {
            "_code": read(F.col("hl7_parts.testCode"), context, at_reading),
            "_name": read(name_beside(F.col("hl7_parts.testCode")), context, at_reading),
            "_value": read(F.col("hl7_parts.value"), context, at_reading),
        },
    )
    return rows.withColumn("flag", flag_of(F.col("_code"), F.col("_name"), F.col("_value"))).drop(
        "_code", "_name", "_value"
    )
