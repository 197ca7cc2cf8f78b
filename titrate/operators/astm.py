"""ASTM records -> results, without a shuffle.

A message is one row, so everything that looks backwards or forwards inside it (which order a result belongs to,
which comments follow it, the last patient) is settled by cutting that row's text at record boundaries. Only then
are the result records exploded and read with plain column expressions. No window, no message-wide sort, and a
hot source or repeated message never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    blank_to_null, canonical_number, clip, clip_column, computed_once, empty_to_null, filled, is_bounded_decimal, let, part, pieces, unfused,
)
from ..functions.times import astm_time, astm_time_of
from ..schemas import ASTM_PARTS

FIELD, COMPONENT = "|", "^"
UNKNOWN_ACCESSION = "ASTM-UNKNOWN"


_BARE = r"\r([ROP])[^|\r]*(?=\r|\z)"


def _text(raw: Column) -> Column:
    """The message with every line behind one CR. A bare R, O or P line (no field separator) keeps its first letter only, which is all it says."""
    text = F.concat(F.lit("\r"), F.replace(raw, F.lit("\n"), F.lit("\r")))
    return F.when(text.rlike(_BARE), F.regexp_replace(text, _BARE, "\r$1|")).otherwise(text)


def lines(raw: Column) -> Column:
    return F.filter(F.split(raw, "[\r\n]+"), filled)


def record_type(line: Column) -> Column:
    return F.when(F.instr(line, FIELD) > 1, F.substring_index(line, FIELD, 1)).otherwise(F.substring(line, 1, 1))


def records(messages: DataFrame) -> DataFrame:
    """One row per non-blank line, typed and numbered."""
    return messages.select("message_id", F.posexplode(lines(F.col("raw_text"))).alias("seq", "line")).select(
        "message_id", "seq", record_type(F.col("line")).alias("rec_type"), "line"
    )


def fields_of(line: Column) -> Column:
    return F.split(line, r"\|")


def nth(fields: Column, position: int) -> Column:
    """1-based field, '' past the end."""
    return F.coalesce(F.get(fields, F.lit(position - 1)), F.lit(""))


def field(fields: Column, ref: Column, clipped=clip) -> Column:
    """Text at a declared (field, component) position; '' when absent or undeclared."""
    whole = F.get(fields, ref["field"] - 1)
    return F.coalesce(clipped(F.when(ref["component"] > 0, component(whole, ref["component"])).otherwise(whole)), F.lit(""))


def component(text: Column, position: Column) -> Column:
    """1-based component, '' past the end, found in the bytes of the text: delimiters added at its end keep the last component from standing in."""
    padded = F.concat(text, F.repeat(F.lit(COMPONENT), position))
    first = F.call_function("substring_index", padded, F.lit(COMPONENT), position)
    return F.substring_index(first, COMPONENT, -1)


def accession(order_line: Column) -> Column:
    """Specimen id of an order record, first component; NULL when blank."""
    return empty_to_null(clip(part(part(order_line, FIELD, 3), COMPONENT, 1)))


def _cut(text: Column, record: str) -> Column:
    """Cut before each record of the type. LF occurs nowhere else in the text, so that the cut needs no regular expression."""
    return F.split(F.replace(text, F.lit(f"\r{record}{FIELD}"), F.lit(f"\n{record}{FIELD}")), "\n")


def _count(text: Column, record: str) -> Column:
    """How many records of the type the text holds: what all their heads together are long."""
    head = f"\r{record}{FIELD}"
    return ((F.length(text) - F.length(F.replace(text, F.lit(head), F.lit("")))) / len(head)).cast("int")


def _head(block: Column) -> Column:
    return F.substring_index(block, "\r", 1)


def _last_head(blocks: Column) -> Column:
    return F.when(F.size(blocks) > 1, _head(F.get(blocks, F.size(blocks) - 1)))


def sectioned(messages: DataFrame, *carry: str) -> DataFrame:
    """Message rows with their text cut at R, O and P records (still one row per message)."""
    rows = computed_once(messages.select("message_id", *carry, "raw_text"), {"_text": _text(F.col("raw_text"))})
    rows = computed_once(rows, {"_r": _cut(F.col("_text"), "R"), "_o": _cut(F.col("_text"), "O"), "_p": _cut(F.col("_text"), "P")})
    return rows.select("message_id", *carry, "_r", "_o", "_p")


def headers(messages: DataFrame, *carry: str) -> DataFrame:
    """Message accession (the last O record) and the last O and P lines, one row per message."""
    last_o = _last_head(F.col("_o"))
    return sectioned(messages, *carry).select(
        "message_id",
        *carry,
        F.coalesce(accession(last_o), F.lit(UNKNOWN_ACCESSION)).alias("accession"),
        last_o.alias("last_order"),
        _last_head(F.col("_p")).alias("last_patient"),
    )


def result_records(messages: DataFrame, *carry: str) -> DataFrame:
    """One row per R record with its nearest preceding O record and the lines that follow it.

    Columns: message_id, carry, accession (message), last_order, last_patient, record_no, fields (of the R record),
    following, order_line, specimen_id (NULL when the order in force is absent or blank).
    """

    def order(block: Column) -> Column:
        return F.struct(_head(block).alias("line"), accession(_head(block)).alias("specimen_id"))

    order_of_each = F.flatten(
        F.transform(
            F.col("_o"),
            lambda block, i: F.array_repeat(F.when(i > 0, order(block)), _count(block, "R")),
        )
    )
    last_o = _last_head(F.col("_o"))
    # Zipped in a projection, where all but the lambda is compiled; inside the explode it would be evaluated node by node.
    rows = sectioned(messages, *carry).select(
        "message_id",
        *carry,
        F.coalesce(accession(last_o), F.lit(UNKNOWN_ACCESSION)).alias("accession"),
        last_o.alias("last_order"),
        _last_head(F.col("_p")).alias("last_patient"),
        F.arrays_zip(F.slice(F.col("_r"), F.lit(2), F.size("_r")).alias("block"), order_of_each.alias("order")).alias("_zipped"),
    )
    # The outer form keeps Catalyst from inferring a filter that would evaluate the cuts a second time.
    kept = [c for c in rows.columns if c != "_zipped"]
    rows = rows.select(*kept, F.posexplode_outer("_zipped").alias("record_no", "_e")).filter(F.col("record_no").isNotNull())
    block = F.col("_e.block")
    return rows.select(
        *kept,
        "record_no",
        fields_of(_head(block)).alias("fields"),
        F.substring(block, F.length(_head(block)) + 1, F.length(block)).alias("following"),
        F.col("_e.order.line").alias("order_line"),
        F.col("_e.order.specimen_id").alias("specimen_id"),
    )


def selected(fields: Column, mode: Column, field_no: Column, component_no: Column) -> Column:
    """ALL, or FIELD_NON_BLANK at R.field.component."""
    piece = part(F.get(fields, field_no - 1), COMPONENT, component_no)
    return (mode == "ALL") | ((mode == "FIELD_NON_BLANK") & filled(piece))


def established_code(fields: Column) -> Column:
    def of_components(c: Column) -> Column:
        whole = F.when(F.size(c) == 1, clip(F.get(c, F.lit(0))))
        return F.coalesce(
            empty_to_null(clip(F.get(c, F.lit(3)))), empty_to_null(clip(F.get(c, F.lit(1)))), empty_to_null(whole)
        )

    return let(pieces(F.get(fields, F.lit(2)), COMPONENT), of_components)


def established_value(fields: Column) -> Column:
    value = F.rtrim(nth(fields, 4), F.lit(COMPONENT))
    value = F.when(value.startswith(COMPONENT), F.substring(value, 2, 2_000_000_000)).otherwise(value)
    return empty_to_null(clip(value))


def test_time(completed: Column, started: Column) -> Column:
    """Completed, else started (plain columns): the first readable one."""
    return unfused(F.coalesce(astm_time_of(completed), astm_time_of(started)))


def established(result_rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """The reading without declared parts. Records under no order, without a code or a value are dropped."""
    fields = F.col("fields")
    rows = result_rows.filter(F.col("specimen_id").isNotNull())
    if keep is not None:
        rows = rows.filter(keep)
    rows = (
        computed_once(rows, {"test_code": established_code(fields), "raw_value": established_value(fields),
                             "_completed": clip(nth(fields, 13)), "_started": clip(nth(fields, 12))})
        .filter(F.col("test_code").isNotNull() & F.col("raw_value").isNotNull())
        .withColumn("is_numeric", is_bounded_decimal(F.col("raw_value")))
    )
    return rows.withColumn(
        "units", F.when(F.col("is_numeric"), empty_to_null(clip(nth(fields, 5))))
    ).withColumn("effective", test_time(F.col("_completed"), F.col("_started"))).drop("_completed", "_started")


def sub_identity(analyte: Column, complement: Column) -> Column:
    """Analyte, or ``analyte&complement``."""
    return F.when(complement == "", analyte).otherwise(F.concat(analyte, F.lit("&"), complement))


def off_scale_limit(range_text: Column, flag: Column) -> Column:
    """The limit an off-scale flag points at, from a range written ``a to b``."""
    ends = F.split(range_text, r"\s+to\s+")
    chosen = F.when(flag == "<", F.get(ends, F.lit(0))).otherwise(F.get(ends, F.size(ends) - 1))
    return F.when((F.size(ends) == 2) & filled(chosen), clip(chosen))


ON_RESULT = [p for p in ASTM_PARTS if p not in ("note", "patientId", "patientName", "specimenDescriptor")]


def part_texts(result_rows: DataFrame) -> DataFrame:
    """The text of every declared part of the R record (p_*); rows that hold them stay as they are."""
    if f"p_{ON_RESULT[0]}" in result_rows.columns:
        return result_rows
    return computed_once(result_rows, {f"p_{p}": field(F.col("fields"), F.col(f"parts.{p}"), clip_column) for p in ON_RESULT})


def with_parts(result_rows: DataFrame, keep: Column | None = None, keep_flags: bool = False) -> DataFrame:
    """The reading by declared parts. Needs a ``parts`` struct (D15) and ``decimal_separator``.

    Adds p_* text columns for every declared part of the R record and the interpreted parts. ``keep_flags`` lets
    records that report a sample flag through, so that one pass serves results and flags.
    """
    rows = result_rows.filter(F.col("specimen_id").isNotNull())
    if keep is not None:
        rows = rows.filter(keep)
    rows = part_texts(rows)
    says = (F.col("p_testCode") != "") & ((F.col("p_call") != "") | (F.col("p_number") != ""))
    rows = rows.filter(says | F.col("flag").isNotNull() if keep_flags else says)
    analyte = F.when(F.col("p_assayName") == "", F.col("p_analyte")).otherwise("")
    flag, number, call = F.col("p_flag"), F.col("p_number"), F.col("p_call")
    off_scale = flag.isin("<", ">")
    sep = F.col("decimal_separator")
    limit = F.when((number == "") & off_scale, off_scale_limit(F.col("p_range"), flag))
    rows = rows.withColumns(
        {
            "test_code": F.col("p_testCode"),
            "sub_identity": sub_identity(analyte, F.col("p_complement")),
            "raw_value": F.when(number == "", call).otherwise(number),
            "call": empty_to_null(call),
            "number": canonical_number(empty_to_null(number), sep),
            "comparator": F.when(off_scale, flag),
            "lim": canonical_number(limit, sep),
            "range_text": empty_to_null(F.col("p_range")),
            "flags": F.when((flag == "") | off_scale, F.array().cast("array<string>")).otherwise(F.array(flag)),
            "assay_name": empty_to_null(F.col("p_assayName")),
            "assay_version": empty_to_null(F.col("p_assayVersion")),
            "operator": F.when(F.col("p_operator") != "<None>", empty_to_null(F.col("p_operator"))),
            "instrument": empty_to_null(F.col("p_instrument")),
            "status": empty_to_null(F.col("p_status")),
            "effective": test_time(F.col("p_completed"), F.col("p_started")),
        }
    )
    quantity = F.col("number").isNotNull() | F.col("lim").isNotNull()
    return rows.withColumn("is_numeric", quantity).withColumn(
        "units", F.when(quantity, empty_to_null(F.col("p_unit")))
    )


def note_text(comment_line: Column, ref: Column) -> Column:
    """``id code: description (details) at time`` from the note part of a C record."""
    text = field(fields_of(comment_line), ref)
    piece = {i: clip(part(text, COMPONENT, i)) for i in range(1, 6)}
    at = astm_time(piece[5])
    built = F.concat(
        piece[1],
        F.when(piece[2] != "", F.concat(F.lit(" "), piece[2])).otherwise(""),
        F.when(piece[3] != "", F.concat(F.lit(": "), piece[3])).otherwise(""),
        F.when(piece[4] != "", F.concat(F.lit(" ("), piece[4], F.lit(")"))).otherwise(""),
        F.coalesce(F.concat(F.lit(" at "), F.substring(at, 1, 19)), F.lit("")),
    )
    return F.when(text == "", F.lit(None)).when(text.contains(COMPONENT), built).otherwise(text)


def notes(following: Column, ref: Column) -> Column:
    """Notes of the C records between this result and the next one, in order."""
    comments = F.filter(F.split(following, "\r"), lambda l: (l != "") & (record_type(l) == "C"))
    return F.filter(F.transform(comments, lambda l: note_text(l, ref)), lambda n: n.isNotNull())


def patient(last_patient: Column, id_ref: Column, name_ref: Column) -> Column:
    """(identifier, family, given) of the last P record; NULL when all are empty."""
    fields = fields_of(last_patient)
    identifier, name = field(fields, id_ref), field(fields, name_ref)
    family, given = clip(part(name, COMPONENT, 1)), clip(part(name, COMPONENT, 2))
    any_part = (identifier != "") | (family != "") | (given != "")
    return F.when(
        last_patient.isNotNull() & any_part,
        F.struct(
            empty_to_null(identifier).alias("identifier"),
            empty_to_null(family).alias("family"),
            empty_to_null(given).alias("given"),
        ),
    )


def specimen_descriptor(last_order: Column, ref: Column) -> Column:
    """E14."""
    return F.when(last_order.isNotNull(), empty_to_null(field(fields_of(last_order), ref)))


def flag_reading(result_rows: DataFrame) -> DataFrame:
    """What each R record says as a sample flag. Needs parts, flag_names (entries), flag_raised.

    A record is a flag when its part identity, else its test code, is a declared flag code. Adds flag (struct
    code, name, value, raised) or NULL for an ordinary result, and the texts of the parts (p_*).
    """
    rows = part_texts(result_rows)
    value = F.when(F.col("p_call") != "", F.col("p_call")).otherwise(F.col("p_number"))
    sub = sub_identity(F.when(F.col("p_assayName") == "", F.col("p_analyte")).otherwise(""), F.col("p_complement"))
    return rows.withColumn(
        "flag",
        F.coalesce(
            F.when(sub != "", flag_of(sub, F.lit(None).cast("string"), value)),
            flag_of(F.col("p_testCode"), F.col("p_assayName"), value),
        ),
    )


def flag_of(code: Column, instrument_name: Column, value: Column) -> Column:
    """The flag a code reports (code, name, value, raised); NULL when the code is no declared flag."""
    text = F.coalesce(value, F.lit(""))
    raised = F.transform(
        F.filter(F.col("flag_names"), lambda e: e["code"] == code),
        lambda e: F.struct(
            e["code"].alias("code"),
            F.coalesce(blank_to_null(e["name"]), blank_to_null(instrument_name), e["code"]).alias("name"),
            text.alias("value"),
            (text == F.col("flag_raised")).alias("raised"),
        ),
    )
    return F.when(F.array_contains(F.col("flag_names")["code"], code), F.get(raised, F.lit(0)))


def raised_flags(flag_rows: DataFrame) -> DataFrame:
    """Raised flags under an order, first occurrence of each kept per message."""
    return (
        flag_rows.filter(F.col("flag.raised") & F.col("specimen_id").isNotNull())
        .groupBy("message_id", "accession", F.col("flag.code").alias("code"), F.col("flag.name").alias("name"),
                 F.col("flag.value").alias("value"))
        .agg(F.min("record_no").alias("first_record"))
    )


def numbered(results: DataFrame, message: str = "message_id") -> DataFrame:
    """Position of each kept result in its message, from one reading of the messages.

    ``message`` tells message rows apart. A number of the row (``message_row``) keeps copies of one message, which read alike, in groups of their own.
    """
    at = Window.partitionBy(message).orderBy("record_no")
    return results.withColumn("ordinal", F.dense_rank().over(at))


def message_row() -> Column:
    """A number of the message's row, to be carried from before its records are cut."""
    return F.monotonically_increasing_id()
