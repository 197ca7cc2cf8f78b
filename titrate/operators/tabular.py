"""Delimited files and spreadsheet cells -> results.

A delimited file is one row whose text is cut into lines and fields in place; a workbook arrives as a table of
cells. Both end in the same per-row shape: semantic fields by declared header, then shared row rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_dimension, join_rows
from ..functions.text import blank_to_null, blank_to_null_column, canonical_number, clip, clip_column, computed_once, filled, is_bounded_decimal
from . import recognition
from .interpret import is_run_failure, profile_code

SEMANTIC = ("sampleId", "testCode", "units", "qcTask", "testDate", "result", "ctValue", "interpretation")


def text_of(content: Column) -> Column:
    """UTF-8 text of a file, bad bytes replaced, byte-order mark dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\\A\uFEFF", "")


def lines(text: Column) -> Column:
    """Lines with trailing empty ones dropped."""
    return F.split(F.regexp_replace(text, r"(?:\r?\n)+\z", ""), r"\r?\n")


def header_line(all_lines: Column, marker: Column, delimiter: Column, skip: Column, scan: Column) -> Column:
    """0-based header line: the last line in the window whose first field is the marker, else the skip count."""
    window = F.slice(all_lines, skip + 1, scan)
    hits = F.filter(
        F.transform(window, lambda l, i: F.when(
            l.contains(marker) & (clip(F.call_function("substring_index", l, delimiter, F.lit(1))) == marker), i + skip)),
        lambda i: i.isNotNull(),
    )
    return F.when(marker.isNull(), skip).otherwise(F.array_max(hits))


def _literal(delimiter: Column) -> Column:
    return F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))


def raw_fields(line: Column, delimiter: Column) -> Column:
    """Fields of one line as they stand, untrimmed; of a line with quotes each with its quotes and the delimiter behind it."""
    # A line always ends one field, so one delimiter is added and each match ends at a delimiter.
    ended = F.concat(line, delimiter)
    whole = F.regexp_extract_all(ended, F.concat(F.lit('(\\s*(?:"[^"]*+(?:""[^"]*+)*+"[^"]*?|(?:(?!'), _literal(delimiter),
                                                 F.lit(").)*?)"), _literal(delimiter), F.lit(")")), F.lit(1))
    # The usual delimiters are cut without a regular expression.
    plain = F.when(delimiter == ",", F.split(line, ",")).when(delimiter == "\t", F.split(line, "\t")).when(
        delimiter == ";", F.split(line, ";")).otherwise(F.split(line, _literal(delimiter)))
    return F.when(line.contains('"'), whole).otherwise(plain)


def _undelimited(raw: Column, quoted: Column) -> Column:
    return F.when(quoted, F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)


def _unquoted(bare: Column, quoted: Column) -> Column:
    enclosed = quoted & (F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"')
    return F.when(enclosed, clip(F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"')))).otherwise(bare)


def fields(line: Column, delimiter: Column) -> Column:
    """Trimmed fields of one line; a quoted field may hold the delimiter and doubled quotes."""
    quoted = line.contains('"')
    bare = F.transform(raw_fields(line, delimiter), lambda w: clip(_undelimited(w, quoted)))
    return F.transform(bare, lambda b: _unquoted(b, quoted))


def joined_records(rest: Column) -> Column:
    """Lines put back together where a quoted field holds line breaks (an odd number of quotes stays open)."""
    text = F.array_join(rest, "\n")
    balanced = ~text.contains('"') | F.forall(
        rest, lambda l: ~l.contains('"') | (F.pmod(F.length(l) - F.length(F.replace(l, F.lit('"'), F.lit(""))), F.lit(2)) == 0))
    records = F.regexp_extract_all(
        F.concat(text, F.lit("\n")), F.lit('((?:[^"\\n]++|"[^"]*+(?:""[^"]*+)*+")*+)\\n'), F.lit(1)
    )
    return F.when(balanced, rest).otherwise(records)


def delimited_rows(files: DataFrame, *carry: str) -> DataFrame:
    """Files beside their reading -> one row per data record.

    Needs path, content and the reading's delimiter, skip_rows and layout. Yields path, carry, row_no (1-based after
    the header), header (array) and cells (array); with the reading's column_mapping also what ``semantic_fields`` reads cells by.
    """
    # A BOM only at the start; the file's first line keeps its place even when metadata precede the header.
    delimiter = F.coalesce(F.substring("delimiter", 1, 1), F.lit(","))
    scan = F.coalesce(F.col("layout.max_rows_to_scan"), F.lit(1))
    mapping = ["column_mapping"] if "column_mapping" in files.columns else []
    rows = files.select("path", *carry, *mapping, delimiter.alias("_d"), F.col("layout.header_marker").alias("_marker"),
                        F.col("skip_rows").alias("_skip"), scan.alias("_scan"), "content")
    # Each step is used more than once: as plain projections the filter and what follows would cut the text anew.
    rows = computed_once(rows, {"_lines": lines(text_of(F.col("content")))})
    at = header_line(F.col("_lines"), F.col("_marker"), F.col("_d"), F.col("_skip"), F.col("_scan"))
    rows = computed_once(rows, {"_at": at}).filter("_at IS NOT NULL AND _at < size(_lines)")
    rest = joined_records(F.slice("_lines", F.col("_at") + 1, F.size("_lines")))
    rows = computed_once(rows.select("path", *carry, *mapping, "_d", "_lines", "_at"), {"_records": F.array_remove(rest, "")}).drop("_lines", "_at")
    rows = computed_once(rows, {"header": fields(F.get("_records", F.lit(0)), F.col("_d"))})
    places = []
    if mapping:
        rows, places = located(rows).drop("column_mapping"), _PLACES
    rows = rows.select("path", *carry, "_d", "header", *places, F.posexplode_outer(F.slice("_records", F.lit(2), F.size("_records"))).alias("row_no", "_line"))
    rows = rows.filter("row_no IS NOT NULL")
    cells = fields(F.col("_line"), F.col("_d")).alias("cells")
    if not mapping:
        return rows.select("path", *carry, "row_no", "header", cells)
    rows = rows.select("path", *carry, "row_no", "header", cells, *places, F.col("_line").contains('"').alias("_quoted"), "_line", "_d")
    return computed_once(rows, {"_raw": raw_fields(F.col("_line"), F.col("_d"))}).drop("_line", "_d")


_PLACES = ("_several", *(f"_at_{n}" for n in SEMANTIC))


def located(rows: DataFrame) -> DataFrame:
    """Where the header has the columns of each semantic field (0-based): the first in declared order, and all where a field has several.

    A repeated header's last column counts. Depends on header and mapping only: of a file it is found once, not for every row.
    """
    rows = computed_once(rows, {"_back": F.reverse("header")})
    found = F.filter(
        F.transform("column_mapping", lambda e: F.struct(
            e["value"].alias("field"), (F.size("_back") - F.array_position("_back", e["key"])).cast("int").alias("at"))),
        lambda f: f["at"] < F.size("_back"))
    rows = computed_once(rows, {"_found": found})
    names = F.col("_found.field")
    first = {f"_at_{n}": F.get(F.col("_found.at"), (F.array_position(names, n) - 1).cast("int")) for n in SEMANTIC}
    several = F.when(F.size(F.array_distinct(names)) < F.size(names), F.col("_found"))
    return computed_once(rows, {"_several": several, **first}).drop("_back", "_found")


def semantic_fields(rows: DataFrame) -> DataFrame:
    """Every semantic field as a column: the first non-blank cell among the headers mapped to it, in declared order.

    Rows of ``delimited_rows`` with their columns' places, or rows with header, cells (both trimmed) and column_mapping.
    """
    if "_raw" not in rows.columns:
        rows = located(rows).withColumns({"_raw": F.col("cells"), "_quoted": F.lit(False)})
    c = F.col
    bare = {f"_bare_{n}": clip_column(_undelimited(F.get("_raw", c(f"_at_{n}")), c("_quoted"))) for n in SEMANTIC}
    rows = computed_once(rows, bare)
    rows = computed_once(rows, {f"_bare_{n}": _unquoted(c(f"_bare_{n}"), c("_quoted")) for n in SEMANTIC})

    def among_several(name: str) -> Column:
        values = F.transform(F.filter("_several", lambda f: f["field"] == name), lambda f: blank_to_null(
            _unquoted(clip(_undelimited(F.get("_raw", f["at"]), c("_quoted"))), c("_quoted"))))
        return F.when(c("_several").isNotNull(), F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0)))

    rows = computed_once(rows, {n: F.coalesce(blank_to_null_column(c(f"_bare_{n}")), among_several(n)) for n in SEMANTIC})
    return rows.drop("_raw", "_quoted", *_PLACES, *bare)


def translated(code: Column, code_values: Column) -> tuple[Column, Column]:
    """(test code, sub-identity) a raw code stands for; unknown codes stay."""
    entry = F.get(code_values, (F.array_position(code_values["raw"], clip(code)) - 1).cast("int"))
    return F.coalesce(entry["test_code"], code), entry["sub_identity"]


def selected_value(order: Column) -> Column:
    """First non-blank of the value fields in the profile's order."""
    names = ("result", "ctValue", "interpretation")
    known = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    # Lambdas are interpreted: an order seldom has more than the three fields.
    leading = [F.when(F.get(order, F.lit(k)) == n, blank_to_null_column(F.col(n))) for k in range(len(names)) for n in names]
    every = F.get(F.filter(F.transform(order, lambda n: F.try_element_at(known, n)), filled), F.lit(0))
    return F.coalesce(*leading, F.when(F.size(order) > len(names), every))


def rows_to_results(rows: DataFrame) -> DataFrame:
    """Row rules. No sample, no code (and no file-wide code) or no value: the row says nothing."""
    code, sub = translated(F.col("testCode"), F.col("code_values"))
    out = computed_once(rows.withColumn("specimen_id", F.col("sampleId")).filter("specimen_id IS NOT NULL"),
                        {"_code": code, "sub_identity": F.coalesce(sub, F.lit("")), "raw_value": selected_value(F.col("value_order"))})
    named = F.coalesce(blank_to_null_column(F.col("_code")), clip(blank_to_null(F.col("file_test_code"))))
    out = computed_once(out.filter("raw_value IS NOT NULL"), {"test_code": named}).drop("_code")
    return out.filter("specimen_id IS NOT NULL AND test_code IS NOT NULL AND raw_value IS NOT NULL").withColumn(
        "effective", blank_to_null(F.col("testDate"))
    )


def profile_coded(rows: DataFrame) -> DataFrame:
    """Profile codes first, then flags, then the reading (the order the rules depend on)."""
    return computed_once(rows.withColumn("instrument_code", F.col("test_code")), {
        "test_code": profile_code(F.col("instrument_code"), F.col("alias_codes"), F.col("code_overrides"))})


def with_flags(rows: DataFrame) -> DataFrame:
    """Rows under a flag code leave the results; ``flag`` holds what they say."""
    from .astm import flag_of

    return rows.withColumn("flag", flag_of(F.col("test_code"), F.lit(""), F.col("raw_value")))


def interpreted(rows: DataFrame) -> DataFrame:
    """Canonical number, run failure, number or call."""
    failed = is_run_failure(F.col("test_code"), F.col("sub_identity"), F.col("raw_value"), F.col("failures"))
    rows = computed_once(rows, {"run_failed": failed, "number": canonical_number(F.col("raw_value"), F.col("decimal_separator"))})
    rows = computed_once(rows, {"number": F.when(~F.col("run_failed") & is_bounded_decimal(F.col("number")), F.col("number"))})
    return rows.withColumn(
        "call", F.when(~F.col("run_failed") & F.col("number").isNull(), F.col("raw_value"))
    ).withColumn("is_numeric", F.col("number").isNotNull())


def recognized(rows: DataFrame) -> DataFrame:
    evidence = recognition.evaluations(
        F.col("rules"), F.col("specimen_id"), recognition.tabular_target(F.col("qcTask"))
    )
    return (
        computed_once(rows, {"evidence": evidence})
        .withColumn("assessment", recognition.assessment(F.col("evidence"), F.col("recognition_mode")))
        .withColumn("classification", recognition.classification(F.col("assessment.outcome")))
    )


READING = ("connection_id", "column_mapping", "code_values", "value_order", "layout", "delimiter", "skip_rows",
           "file_test_code", "alias_codes", "failures", "decimal_separator", "flag_names", "flag_raised",
           "recognition_mode", "rules", "code_overrides")


def delimited_results(files: DataFrame, readings: DataFrame) -> DataFrame:
    """Delimited files -> interpreted rows (results and flags), keyed by file and sample (G09: key path, specimen)."""
    wanted = readings.select(*READING)
    by_file = ("delimiter", "skip_rows", "layout", "column_mapping")
    parsed = delimited_rows(join_dimension(files, wanted.select("connection_id", *by_file), ["connection_id"]), "connection_id", "content_hash")
    # The reading of rows joins them once their cells are read: its arrays are not carried along before.
    rows = join_dimension(semantic_fields(parsed), wanted.drop(*by_file), ["connection_id"])
    rows = with_flags(profile_coded(rows_to_results(rows)))
    return recognized(interpreted(rows)).withColumn("protocol", F.lit("FILE"))


# --- cells of workbooks and OpenDocument tables -------------------------------------------------------------------


def header_rows(cells: DataFrame, layouts: DataFrame) -> DataFrame:
    """Per workbook, the sheet and header row: preferred sheets first, then sheet order, within the bounds.

    Sheets per workbook and cells per sheet are bounded by the file size limit.
    """
    sheets = cells.groupBy("file_id", "sheet_no", "sheet_name").agg(F.min("row_no").alias("first_row"))
    named = join_rows(sheets, layouts, ["file_id"]).withColumn(
        "_pref", F.array_position("preferred_sheet_names", F.col("sheet_name"))
    )
    ranked = named.groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.struct(
            F.when(F.col("_pref") > 0, F.col("_pref")).otherwise(F.lit(1_000_000) + F.col("sheet_no")).alias("rank"),
            F.col("sheet_no").alias("sheet_no"), F.col("first_row").alias("first_row"),
        ))).alias("_sheets"),
        F.first("max_sheets_to_scan").alias("_most"), F.first("max_rows_to_scan").alias("_scan"),
        F.first("header_marker").alias("_marker"),
    )
    candidates = ranked.select("file_id", "_scan", "_marker",
                               F.posexplode(F.slice("_sheets", F.lit(1), F.col("_most"))).alias("rank", "s")).select(
        "file_id", "_scan", "_marker", "rank", "s.sheet_no", "s.first_row")
    marked = join_rows(cells.filter("col_no = 0"), candidates, ["file_id", "sheet_no"]).filter(
        (clip(F.col("text")) == F.col("_marker")) & (F.col("row_no") < F.col("first_row") + F.col("_scan"))
    )
    return marked.groupBy("file_id").agg(
        F.min_by(F.struct("sheet_no", "row_no"), F.struct("rank", "row_no")).alias("h")
    ).select("file_id", F.col("h.sheet_no").alias("sheet_no"), F.col("h.row_no").alias("header_row"))


def ods_header_rows(cells: DataFrame, layouts: DataFrame, mappings: DataFrame) -> DataFrame:
    """The marker's first row in the table, else the first row with a sample header and a result header.

    ``mappings`` holds (file_id, header, field) with only sampleId and the selected value fields. Of several sheets the first with any text counts.
    """
    first = cells.filter(filled(F.col("text"))).groupBy("file_id").agg(F.min("sheet_no").alias("sheet_no"))
    cells = join_rows(cells, first, ["file_id", "sheet_no"])
    marked = join_rows(cells.filter("col_no = 0"), layouts.filter("header_marker IS NOT NULL"), ["file_id"])
    marked = marked.filter(clip(F.col("text")) == F.col("header_marker")).groupBy("file_id").agg(
        F.min("row_no").alias("header_row"))
    free = join_rows(cells, layouts.filter("header_marker IS NULL").select("file_id"), ["file_id"], "left_semi")
    hits = join_rows(free.withColumn("header", clip(F.col("text"))), mappings, ["file_id", "header"])
    found = hits.groupBy("file_id", "row_no").agg(
        F.max(F.col("field") == "sampleId").alias("_s"), F.max(F.col("field") != "sampleId").alias("_v")
    ).filter("_s AND _v").groupBy("file_id").agg(F.min("row_no").alias("header_row"))
    return marked.unionByName(found)


def header_index(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Trimmed header -> column, a later duplicate wins."""
    row = join_rows(cells, headers, ["file_id", "sheet_no"]).filter(
        (F.col("row_no") == F.col("header_row")) & filled(F.col("text")))
    return row.groupBy("file_id", clip(F.col("text")).alias("header")).agg(F.max("col_no").alias("col_no"))


def cell_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells of the chosen sheet as one row per sheet row: header and cells arrays, ready for ``semantic_fields``."""
    chosen = join_rows(cells, headers, ["file_id", "sheet_no"]).filter(F.col("row_no") >= F.col("header_row"))
    wide = chosen.groupBy("file_id", "row_no", "header_row").agg(
        F.map_from_entries(F.collect_list(F.struct("col_no", F.coalesce("text", F.lit(""))))).alias("_m"),
        F.max("col_no").alias("_last"),
    ).select("file_id", "row_no", "header_row", F.transform(
        F.sequence(F.lit(0), F.col("_last")), lambda c: F.coalesce(clip(F.try_element_at("_m", c)), F.lit(""))
    ).alias("cells"))
    heads = wide.filter("row_no = header_row").select("file_id", F.col("cells").alias("header"))
    return join_rows(wide.filter("row_no > header_row"), heads, ["file_id"]).select(
        "file_id", (F.col("row_no") - F.col("header_row")).alias("row_no"), "header", "cells")


def archive_identity(exports: DataFrame) -> DataFrame:
    """Checks an export against its own name.

    Needs export_name, name_pattern (with plain groups), sample_group, run_record, sample_field and
    ``named_cells`` (array of struct(group, held)). Adds sample_number and mismatch (NULL when all agree).
    """
    whole = F.concat(F.lit("\\A(?:"), F.col("name_pattern"), F.lit(")\\z"))
    
    def group(number: Column) -> Column:
        return F.call_function("regexp_extract", F.col("export_name"), whole, number)

    named = group(F.col("sample_group"))
    recorded = clip(F.coalesce(F.call_function("get_json_object", F.col("run_record"), F.concat(F.lit("$."), F.col("sample_field"))), F.lit("")))
    wrong_cell = F.exists(
        "named_cells",
        lambda c: c["held"].isNull() | ~F.endswith(c["held"], group(c["group"])),
    )
    mismatch = (
        F.when(~F.rlike(F.col("export_name"), whole), "name")
        .when(recorded != named, "sample")
        .when(wrong_cell, "cell")
    )
    return exports.withColumn("mismatch", mismatch).withColumn("sample_number", F.when(mismatch.isNull(), recorded))


def kind_of(path: Column) -> Column:
    """Which reader a file name calls for."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
    return (
        F.when(ext.isin(".csv", ".tsv", ".txt"), "delimited")
        .when(ext == ".xlsx", "workbook")
        .when(ext == ".ods", "opendocument")
        .when(ext == ".zip", "archive")
        .otherwise("unsupported")
    )


def http_eligibility(transport: Column, inbound: Column, expected: Column, file_format: Column, has_order: Column) -> Column:
    """Reason code when tabular input over HTTP cannot be read, NULL when it can."""
    ok = (
        (transport == "HTTP") & (inbound == "HTTP") & (expected == "FILE")
        & file_format.isin("CSV", "TSV") & has_order
    )
    return F.when(~F.coalesce(ok, F.lit(False)), "UNPINNED_PROFILE")
