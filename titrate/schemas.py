"""Fixed table shapes. Profile-declared positions are data inside these rows, never part of a schema."""

from __future__ import annotations

RAW_MESSAGES = (
    "message_id STRING, protocol STRING, transport STRING, source_id STRING, source_port INT, "
    "listener_port INT, sender_hint STRING, raw_text STRING, content_type STRING, received_at TIMESTAMP"
)
RAW_FILES = "path STRING, length LONG, modified_at TIMESTAMP, content BINARY"
FRAMES = "session_id STRING, seq INT, bytes BINARY, observed_at TIMESTAMP"
CELLS = "file_id STRING, sheet_no INT, sheet_name STRING, row_no INT, col_no INT, text STRING"

CODING = "STRUCT<system: STRING, code: STRING, display: STRING>"
_VALUES = (
    "values: ARRAY<STRING>, value_codes: MAP<STRING, ARRAY<{c}>>, value_defaults: MAP<STRING, STRING>, "
    "translations: MAP<STRING, ARRAY<STRING>>, run_failure_values: ARRAY<STRING>, codings: ARRAY<{c}>"
).format(c=CODING)
COMPONENT = f"STRUCT<code: STRING, label: STRING, result_type: STRING, sub_identity: STRING, {_VALUES}>"
TEST = (
    f"STRUCT<test_code: STRING, aliases: ARRAY<STRING>, loinc: STRING, unit: STRING, result_type: STRING, "
    f"test_name_hint: STRING, specimen_type_hint: STRING, result_value_hints: MAP<STRING, STRING>, "
    f"call_component: STRING, normalized_coding: {CODING}, components: ARRAY<{COMPONENT}>, {_VALUES}>"
)
RULE = "STRUCT<ruleType: STRING, targetField: STRING, operand: STRING, controlLevel: STRING, controlType: STRING>"
ASTM_PARTS = (
    "testCode", "assayName", "assayVersion", "analyte", "complement", "call", "number", "unit", "range",
    "flag", "status", "operator", "started", "completed", "instrument", "note", "patientId", "patientName",
    "specimenDescriptor",
)
HL7_PARTS = (
    "testCode", "subIdentity", "value", "unit", "range", "flag", "status", "operator", "completed",
    "instrument", "note", "patientId", "patientName", "specimenDescriptor",
)
_PART_NAMES = sorted(set(ASTM_PARTS) | set(HL7_PARTS))
RESULT_PARTS = "STRUCT<" + ", ".join(f"{p}: STRING" for p in _PART_NAMES) + ">"
CONNECTION_FIELD = (
    "STRUCT<key: STRING, inputKind: STRING, required: BOOLEAN, "
    "choices: ARRAY<STRUCT<value: STRING>>, "
    "visibleWhen: STRUCT<fieldKey: STRING, operator: STRING, value: STRING>>"
)
# The profile document, read once per catalog scan with from_json.
PROFILE = (
    "schemaVersion STRING, "
    "profileMeta STRUCT<id: STRING, version: STRING, displayName: STRING>, "
    "protocol STRUCT<name: STRING, version: STRING, lowerLayerVersion: STRING>, "
    "identifier_pattern STRING, supported_extensions ARRAY<STRING>, "
    "communication STRUCT<mode: STRING, supports_lis_initiated: BOOLEAN>, "
    "capabilities STRUCT<inboundResults: BOOLEAN, outboundOrders: BOOLEAN, connectionTest: BOOLEAN>, "
    "transport_config MAP<STRING, STRUCT<default_port: INT>>, "
    f"default_test_mappings ARRAY<{TEST}>, "
    "sample_flags STRUCT<raisedValue: STRING, codes: ARRAY<STRING>, names: MAP<STRING, STRING>>, "
    "column_mapping MAP<STRING, STRING>, test_code_values MAP<STRING, STRING>, "
    "result_value_order ARRAY<STRING>, "
    "sheet_detection STRUCT<preferred_sheet_names: ARRAY<STRING>, header_marker: STRING, "
    "max_sheets_to_scan: INT, max_rows_to_scan: INT>, "
    "archive STRUCT<results_entry: STRING, run_record_entry: STRING, export_name_pattern: STRING, "
    "sample_id_field: STRING, name_cells: MAP<STRING, STRING>>, "
    "configDefaults STRUCT<dataFlow: STRING, connectionRole: STRING, transport: STRING, port: INT, "
    "filePattern: STRING, numberFormat: STRING, fileFormat: STRING, delimiter: STRING, skipRows: INT, "
    "extractionOverrides: STRUCT<"
    "resultRecordSelection: STRUCT<mode: STRING, targetField: STRING, values: ARRAY<STRING>>, "
    f"specimenPosition: STRING, resultParts: {RESULT_PARTS}>>, "
    f"connectionFields ARRAY<{CONNECTION_FIELD}>, "
    "controlResultRecognition STRUCT<mode: STRING, affirmedNoControlResults: BOOLEAN, "
    f"rules: MAP<STRING, {RULE}>>"
)
