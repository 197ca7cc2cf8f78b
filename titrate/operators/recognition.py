"""Control recognition: the pinned profile's ordered rules against each result.

Rules arrive as one array per profile (bounded by the document), so evaluating all of them adds no rows and no
shuffle. ``target_value(rule)`` supplies the text a rule looks at, from whatever the source protocol offers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clip, filled


def field_equals(value: Column, operand: Column) -> Column:
    """I01."""
    return F.lower(clip(value)) == F.lower(clip(operand))


def field_contains(value: Column, operand: Column) -> Column:
    """I02."""
    return F.contains(F.upper(value), F.upper(operand))


def specimen_prefix(specimen_id: Column, operand: Column) -> Column:
    """I03."""
    return F.startswith(F.upper(specimen_id), F.upper(operand))


def specimen_pattern(specimen_id: Column, operand: Column) -> Column:
    """The whole specimen id, ignoring case. The reading holds patterns that compile (``profiles.reading``)."""
    return F.rlike(specimen_id, F.concat(F.lit(r"(?i)\A(?:"), operand, F.lit(r")\z")))


def matches(rule: Column, specimen_id: Column, value: Column) -> Column:
    kind = rule["rule_type"]
    return F.coalesce(
        F.when(kind == "FIELD_EQUALS", field_equals(value, rule["operand"]))
        .when(kind == "FIELD_CONTAINS", field_contains(value, rule["operand"]))
        .when(kind == "SPECIMEN_ID_PREFIX", specimen_prefix(specimen_id, rule["operand"]))
        .when(kind == "SPECIMEN_ID_PATTERN", specimen_pattern(specimen_id, rule["operand"])),
        F.lit(False),
    )


def evaluations(rules: Column, specimen_id: Column, target_value: Callable[[Column], Column]) -> Column:
    """Ordered evidence (rule_key, matched, source_field, raw_value, source_present, control_level)."""

    def one(rule: Column) -> Column:
        on_field = rule["rule_type"].isin("FIELD_EQUALS", "FIELD_CONTAINS")
        value = target_value(rule)
        raw = F.coalesce(F.when(on_field, value).otherwise(specimen_id), F.lit(""))
        return F.struct(
            rule["key"].alias("rule_key"),
            matches(rule, specimen_id, value).alias("matched"),
            F.when(on_field, rule["target_field"]).otherwise("specimenId").alias("source_field"),
            raw.alias("raw_value"),
            filled(raw).alias("source_present"),
            rule["control_level"].alias("control_level"),
        )

    return F.coalesce(F.transform(rules, one), F.array())


def first_match(evidence: Column) -> Column:
    return F.get(F.filter(evidence, lambda e: e["matched"]), F.lit(0))


def assessment(evidence: Column, mode: Column) -> Column:
    """MATCH / NO_MATCH / NOT_EVALUATED with the first matching rule."""
    hit = first_match(evidence)
    unevaluated = (mode == "NONE") | (F.size(evidence) == 0)
    outcome = F.when(unevaluated, "NOT_EVALUATED").when(hit.isNotNull(), "MATCH").otherwise("NO_MATCH")
    return F.struct(
        mode.alias("mode"),
        outcome.alias("outcome"),
        F.when(~unevaluated, hit["rule_key"]).alias("matched_rule"),
        F.when(~unevaluated, hit["control_level"]).alias("control_level"),
    )


def classification(outcome: Column, is_flag: Column | bool = False) -> Column:
    """I07."""
    flagged = F.lit(is_flag) if isinstance(is_flag, bool) else is_flag
    return F.when(flagged, "SAMPLE_FLAG").when(outcome == "MATCH", "CONTROL").otherwise("PATIENT")


def astm_target(fields: Column) -> Callable[[Column], Column]:
    """``O.n`` of the nearest preceding order record, given as its fields: a line cut inside the rules' lambda would be cut for every rule."""

    def value(rule: Column) -> Column:
        target = rule["target"]
        return F.when((target["segment"] == "O") & (target["component"] == 0), clip(F.get(fields, target["field"] - 1)))

    return value


def hl7_target(specimen: dict[str, Column], context: tuple[str, ...]) -> Callable[[Column], Column]:
    """Segment paths as they stand at the observation."""
    from .hl7 import read

    def value(rule: Column) -> Column:
        return read(rule["target"], context, specimen)

    return value


def tabular_target(qc_task: Column) -> Callable[[Column], Column]:
    """The row's control task."""
    return lambda rule: F.when(rule["target_field"] == "QC_TASK", qc_task)
