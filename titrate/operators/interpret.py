"""Lookups every protocol shares, over the reading carried by the result's connection (see profiles.reading)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import codes


def profile_code(instrument_code: Column, alias_codes: Column, overrides: Column | None = None) -> Column:
    """The profile's code for an instrument code; unknown codes stay as they are. The last declaration of a code counts."""
    found = F.get(F.reverse(alias_codes["code"]), (F.array_position(F.reverse(alias_codes["text"]), instrument_code) - 1).cast("int"))
    if overrides is not None:
        entry = F.try_element_at(
            F.filter(F.map_entries(overrides), lambda e: F.trim(e["value"]) == instrument_code), F.lit(-1)
        )
        found = F.coalesce(F.when(overrides.isNotNull(), entry["key"]), found)
    return F.coalesce(found, instrument_code)


def is_run_failure(code: Column, sub: Column, value: Column, failures: Column) -> Column:
    """H05. Lambdas are interpreted: only values that some code declares are held against its codes."""
    declared = F.exists(failures, lambda f: (f["code"] == code) & (f["sub"] == sub) & (f["value"] == value))
    return F.coalesce(F.when(F.array_contains(failures["value"], value), declared), F.lit(False))


def definition(code: Column, sub: Column, definitions: Column) -> Column:
    return F.get(
        F.filter(definitions, lambda d: (d["code"] == code) & (d["sub"] == F.coalesce(sub, F.lit("")))), F.lit(0)
    )


def canonical_answer(code: Column, sub: Column, text: Column, definitions: Column) -> Column:
    """The declared answer a spelling stands for, else the text itself."""
    return canonical_of(definition(code, sub, definitions), text)


def canonical_of(d: Column, text: Column) -> Column:
    translated = F.try_element_at(
        F.filter(d["translations"], lambda e: F.array_contains(e["value"], text)), F.lit(-1)
    )["key"]
    return F.coalesce(F.when(F.array_contains(d["values"], text), text), translated, text)


def ambiguous_answer(code: Column, sub: Column, text: Column, definitions: Column) -> Column:
    """One spelling declared for two answers: the accession cannot be rendered."""
    return ambiguous_of(definition(code, sub, definitions), text)


def ambiguous_of(d: Column, text: Column) -> Column:
    meanings = F.transform(
        F.filter(d["translations"], lambda e: F.array_contains(e["value"], text)), lambda e: e["key"]
    )
    own = F.when(F.array_contains(d["values"], text), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.size(F.array_distinct(F.concat(own, meanings))) > 1, F.lit(False))


def value_slot(failed: Column, number: Column, limit: Column, sign: Column, call: Column, units: Column) -> Column:
    """Absent, quantity or text, whichever the parts call for."""
    amount = F.coalesce(number, limit)
    kind = F.when(failed, "absent").when(amount.isNotNull(), "quantity").otherwise("text")
    quantity = kind == "quantity"
    return F.struct(
        kind.alias("kind"),
        F.when(quantity, amount).alias("quantity"),
        F.when(quantity, codes.comparator(sign)).alias("comparator"),
        F.when(quantity, units).alias("unit"),
        F.when(kind == "text", call).alias("text"),
        F.when(quantity, call).alias("interpretation"),
    )


def answer_coding(code: Column, sub: Column, call: Column, definitions: Column) -> Column:
    """Canonical answer and its codes."""
    d = definition(code, sub, definitions)
    canonical = canonical_of(d, call)
    return F.when(call.isNotNull(), F.struct(canonical.alias("canonical"), codings_of(d, canonical).alias("codings")))


def codings_of(d: Column, canonical: Column) -> Column:
    """Usable codes of a canonical answer."""
    coded = F.get(F.filter(d["value_codes"], lambda e: e["key"] == canonical), F.lit(0))["value"]
    return F.filter(coded, lambda c: c["system"].isNotNull() & c["code"].isNotNull())


def loinc(code: Column, loinc_codes: Column) -> Column:
    """D06 over the carried reading: direct, else through any instrument code of the same test."""
    direct = F.try_element_at(F.filter(loinc_codes, lambda e: e["text"] == code), F.lit(-1))["loinc"]
    via = F.get(F.filter(loinc_codes, lambda e: e["code"] == code), F.lit(0))["loinc"]
    return F.coalesce(direct, via)
