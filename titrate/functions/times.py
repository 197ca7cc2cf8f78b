"""Instrument time stamps: digits -> ISO text, with the lenient day rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ssXXX"


def _number(digits: Column, start: int, length: int) -> Column:
    return F.substring(digits, start, length).try_cast("int")


def lenient_date(digits: Column) -> Column:
    """``yyyyMMdd`` with a day of 29 to 31 drawn back to the end of its month; NULL when no such date."""
    year, month, day = _number(digits, 1, 4), _number(digits, 5, 2), _number(digits, 7, 2)
    in_range = digits.rlike(r"\A\d{8}") & month.between(1, 12) & day.between(1, 31) & (year >= 1)
    first = F.when(in_range, F.make_date(year, month, F.lit(1)))
    return F.least(F.date_add(first, day - 1), F.last_day(first))


def _clock_seconds(digits: Column, seconds: bool) -> Column:
    hour, minute = _number(digits, 9, 2), _number(digits, 11, 2)
    second = _number(digits, 13, 2) if seconds else F.lit(0)
    ok = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    return F.when(ok, hour * 3600 + minute * 60 + second)


def _instant(digits: Column, seconds: bool) -> Column:
    whole = r"\A\d{14}\z" if seconds else r"\A\d{12}\z"
    day_seconds = F.unix_date(lenient_date(digits)).cast("long") * 86400
    return F.when(digits.rlike(whole), F.timestamp_seconds(day_seconds + _clock_seconds(digits, seconds)))


def astm_time(raw: Column) -> Column:
    """8 digits -> date, 12 or 14 digits -> date-time with offset (session zone, UTC); anything else NULL."""
    return F.when(F.length(raw).isin(8, 12, 14), let(raw, astm_time_of))


def astm_time_of(raw: Column) -> Column:
    """``astm_time`` of a plain column: the text is put together from its own digits, without a lambda or a formatter for every row."""
    year, month, day = F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2)
    last = F.last_day(F.concat(year, F.lit("-"), month, F.lit("-01")).try_cast("date"))
    end = F.substring(last.cast("string"), 9, 2)
    date = F.concat(year, F.lit("-"), month, F.lit("-"), F.least(day, end))
    hour, minute = F.substring(raw, 9, 2), F.substring(raw, 11, 2)
    second = F.when(F.length(raw) == 14, F.substring(raw, 13, 2)).otherwise("00")
    clock = F.concat(F.lit("T"), hour, F.lit(":"), minute, F.lit(":"), second, F.lit("Z"))
    on_clock = (hour <= "23") & (minute <= "59") & (second <= "59")
    dated = (year != "0000") & day.between("01", "31") & end.isNotNull()
    shaped = F.length(raw).isin(8, 12, 14) & raw.rlike(r"\A\d+\z")
    return F.when(shaped & dated, F.when(F.length(raw) == 8, date).when(on_clock, F.concat(date, clock)))


# Fixed value: digits, an ignored fraction, an optional offset.
HL7_TIME = r"\A(\d{8}(?:\d{2}(?:\d{2}(?:\d{2})?)?)?)(?:\.\d{1,4})?([+-]\d{4})?\z"


def hl7_time(trimmed: Column) -> Column:
    """8 digits -> date; longer -> date-time padded to seconds, its own offset kept, else the session zone."""
    return F.when(F.length(trimmed) >= 8, let(trimmed, _hl7_time))


def _hl7_time(trimmed: Column) -> Column:
    digits = F.regexp_extract(trimmed, HL7_TIME, 1)
    offset = F.regexp_extract(trimmed, HL7_TIME, 2)
    local = F.date_format(_instant(F.rpad(digits, 14, "0"), True), "yyyy-MM-dd'T'HH:mm:ss")
    hours, minutes = F.substring(offset, 2, 2).try_cast("int"), F.substring(offset, 4, 2).try_cast("int")
    valid_offset = (minutes <= 59) & (hours * 60 + minutes <= 18 * 60)
    zone = (
        F.when(offset == "", "Z")
        .when(valid_offset & (hours + minutes == 0), "Z")
        .when(valid_offset, F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2)))
    )
    return F.when(F.length(digits) == 8, F.date_format(lenient_date(digits), "yyyy-MM-dd")).when(
        F.length(digits) > 8, F.concat(local, zone)
    )


def precision(iso: Column) -> Column:
    return F.when(F.length(iso) == 10, "day").when(iso.isNotNull(), "second")
