"""Column functions of the preparation steps: text to numbers and times, rounding, durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a number may look like: Java would also take "5d" or "0x1p3".
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(c: Column) -> Column:
    """A double, or null where the trimmed text isn't a plain decimal number (or is nan or inf)."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def decimal_comma(c: Column) -> Column:
    """A number with a decimal comma; all but digits, minus and point is dropped first."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), ",", "."), r"[^\d\-.]", "").try_cast("double")


def is_numeric(c: Column) -> Column:
    """Whether the text is a number, "nan" or "inf" in any case included."""
    text = F.trim(c.cast("string"))
    return F.coalesce(text.rlike(NUMBER) | F.lower(text).rlike(r"^[+-]?(nan|inf|infinity)$"), F.lit(False))


def finite(c: Column) -> Column:
    """Null in place of NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def round_even(c: Column, digits: int | None) -> Column:
    """Rounded half to even; unchanged if digits is None."""
    return c if digits is None else F.bround(c, digits)


def hms(seconds: Column) -> Column:
    """HH:MM:SS of a duration in seconds, cut to whole ones; hours may exceed 24."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), (s % 3600 / 60).cast("long"), s % 60)


def clean_time(c: Column) -> Column:
    """Only digits and the characters of dates: colon, minus, plus, point, T, slash, space."""
    return F.regexp_replace(c, r"[^0-9:\-+.T/ ]", "")


def strip_trailing_delimiters(line: Column, delimiter: str) -> Column:
    return F.regexp_replace(line, "[" + re.escape(delimiter) + r";,]+\s*$", "")


def safe_cell(c: Column) -> Column:
    """An apostrophe in front of text that a spreadsheet would take as a formula; numbers stay."""
    return F.when(c.rlike(r"^[ \t\r\n]*[=+\-@]") & ~is_numeric(c), F.concat(F.lit("'"), c)).otherwise(c)


def date_and_time(date: Column, time: Column) -> Column:
    """Two columns as one text; a time of day in the date column is dropped."""
    return F.concat_ws(" ", F.split(F.split(date, " ")[0], "T")[0], time)


def local_to_utc(ts: Column, zone: str) -> Column:
    """The instant of a local wall-clock time; null where that time doesn't exist or is ambiguous."""
    utc = F.to_utc_timestamp(ts, zone)
    gap = F.from_utc_timestamp(utc, zone) != ts
    hour = F.expr("interval 1 hour")
    fold = (F.from_utc_timestamp(utc + hour, zone) == ts) | (F.from_utc_timestamp(utc - hour, zone) == ts)
    return F.when(~gap & ~fold, utc)


def utc_to_local(ts: Column, zone: str = "Europe/Vienna") -> Column:
    return F.from_utc_timestamp(ts, zone)


def floor_div(a: str, b: str | int) -> Column:
    """Whole quotient rounded down, for whole numbers: exact where a division of doubles isn't."""
    return F.expr(f"(({a}) - pmod({a}, {b})) div {b}")


def ceil_div(a: str, b: str | int) -> Column:
    return F.expr(f"(({a}) + pmod(-({a}), {b})) div {b}")
