"""Calendar features and billing periods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds of a mean year and month, a week and a day.
PERIODS = {"Y": 31557600, "M": 2629800, "W": 604800, "D": 86400}


def cyclic(ts: Column, period: str) -> tuple[Column, Column]:
    """Sine and cosine of the epoch time over one of the periods."""
    angle = F.unix_micros(ts) / 1e6 / PERIODS[period] * (2 * math.pi)
    return F.sin(angle), F.cos(angle)


def year_days(local: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(local), F.lit(12), F.lit(31)))


def cyclic_local(ts: Column, period: str, zone: str) -> tuple[Column, Column]:
    """Sine and cosine of the wall-clock place in the year, month, week or day."""
    local = F.from_utc_timestamp(ts, zone)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    share = {
        "Y": ((F.dayofyear(local) - 1) * 86400 + second) / (year_days(local) * 86400),
        "M": ((F.dayofmonth(local) - 1) * 86400 + second) / (F.dayofmonth(F.last_day(local)) * 86400),
        "W": (F.weekday(local) * 86400 + second) / 604800,
        "D": second / 86400,
        "H": F.pmod(second, F.lit(3600)) / 3600,
    }[period]
    return F.sin(share * (2 * math.pi)), F.cos(share * (2 * math.pi))


def parts(ts: Column) -> dict[str, Column]:
    """The calendar parts of a time."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": F.second(ts),
        "dayofweek": F.weekday(ts),
        "dayofyear": F.dayofyear(ts),
        "week": F.weekofyear(ts),
        "quarter": F.quarter(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(ts) == 1).cast("int"),
        "is_month_end": (F.to_date(ts) == F.last_day(ts)).cast("int"),
        "is_quarter_start": (F.to_date(ts) == F.to_date(F.date_trunc("quarter", ts))).cast("int"),
        "is_year_start": (F.dayofyear(ts) == 1).cast("int"),
        "is_year_end": (F.dayofyear(ts) == year_days(ts)).cast("int"),
        "days_in_month": F.dayofmonth(F.last_day(ts)),
    }


def easter(year: int) -> tuple[int, int]:
    """(month, day) of Easter Sunday in the Gregorian calendar."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return month, day + 1


# Public holidays by country, as (month, day) or as days after Easter Sunday.
HOLIDAYS = {
    "AT": ([(1, 1), (1, 6), (5, 1), (8, 15), (10, 26), (11, 1), (12, 8), (12, 25), (12, 26)], [1, 39, 50, 60]),
    "DE": ([(1, 1), (5, 1), (10, 3), (12, 25), (12, 26)], [-2, 1, 39, 50]),
    "CH": ([(1, 1), (8, 1), (12, 25)], [-2, 1, 39, 50]),
}


def holiday_dates(country: str, first: int = 2020, last: int = 2030) -> list[str]:
    """ISO dates of a country's holidays, by rule."""
    import datetime

    fixed, moving = HOLIDAYS[country]
    out = []
    for year in range(first, last + 1):
        sunday = datetime.date(year, *easter(year))
        out += [datetime.date(year, m, d).isoformat() for m, d in fixed] + [(sunday + datetime.timedelta(days=n)).isoformat() for n in moving]
    return sorted(out)


def with_holiday(df: DataFrame, ts: str = "ts", country: str = "AT", zone: str = "Europe/Vienna") -> DataFrame:
    """Adds holiday, 1 where the local date is a public holiday. The list of dates is a literal."""
    day = F.to_date(F.from_utc_timestamp(ts, zone)).cast("string")
    return df.withColumn("holiday", day.isin(holiday_dates(country)).cast("int"))


def period_start(started: Column, now: Column) -> Column:
    """Start of the monthly period around now, on the day of month at which it all began (clamped to the month's end)."""
    months = F.floor(F.months_between(F.trunc(now, "month"), F.trunc(started, "month"))).cast("int")
    this = F.add_months(F.to_date(started), months)
    return F.when(this <= F.to_date(now), this).otherwise(F.add_months(F.to_date(started), months - 1))


def period_next(started: Column, now: Column) -> Column:
    """Start of the period after that."""
    months = F.floor(F.months_between(F.trunc(now, "month"), F.trunc(started, "month"))).cast("int")
    this = F.add_months(F.to_date(started), months)
    return F.when(this > F.to_date(now), this).otherwise(F.add_months(F.to_date(started), months + 1))
