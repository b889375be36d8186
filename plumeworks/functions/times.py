"""Dates, leap seconds and seasons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GPS seconds at which one more leap second holds: UTC dates 1981-07-01 to 2017-01-01. Fixed values.
LEAPS = (46828800, 78364801, 109900802, 173059203, 252028804, 315187205, 346723206, 393984007, 425520008, 457056009, 504489610, 551750411, 599184012, 820108813, 914803214, 1025136015, 1119744016, 1167264017)
#: Unix seconds of the GPS epoch, 1980-01-06.
GPS_EPOCH = 315964800


def gps_to_utc(seconds: Column) -> Column:
    """UTC timestamp of GPS seconds, to the microsecond."""
    leaps = sum((F.when(seconds >= t, 1).otherwise(0) for t in LEAPS), F.lit(0))
    # Whole seconds apart, as microseconds of late years aren't whole doubles.
    whole = F.floor(seconds).cast("long")
    return F.timestamp_micros((whole + GPS_EPOCH - leaps) * 1_000_000 + F.round((seconds - whole) * 1e6).cast("long"))


def local_standard_to_utc(date: Column, hour: Column, offset_hours: Column) -> Column:
    """UTC start of an hour of local standard time."""
    return F.timestamp_seconds(F.unix_date(date) * 86400 + (hour - offset_hours) * 3600)


def month_windows(start: Column, end: Column) -> Column:
    """Array of (begin, end) dates: the months between two dates, both included, cut to these."""
    months = F.when(start <= end, F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return F.transform(months, lambda m: F.struct(F.greatest(m, start).alias("begin"), F.least(F.last_day(m), end).alias("end")))


def previous_quarter_end(day: Column) -> Column:
    """The last day of the quarter before the day's."""
    return F.date_sub(F.trunc(day, "quarter"), 1)


def nearest_hour(t: Column) -> Column:
    return F.date_trunc("hour", t + F.expr("interval 30 minutes"))


def seasonal_phases(t: Column, longitude: Column) -> list[Column]:
    """Sine and cosine of the phase of the solar day and of the solar year, of a UTC timestamp."""
    micros = F.unix_micros(t.cast("timestamp")) + F.round(longitude * 240e6).cast("long")
    solar = F.timestamp_micros(micros)
    second = F.pmod(micros, F.lit(86_400_000_000)) / 1e6
    year = F.year(solar)
    days = F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 366).otherwise(365)
    day = 2 * math.pi * second / 86400
    season = 2 * math.pi * (F.dayofyear(solar) - 1 + second / 86400) / days
    return [F.sin(day).alias("day_sin"), F.cos(day).alias("day_cos"), F.sin(season).alias("year_sin"), F.cos(season).alias("year_cos")]
