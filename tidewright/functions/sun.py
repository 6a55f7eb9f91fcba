"""Sunrise and sunset in minutes of the day (UTC), by the Fourier series of the sun's declination."""

from __future__ import annotations

import calendar
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The series' coefficients (constant; cos, sin; cos 2, sin 2).
SERIES = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907)


def days_in_year(year: int) -> int:
    return 366 if calendar.isleap(year) else 365


def declination(day: Column, n_days: int) -> Column:
    g = F.lit(2 * math.pi) * day / F.lit(float(n_days))
    c0, c1, s1, c2, s2 = SERIES
    return F.lit(c0) + F.lit(c1) * F.cos(g) + F.lit(s1) * F.sin(g) + F.lit(c2) * F.cos(2 * g) + F.lit(s2) * F.sin(2 * g)


def sun_minutes(day: Column, lat: Column, lon: Column, n_days: int, wrap: bool = False) -> tuple[Column, Column]:
    """(sunrise, sunset) of day 0, 1, ... of the year. Minutes beyond the UTC day stay as they are, unless wrapped."""
    cos_hour = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(F.radians(lat)) * F.tan(declination(day, n_days))))
    half = F.degrees(F.acos(cos_hour)) / 15 * 60
    noon = F.lit(720.0) - 4 * lon
    rise, fall = (noon - half).cast("int"), (noon + half).cast("int")
    return (F.pmod(rise, F.lit(1440)), F.pmod(fall, F.lit(1440))) if wrap else (rise, fall)


def daylight_table(spark: SparkSession, lat: float, lon: float, year: int, wrap: bool = False) -> DataFrame:
    """(day, sunrise, sunset) for each day of the year."""
    n = days_in_year(year)
    rise, fall = sun_minutes(F.col("id"), F.lit(float(lat)), F.lit(float(lon)), n, wrap)
    return spark.range(n).select(F.col("id").cast("int").alias("day"), rise.alias("sunrise"), fall.alias("sunset"))
