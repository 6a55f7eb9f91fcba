"""Depths and the tests on them. Positive depths are dry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA, FLAG_NODATA = -9999.0, 255
SLUG_PLACES = 2


def depth(bed: Column, surface: Column) -> Column:
    return bed - surface


def in_window(d: Column, low: float, high: float) -> Column:
    """Closed: both bounds count."""
    return d.between(F.lit(float(low)), F.lit(float(high)))


def in_refuge(d: Column, threshold: float) -> Column:
    """Under water, but by no more than the threshold."""
    return (d < 0) & (d >= F.lit(-float(threshold)))


def in_daylight(minute: Column, sunrise: Column, sunset: Column, exclusive: bool = False) -> Column:
    return (minute > sunrise) & (minute < sunset) if exclusive else minute.between(sunrise, sunset)


def clean(level: Column) -> Column:
    """NaN is a gap like null; Spark's max would return it."""
    return F.when(~F.isnan(level), level)


def half_cycle(before: Column, after: Column, share: Column) -> Column:
    """Between two turning points the level follows half a sine."""
    return F.lit(0.5) * (before + after) + F.lit(0.5) * (after - before) * F.sin(F.pi() * (share - F.lit(0.5)))


def filled(value: Column, valid: Column, nodata: float = NODATA) -> Column:
    return F.when(valid, value).otherwise(F.lit(nodata))


def area_flag(minutes: Column) -> Column:
    return (minutes > 0).cast("tinyint")


def day_average(minutes: Column, n_days: int) -> Column:
    return minutes / F.lit(float(max(1, n_days)))


def slug(name: Column) -> Column:
    """A name as part of a file name."""
    return F.translate(F.trim(name), " /", "_-")


def threshold_slug(threshold: Column) -> Column:
    return F.replace(F.format_string("%.2f", threshold.cast("double")), F.lit("."), F.lit("p"))


def slug_of(name: str) -> str:
    return name.strip().replace(" ", "_").replace("/", "-")


def threshold_slug_of(threshold: float) -> str:
    return f"{threshold:.2f}".replace(".", "p")


def short_number(value: Column) -> Column:
    """Up to six significant digits without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", value.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
