"""Minute series from high and low waters: half a sine between one event and the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.levels import half_cycle

PAD_DAYS = 2


def rising_events(events: DataFrame) -> DataFrame:
    """(gauge, t_min, level), one event a minute: the first by time. Rows may have `t`, a finer time, to order by."""
    order = "t" if "t" in events.columns else "level"
    nth = F.row_number().over(Window.partitionBy("gauge", "t_min").orderBy(order))
    return events.withColumn("nth", nth).filter("nth = 1").select("gauge", "t_min", "level")


def near(events: DataFrame, n_minutes: int, days: int = PAD_DAYS) -> DataFrame:
    """Events within the window of so many minutes, and some days around it."""
    return events.filter(F.col("t_min").between(-days * 1440, n_minutes + days * 1440))


def segments(events: DataFrame) -> DataFrame:
    """(gauge, t0, t1, h0, h1): pairs of successive events of which the second is later."""
    by = Window.partitionBy("gauge").orderBy("t_min")
    pairs = events.select("gauge", F.col("t_min").alias("t0"), F.lead("t_min").over(by).alias("t1"), F.col("level").alias("h0"), F.lead("level").over(by).alias("h1"))
    return pairs.filter("t1 > t0")


def minute_series(events: DataFrame, n_minutes: int, method: str = "sinusoidal") -> DataFrame:
    """(gauge, minute, level) for minutes 0 to n - 1, by half cycles or straight lines: 0 before the first event, the last level after the last."""
    cut = segments(events).withColumns({"a": F.greatest("t0", F.lit(0)), "b": F.least("t1", F.lit(n_minutes))}).filter("b > a")
    each = cut.withColumn("minute", F.explode(F.sequence("a", F.col("b") - 1)))
    share = (F.col("minute") - F.col("t0")).cast("double") / (F.col("t1") - F.col("t0")).cast("double")
    inside = each.select("gauge", "minute", (half_cycle(F.col("h0"), F.col("h1"), share) if method == "sinusoidal" else F.col("h0") + (F.col("h1") - F.col("h0")) * share).alias("value"))
    ends = events.groupBy("gauge").agg(F.max("t_min").alias("end"), F.max_by("level", "t_min").alias("tail"))
    every = ends.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(n_minutes - 1))))
    tail = F.when(F.col("minute") >= F.col("end"), F.col("tail")).otherwise(F.lit(0.0))
    return every.join(inside, ["gauge", "minute"], "left").select("gauge", "minute", F.coalesce("value", tail).alias("level"))


def padded_series(events: DataFrame, n_minutes: int, method: str = "sinusoidal") -> DataFrame:
    """As minute_series, with the first and last level held to the window's ends; gauges with one event or none are left empty.

    The first event after the window's begin (or the last before its end) is repeated there.
    """
    clean = rising_events(near(events, n_minutes))
    bounds = clean.groupBy("gauge").agg(F.count("*").alias("n"), F.min("t_min").alias("lo"), F.max("t_min").alias("hi"), F.min_by("level", "t_min").alias("first"), F.max_by("level", "t_min").alias("last"))
    usable = bounds.filter("n >= 2")
    head = usable.filter("lo > 0").select("gauge", F.lit(0).cast(clean.schema["t_min"].dataType).alias("t_min"), F.col("first").alias("level"))
    tail = usable.filter(F.col("hi") < n_minutes).select("gauge", F.lit(n_minutes).cast(clean.schema["t_min"].dataType).alias("t_min"), F.col("last").alias("level"))
    full = minute_series(clean.join(usable.select("gauge"), "gauge", "left_semi").unionByName(head).unionByName(tail), n_minutes, method)
    empty = bounds.filter("n < 2").select("gauge", F.explode(F.sequence(F.lit(0), F.lit(n_minutes - 1))).alias("minute"), F.lit(None).cast("double").alias("level"))
    return full.unionByName(empty)
