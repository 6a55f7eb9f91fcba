"""Water-level series: gaps, interpolation, resampling and surface rules.

Records are (gauge, rec, level) on a regular grid of `interval` minutes from 0; a gap is a null level.
Windows run within a gauge: a year at six minutes is 87,600 rows, whatever the number of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.levels import clean, half_cycle

MINUTES = 1440
METHODS, POLICIES, MODES = ("linear", "sinusoidal", "hold"), ("hold", "nan"), ("direct", "incremental")


def _past(by: str, order: str):
    return Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _future(by: str, order: str):
    return Window.partitionBy(by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)


def hold_gaps(records: DataFrame, value: str = "level", order: str = "rec", by: str = "gauge") -> DataFrame:
    """Each gap takes the last level before it; a leading gap the first after it. A gauge without a level stays empty."""
    last, first = F.last(value, True).over(_past(by, order)), F.first(value, True).over(_future(by, order))
    return records.withColumn(value, F.coalesce(last, first))


def bridge_gaps(records: DataFrame, value: str = "level", order: str = "rec", by: str = "gauge") -> DataFrame:
    """Each gap lies on the line between its neighbours; gaps at an end take the nearest level."""
    at = F.when(F.col(value).isNotNull(), F.col(order))
    v0, t0 = F.last(value, True).over(_past(by, order)), F.last(at, True).over(_past(by, order))
    v1, t1 = F.first(value, True).over(_future(by, order)), F.first(at, True).over(_future(by, order))
    between = F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (F.col(order) - t0) / (t1 - t0))
    return records.withColumn(value, F.when(v0.isNotNull() & v1.isNotNull(), between).otherwise(F.coalesce(v0, v1)))


def fill_gaps(records: DataFrame, method: str = "hold") -> DataFrame:
    """hold, interpolate, or nan (leave)."""
    if method == "nan":
        return records
    if method not in ("hold", "interpolate"):
        raise ValueError(f"unknown way to fill gaps: {method}")
    return hold_gaps(records) if method == "hold" else bridge_gaps(records)


def longest_gap(records: DataFrame) -> DataFrame:
    """One row, `longest`: the longest run of records in which any gauge has a gap."""
    holes = records.groupBy("rec").agg(F.bool_or(F.col("level").isNull()).alias("hole")).filter("hole")
    island = F.col("rec") - F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rec"))
    runs = holes.select(island.alias("island")).groupBy("island").count()
    return runs.agg(F.coalesce(F.max("count"), F.lit(0)).alias("longest"))


def gap_share(records: DataFrame) -> DataFrame:
    """Percent of records that are gaps, by gauge."""
    share = F.count_if(F.col("level").isNull()) * F.lit(100.0) / F.count("*")
    return records.groupBy("gauge").agg(F.count("*").alias("n_records"), F.count("level").alias("n_levels"), share.alias("gap_pct"))


def whole_days(records: DataFrame, interval: int) -> DataFrame:
    """Without the records of a last, partial day (of the longest gauge)."""
    per_day = MINUTES // interval
    whole = records.agg(F.expr(f"(max(rec) + 1) div {per_day} * {per_day}").alias("n"))
    return records.filter(F.col("rec") < whole.scalar())


def first_days(records: DataFrame, interval: int, days: int) -> DataFrame:
    return records.filter(F.col("rec") < days * (MINUTES // interval))


def grid(records: DataFrame, gauges: DataFrame, n_records: int) -> DataFrame:
    """Every (gauge, rec) slot, with a null level where there is no record."""
    every = gauges.select("gauge").distinct().select("gauge", F.explode(F.sequence(F.lit(0), F.lit(n_records - 1))).alias("rec"))
    return every.join(records.select("gauge", F.col("rec").cast("int").alias("rec"), "level"), ["gauge", "rec"], "left")


def resample(records: DataFrame, interval: int, timestep: int, method: str = "linear") -> DataFrame:
    """(gauge, step, ws): levels at every multiple of timestep; the level at step j is that of minute j * timestep.

    Records are bracketed by arithmetic, as the grid is regular: each record makes the steps up to the
    next one, so there is no range join. A null on either side of a bracket makes the level null; with
    hold it is the record before. After the last record its level holds.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    level = clean(F.col("level"))
    if timestep == interval:
        return records.select("gauge", F.col("rec").alias("step"), level.alias("ws"))
    by = Window.partitionBy("gauge").orderBy("rec")
    n_of = F.count("*").over(Window.partitionBy("gauge"))
    rows = records.select("gauge", "rec", level.alias("h0"), F.lead(level).over(by).alias("h1"), n_of.alias("n"))
    steps = F.expr(f"(n * {interval}L) div {timestep}L")
    last = F.col("rec") == F.col("n") - 1
    begin = F.expr(f"(rec * {interval}L + {timestep - 1}L) div {timestep}L")
    end = F.when(last, steps).otherwise(F.expr(f"((rec + 1) * {interval}L + {timestep - 1}L) div {timestep}L"))
    # A step on the last record itself lies at the end of the last bracket, unless levels are held.
    rows = rows.withColumns({"begin": begin, "end": F.least(end, steps), "last": last}).filter("end > begin")
    each = rows.withColumn("step", F.explode(F.sequence("begin", F.col("end") - 1)))
    share = (F.col("step") * F.lit(timestep) - F.col("rec") * F.lit(interval)).cast("double") / F.lit(float(interval))
    if method == "hold":
        ws = F.col("h0")
    else:
        inner = F.col("h0") + share * (F.col("h1") - F.col("h0")) if method == "linear" else half_cycle(F.col("h0"), F.col("h1"), share)
        ws = F.when(F.col("last"), F.col("h0")).otherwise(inner)
    return each.select("gauge", "step", ws.alias("ws"))


def surface(series: DataFrame, mode: str = "direct", gaps: str = "hold") -> DataFrame:
    """Gap rule, then the surface itself, or (incremental) its first level plus all changes known since.

    With gaps left open, an unknown change counts as none, so the incremental surface has no gaps; a
    gauge whose first level is unknown has no surface at all.
    """
    if mode not in MODES or gaps not in POLICIES:
        raise ValueError(f"unknown surface rule: {mode}, {gaps}")
    if gaps == "hold":
        series = hold_gaps(series, "ws", "step")
    if mode == "direct":
        return series
    by = Window.partitionBy("gauge").orderBy("step")
    change = F.coalesce(F.col("ws") - F.lag("ws").over(by), F.lit(0.0))
    series = series.withColumns({"change": change, "start": F.first("ws").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    return series.withColumn("ws", F.col("start") + F.sum("change").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("change", "start")


def extremes(series: DataFrame) -> DataFrame:
    """(gauge, min_ws, max_ws) over all steps, gaps left out."""
    return series.groupBy("gauge").agg(F.min(clean(F.col("ws"))).alias("min_ws"), F.max(clean(F.col("ws"))).alias("max_ws"))


def shifted(records: DataFrame, offset: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Levels in other units, on a shifted datum."""
    return records.withColumn("level", F.col("level") * F.lit(float(scale)) + F.lit(float(offset)))


def strided(records: DataFrame, stride: int) -> DataFrame:
    """Every stride-th record, numbered anew."""
    return records.filter(F.col("rec") % stride == 0).withColumn("rec", F.expr(f"rec div {stride}"))


def modal_interval(times: DataFrame, at: str = "t") -> DataFrame:
    """(minutes, n): how often each spacing between successive times occurs, most frequent first."""
    order = Window.partitionBy(F.lit(0)).orderBy(at)
    gap = (F.unix_micros(F.col(at)) - F.unix_micros(F.lag(at).over(order))) / F.lit(60_000_000.0)
    gaps = times.select(gap.alias("minutes")).filter("minutes is not null")
    return gaps.groupBy("minutes").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "minutes")


def regular_interval(times: DataFrame, at: str = "t") -> int:
    """The spacing of a regular time column in minutes; an error that names the worst otherwise."""
    top = modal_interval(times, at).limit(4).collect()
    if not top:
        raise ValueError("two times at least are needed to tell their spacing")
    if len(top) > 1 or top[0]["minutes"] <= 0 or top[0]["minutes"] != int(top[0]["minutes"]):
        raise ValueError("times are not evenly spaced; spacings in minutes: " + ", ".join(f"{r['minutes']:g} ({r['n']}x)" for r in top[:3]))
    return int(top[0]["minutes"])


def harmonic(records: DataFrame, minutes: int, period_h: float = 12.4206012) -> DataFrame:
    """(gauge, c, s): least squares of cos and sin of one tidal period, without intercept, over the levels there are."""
    w = F.lit(2 * 3.141592653589793 / period_h) * F.col("rec") * F.lit(minutes / 60.0)
    rows = records.filter("level is not null").select("gauge", F.cos(w).alias("c"), F.sin(w).alias("s"), F.col("level").alias("x"))
    sums = rows.groupBy("gauge").agg(*[F.sum(F.expr(e)).alias(n) for n, e in (("cc", "c * c"), ("ss", "s * s"), ("cs", "c * s"), ("cx", "c * x"), ("sx", "s * x"))])
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    return sums.select("gauge", ((F.col("cx") * F.col("ss") - F.col("sx") * F.col("cs")) / det).alias("c"), ((F.col("sx") * F.col("cc") - F.col("cx") * F.col("cs")) / det).alias("s"))


def scale_harmonic(records: DataFrame, percent: float, minutes: int, period_h: float = 12.4206012) -> DataFrame:
    """Levels with the amplitude of one tidal period changed by so many percent."""
    if percent == 0:
        return records
    w = F.lit(2 * 3.141592653589793 / period_h) * F.col("rec") * F.lit(minutes / 60.0)
    fitted = records.join(F.broadcast(harmonic(records, minutes, period_h)), "gauge", "left")
    more = F.lit(percent / 100.0) * (F.coalesce("c", F.lit(0.0)) * F.cos(w) + F.coalesce("s", F.lit(0.0)) * F.sin(w))
    return fitted.withColumn("level", F.col("level") + more).select(*records.columns)
