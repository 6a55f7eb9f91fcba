"""Registered queries of the inundation operators, each with the SQL that restates it.

The tables stand in for the model's inputs: events are gauge records (a gauge an event type, a record
an hour), part is the grid of cells, supplier the station table, pages and part names the listings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import geo, levels, sun, text
from tidewright.operators import duration, hilo, series, stations, summary, tiles

EPOCH, HOURS, GAUGES = 1704067200000000, 720, 5
WINDOWS, REFUGES = {"shallow_band": (-1.5, 0.0)}, [0.2, 0.5, 1.0]
SITES = [(1, 5.0, 7.0), (2, 15.0, 14.0), (3, 25.0, 21.0), (4, 35.0, 28.0), (5, 45.0, 35.0)]
KINDS = ["click", "error", "purchase", "signup", "view"]
BOX = (-81.8, 24.1, -81.2, 24.6)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Bindings


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def gauge_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH)
    return read(spark, sf, "events").select("event_id", kind.alias("gauge"), micros.alias("us"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def observed(spark: SparkSession, sf: str, minutes: int = 60) -> DataFrame:
    """(gauge, rec, level): the hour's mean level in whole centimetres."""
    rows = gauge_events(spark, sf).withColumn("rec", F.expr(f"cast(us div {minutes * 60_000_000}L as int)"))
    cm = F.expr("sum(cents) div (50 * count(*)) - 100")
    return rows.groupBy("gauge", "rec").agg(cm.alias("cm")).select("gauge", "rec", (F.col("cm") / F.lit(100.0)).alias("level"))


def records(spark: SparkSession, sf: str, minutes: int = 60) -> DataFrame:
    """All hours, gaps as nulls."""
    gauges = spark.range(1, GAUGES + 1).select(F.col("id").cast("int").alias("gauge"))
    return series.grid(observed(spark, sf, minutes), gauges, HOURS * 60 // minutes)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    dem = ((F.col("p_size") - 25) * 8 + k % 7) / F.lit(100.0)
    return read(spark, sf, "part").select(k.alias("cell_id"), F.expr("cast(p_partkey div 50 as int)").alias("row"), (k % 50).cast("int").alias("col"), dem.alias("dem"), (k % 5 + 1).cast("int").alias("gauge"), (k % 97 == 0).alias("nodata"))


def station_table(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    offset = F.when(k % 4 != 0, F.round(F.col("s_acctbal") * 100).cast("long") / F.lit(1e6))
    return read(spark, sf, "supplier").select(F.lpad(k.cast("string"), 7, "0").alias("station_id"), F.col("s_name").alias("name"), (F.lit(24.0) + F.expr("s_suppkey div 20 % 20") * F.lit(0.05)).alias("lat"), (F.lit(-82.0) + (k % 20) * F.lit(0.05)).alias("lon"), F.col("s_nationkey").cast("string").alias("state"), offset.alias("offset_m"))


def tile_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.format_string("ncei19_n%dx%s_w0%dx50_%dv%d.tif", 24 + k % 8, F.element_at(F.array(*map(F.lit, ("00", "25", "50", "75"))), (k % 4 + 1).cast("int")), 80 + k % 9, 2014 + k % 6, 1 + k % 3)
    return read(spark, sf, "part").select(k.alias("k"), name.alias("name"))


def hilo_events(spark: SparkSession, sf: str) -> DataFrame:
    """High and low of each gauge's half days."""
    rows = gauge_events(spark, sf).withColumn("minute", F.expr("cast(us div 60000000L as int)")).withColumn("block", F.expr("minute div 720"))
    high = rows.groupBy("gauge", "block").agg(F.max(F.struct("cents", F.negative("event_id").alias("e"), "minute")).alias("x"))
    low = rows.groupBy("gauge", "block").agg(F.min(F.struct("cents", F.col("event_id").alias("e"), "minute")).alias("x"))
    every = high.select("gauge", "x.minute", "x.cents").unionAll(low.select("gauge", "x.minute", "x.cents"))
    return every.groupBy("gauge", F.col("minute").alias("t_min")).agg(F.max(F.expr("(cents div 50 - 100) / 100.0D")).alias("level"))


def half_days(spark: SparkSession) -> DataFrame:
    """Day d: sunrise 360 + d, sunset 1080 - d."""
    return spark.range(366).select(F.col("id").cast("int").alias("day"), (F.col("id") + 360).cast("int").alias("sunrise"), (1080 - F.col("id")).cast("int").alias("sunset"))


SQL = {
    "ev": f"ev as (select event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) as gauge, epoch_us(ts) - {EPOCH} as us, ts, cast(round(value * 100) as bigint) as cents from events)",
    "obs": "obs as (select gauge, us // 3600000000 as rec, cast(cast(sum(cents) as bigint) // (50 * count(*)) - 100 as double) / cast(100 as double) as level from ev group by all)",
    "rec": f"rec as (select g as gauge, r as rec, level from (select unnest(range(1, {GAUGES + 1})) as g), (select unnest(range(0, {HOURS})) as r) left join obs on gauge = g and rec = r)",
    "held": "held as (select gauge, rec, coalesce(last_value(level ignore nulls) over (partition by gauge order by rec rows between unbounded preceding and current row), first_value(level ignore nulls) over (partition by gauge order by rec rows between current row and unbounded following)) as ws from rec)",
    "cells": "cells as (select p_partkey as cell_id, p_partkey // 50 as row, p_partkey % 50 as col, cast((p_size - 25) * 8 + p_partkey % 7 as double) / cast(100 as double) as dem, p_partkey % 5 + 1 as gauge, p_partkey % 97 = 0 as nodata from part)",
    "base": "base as (select * from cells where not nodata)",
    "st": "st as (select lpad(cast(s_suppkey as varchar), 7, '0') as station_id, s_name as name, cast(24 as double) + (s_suppkey // 20 % 20) * cast(0.05 as double) as lat, cast(-82 as double) + (s_suppkey % 20) * cast(0.05 as double) as lon, cast(s_nationkey as varchar) as state, case when s_suppkey % 4 <> 0 then cast(cast(round(s_acctbal * 100) as bigint) as double) / cast(1000000 as double) end as offset_m from supplier)",
    "tile": "tile as (select p_partkey as k, 'ncei19_n' || (24 + p_partkey % 8) || 'x' || ['00', '25', '50', '75'][p_partkey % 4 + 1] || '_w0' || (80 + p_partkey % 9) || 'x50_' || (2014 + p_partkey % 6) || 'v' || (1 + p_partkey % 3) || '.tif' as name from part)",
    "parsed": "parsed as (select *, cast(regexp_extract(name, 'n(\\d+)x(\\d+)_', 1) as int) + cast(regexp_extract(name, 'n(\\d+)x(\\d+)_', 2) as int) / cast(100 as double) - cast(0.25 as double) as sw_lat, -(cast(regexp_extract(name, '_w(\\d+)x(\\d+)_', 1) as int) + cast(regexp_extract(name, '_w(\\d+)x(\\d+)_', 2) as int) / cast(100 as double)) as sw_lon, cast(regexp_extract(name, '_(\\d{4})v', 1) as int) as year, cast(regexp_extract(name, 'v(\\d+)\\.tif', 1) as int) as version from tile)",
    "hl": "blk as (select *, us // 60000000 as minute, us // 60000000 // 720 as block from ev), hl as (select gauge, minute as t_min, max(cast(cents // 50 - 100 as double) / cast(100 as double)) as level from (select gauge, minute, cents from blk qualify row_number() over (partition by gauge, block order by cents desc, event_id) = 1 union all select gauge, minute, cents from blk qualify row_number() over (partition by gauge, block order by cents, event_id) = 1) group by gauge, minute)",
}
NEEDS = {"obs": ["ev"], "rec": ["ev", "obs"], "held": ["ev", "obs", "rec"], "base": ["cells"], "parsed": ["tile"], "hl": ["ev"]}


def sql(body: str, *names: str, more: str = "") -> str:
    """The body after the bindings it needs, in order."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*NEEDS.get(name, []), name) if n not in order]
    parts = [SQL[n] for n in order] + [more] * bool(more)
    return (f"with {', '.join(parts)} " if parts else "") + body


def register(oracle: str | None = None):
    def take(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[query.__name__] = query
        if oracle:
            ORACLE_SQL[query.__name__] = oracle
        return query

    return take


def _tests(d: str, n: str = "60") -> str:
    out = [f"sum(case when {d} >= cast(-1.5 as double) and {d} <= 0 then {n} else 0 end)::bigint as win_shallow_band"]
    out += [f"sum(case when {d} < 0 and {d} >= cast(-{t} as double) then {n} else 0 end)::bigint as ref_{levels.threshold_slug_of(t)}" for t in REFUGES]
    return ", ".join(out)


# Kernel


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return series.surface(series.resample(records(spark, sf), 60, 60))


@register(sql(f"select cell_id, {_tests('dem - ws')} from base join held using (gauge) group by cell_id", "held", "base"))
def flagship_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes of each cell in a window and three refuges."""
    out = duration.inundation(cells(spark, sf), _steps(spark, sf), WINDOWS, REFUGES, 60)
    return out.drop("gauge", "dem", "never_submerged")


def _plan(plan: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        steps = duration.lit_steps(_steps(spark, sf), 60)
        return duration.minutes(duration.usable(cells(spark, sf)), steps, WINDOWS, REFUGES, 60, plan=plan)

    return run


for _name in ("naive", "levels", "search"):
    QUERIES[f"kernel_{_name}"] = _plan(_name)
    ORACLE_SQL[f"kernel_{_name}"] = ORACLE_SQL["flagship_minutes"]


@register(sql(f"select cell_id, rec // 24 as day, {_tests('dem - ws')} from base join held using (gauge) group by cell_id, day", "held", "base"))
def kernel_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The same by day."""
    return duration.inundation(cells(spark, sf), _steps(spark, sf), WINDOWS, REFUGES, 60, by_day=True, pruned=False)


def _daylight_sql(test: str) -> str:
    lit = f"lit as (select gauge, ws from held where {test})"
    zero = ", ".join(f"coalesce({c}, 0) as {c}" for c in ("win_shallow_band", *(f"ref_{levels.threshold_slug_of(t)}" for t in REFUGES)))
    return sql(f"select cell_id, {zero} from base left join (select cell_id, {_tests('dem - ws')} from base join lit using (gauge) group by cell_id) using (cell_id)", "held", "base", more=lit)


@register(_daylight_sql("(rec % 24 + 1) * 60 between 360 + rec // 24 and 1080 - rec // 24"))
def kernel_daylight(spark: SparkSession, sf: str) -> DataFrame:
    """Steps that end in daylight, bounds included."""
    return duration.inundation(cells(spark, sf), _steps(spark, sf), WINDOWS, REFUGES, 60, half_days(spark)).drop("gauge", "dem", "never_submerged")


@register(_daylight_sql("(rec % 24 + 1) * 60 > 360 + rec // 24 and (rec % 24 + 1) * 60 < 1080 - rec // 24"))
def kernel_daylight_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    return duration.inundation(cells(spark, sf), _steps(spark, sf), WINDOWS, REFUGES, 60, half_days(spark), exclusive=True).drop("gauge", "dem", "never_submerged")


_EXT = "ext as (select gauge, min(ws) as min_ws, max(ws) as max_ws from held group by gauge)"
_FLAGS = "flags as (select cell_id, not (dem < min_ws - cast(1.5 as double)) and not (dem - max_ws > 0 and dem - max_ws >= 0) as active, dem - max_ws >= 0 as never_submerged from base join ext using (gauge))"


@register(sql("select gauge, min_ws, max_ws from ext", "held", more=_EXT))
def gauge_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """A4"""
    return series.extremes(_steps(spark, sf))


@register(sql("select cell_id, active, never_submerged from flags", "held", "base", more=f"{_EXT}, {_FLAGS}"))
def prune_flags(spark: SparkSession, sf: str) -> DataFrame:
    """P7-P9"""
    ext = series.extremes(_steps(spark, sf))
    return duration.prune(duration.usable(cells(spark, sf)), ext, WINDOWS, REFUGES).select("cell_id", "active", "never_submerged")


@register(sql("select (select count(*) from cells) as cells, count(*) as base, count(*) filter (where active) as active, count(*) filter (where not active) as pruned, count(*) filter (where never_submerged) as never_submerged from flags", "held", "base", more=f"{_EXT}, {_FLAGS}"))
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """A17"""
    every = cells(spark, sf)
    return summary.run_counters(every, duration.prune(duration.usable(every), series.extremes(_steps(spark, sf)), WINDOWS, REFUGES))


@register(sql("select gauge, ws, count(*) as n from held group by gauge, ws", "held"))
def level_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return duration.histogram(duration.lit_steps(_steps(spark, sf), 60))


_MIN = f"m as (select cell_id, {_tests('dem - ws')} from base join held using (gauge) group by cell_id)"


@register(sql("select cell_id, win_shallow_band, win_shallow_band / cast(30 as double) as win_shallow_band_per_day, cast(win_shallow_band > 0 as tinyint) as win_shallow_band_area, ref_0p50, ref_0p50 / cast(30 as double) as ref_0p50_per_day from m", "held", "base", more=_MIN))
def metric_rasters(spark: SparkSession, sf: str) -> DataFrame:
    """P21, P22, K1"""
    return duration.rasters(flagship_minutes(spark, sf), ["win_shallow_band", "ref_0p50"], 30)


@register(sql("select cell_id, row, col, case when not nodata then cast(win_shallow_band as double) else -9999 end as value from cells left join m using (cell_id)", "held", "base", more=_MIN))
def raster_nodata(spark: SparkSession, sf: str) -> DataFrame:
    """P23, F21"""
    every = cells(spark, sf).join(flagship_minutes(spark, sf), "cell_id", "left")
    return every.select("cell_id", "row", "col", levels.filled(F.col("win_shallow_band").cast("double"), ~F.col("nodata")).alias("value"))


_AREA = "0.09"
_SUMS = "select 'area_available' as metric, 'shallow_band' as window_or_threshold, count(*) filter (where win_shallow_band > 0) * cast(0.09 as double) as value, 'ha' as units from m union all select 'time_integrated', 'shallow_band', sum(win_shallow_band)::bigint * cast(0.09 as double) / 60, 'ha_hours' from m" + "".join(f" union all select 'refugia_time', '{t:g}', sum(ref_{levels.threshold_slug_of(t)})::bigint * cast(0.09 as double) / 60, 'ha_hours' from m" for t in REFUGES)


@register(sql(f"select 'base' as run_id, metric, window_or_threshold, round(value, 6) as value, units, 'driver tables' as origin from ({_SUMS})", "held", "base", more=_MIN))
def summary_long(spark: SparkSession, sf: str) -> DataFrame:
    """A5-A7, D15, K3"""
    row = summary.totals(flagship_minutes(spark, sf), list(WINDOWS), REFUGES, 900.0)
    return summary.long_form(row, "base", list(WINDOWS), REFUGES, {"origin": "driver tables", "value": "ignored"}).withColumn("value", F.round("value", 6))


@register(sql("select 'low' as run_id, count(*) filter (where w > 0) as n, sum(w)::bigint as minutes from (select cell_id, sum(case when dem - ws >= cast(-1.5 as double) and dem - ws <= 0 then 60 else 0 end) as w from base join held using (gauge) group by cell_id) union all select 'high', count(*) filter (where w > 0), sum(w)::bigint from (select cell_id, sum(case when dem - (ws + cast(0.25 as double)) >= cast(-1.5 as double) and dem - (ws + cast(0.25 as double)) <= 0 then 60 else 0 end) as w from base join held using (gauge) group by cell_id)", "held", "base"))
def runs_with_offset(spark: SparkSession, sf: str) -> DataFrame:
    """P10, A8"""
    out = []
    for name, offset in (("low", 0.0), ("high", 0.25)):
        steps = series.surface(series.resample(series.shifted(records(spark, sf), offset), 60, 60))
        found = duration.inundation(cells(spark, sf), steps, WINDOWS, [], 60)
        out.append(found.agg(F.lit(name).alias("run_id"), F.count_if(F.col("win_shallow_band") > 0).alias("n"), F.sum("win_shallow_band").alias("minutes")))
    return summary.table(*out)


# Series


@register(sql("select gauge, rec, ws as level from held", "held"))
def gaps_held(spark: SparkSession, sf: str) -> DataFrame:
    """W1, W2, D4"""
    return series.hold_gaps(records(spark, sf))


_NB = "nb as (select gauge, rec, last_value(level ignore nulls) over p as v0, last_value(case when level is not null then rec end ignore nulls) over p as t0, first_value(level ignore nulls) over f as v1, first_value(case when level is not null then rec end ignore nulls) over f as t1 from rec window p as (partition by gauge order by rec rows between unbounded preceding and current row), f as (partition by gauge order by rec rows between current row and unbounded following))"


@register(sql("select gauge, rec, round(case when v0 is null then v1 when v1 is null or t0 = t1 then v0 else v0 + (v1 - v0) * (rec - t0) / (t1 - t0) end, 9) + cast(0 as double) as level from nb", "rec", more=_NB))
def gaps_bridged(spark: SparkSession, sf: str) -> DataFrame:
    """W3"""
    return series.bridge_gaps(records(spark, sf)).withColumn("level", F.round("level", 9))


@register(sql("select coalesce(max(n), 0) as longest from (select count(*) as n from (select rec - row_number() over (order by rec) as island from (select rec from rec group by rec having bool_or(level is null))) group by island)", "rec"))
def longest_gap(spark: SparkSession, sf: str) -> DataFrame:
    """A22, W9"""
    return series.longest_gap(records(spark, sf))


@register(sql("select gauge, count(*) as n_records, count(level) as n_levels, round(count(*) filter (where level is null) * cast(100 as double) / count(*), 6) as gap_pct from rec group by gauge", "rec"))
def gap_share(spark: SparkSession, sf: str) -> DataFrame:
    """A11, A21"""
    return series.gap_share(records(spark, sf)).withColumn("gap_pct", F.round("gap_pct", 6))


_BR = "br as (select gauge, j as step, j * {ts} // 60 as i, cast(j * {ts} - j * {ts} // 60 * 60 as double) / cast(60 as double) as f from (select unnest(range(1, 6)) as gauge), (select unnest(range(0, {n})) as j))"
_AT = " from br left join rec a on a.gauge = br.gauge and a.rec = i left join rec b on b.gauge = br.gauge and b.rec = i + 1"


def _resample_sql(expression: str, ts: int) -> str:
    body = f"select br.gauge, step, round(case when i = {HOURS - 1} then a.level else {expression} end, 9) + cast(0 as double) as ws" + _AT
    return sql(body, "rec", more=_BR.format(ts=ts, n=HOURS * 60 // ts))


@register(_resample_sql("a.level + f * (b.level - a.level)", 20))
def resample_linear(spark: SparkSession, sf: str) -> DataFrame:
    """W6, W7, J3, D5"""
    return series.resample(records(spark, sf), 60, 20).withColumn("ws", F.round("ws", 9))


@register(_resample_sql("cast(0.5 as double) * (a.level + b.level) + cast(0.5 as double) * (b.level - a.level) * sin(pi() * (f - cast(0.5 as double)))", 20))
def resample_sinusoidal(spark: SparkSession, sf: str) -> DataFrame:
    """F1"""
    return series.resample(records(spark, sf), 60, 20, "sinusoidal").withColumn("ws", F.round("ws", 9))


@register(_resample_sql("a.level", 45))
def resample_hold(spark: SparkSession, sf: str) -> DataFrame:
    return series.resample(records(spark, sf), 60, 45, "hold").withColumn("ws", F.round("ws", 9))


@register(_resample_sql("a.level + f * (b.level - a.level)", 90))
def resample_coarser(spark: SparkSession, sf: str) -> DataFrame:
    return series.resample(records(spark, sf), 60, 90).withColumn("ws", F.round("ws", 9))


@register(sql("select gauge, rec as step, round(first_value(level) over w + sum(coalesce(d, 0)) over w, 6) + cast(0 as double) as ws from (select *, level - lag(level) over (partition by gauge order by rec) as d from rec) window w as (partition by gauge order by rec rows between unbounded preceding and current row)", "rec"))
def surface_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """W5, W11"""
    out = series.surface(series.resample(records(spark, sf), 60, 60), "incremental", "nan")
    return out.select("gauge", "step", F.round("ws", 6).alias("ws"))


@register(sql("select gauge, rec, round(level * cast(0.3048 as double) + cast(0.1 as double), 9) + cast(0 as double) as level from rec where rec < 48", "rec"))
def scaled_first_days(spark: SparkSession, sf: str) -> DataFrame:
    """P11, P19"""
    return series.first_days(series.shifted(records(spark, sf), 0.1, 0.3048), 60, 2).withColumn("level", F.round("level", 9))


@register(sql("select gauge, rec, level from rec where rec < 720 - 720 % 24", "rec"))
def whole_days(spark: SparkSession, sf: str) -> DataFrame:
    """P20"""
    return series.whole_days(records(spark, sf), 60)


@register(sql("select gauge, rec // 6 as rec, level from rec where rec % 6 = 0", "rec"))
def strided(spark: SparkSession, sf: str) -> DataFrame:
    """O6"""
    return series.strided(records(spark, sf), 6)


@register("select minutes, count(*) as n from (select (epoch_us(ts) - lag(epoch_us(ts)) over (order by ts)) / cast(60000000 as double) as minutes from (select distinct ts from events)) where minutes is not null group by minutes order by n desc, minutes limit 3")
def modal_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """A9, W4, O5"""
    times = read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("t")).distinct()
    return series.modal_interval(times).limit(3)


_M2 = "m2 as (select gauge, cos(2 * pi() / 12.4206012 * rec) as c, sin(2 * pi() / 12.4206012 * rec) as s, level as x from obs)"


@register(sql("select gauge, round((cx * ss - sx * cs) / (cc * ss - cs * cs), 6) as c, round((sx * cc - cx * cs) / (cc * ss - cs * cs), 6) as s from (select gauge, sum(c * c) as cc, sum(s * s) as ss, sum(c * s) as cs, sum(c * x) as cx, sum(s * x) as sx from m2 group by gauge)", "obs", more=_M2))
def harmonic_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A16"""
    return series.harmonic(records(spark, sf), 60).select("gauge", F.round("c", 6).alias("c"), F.round("s", 6).alias("s"))


@register(sql("select r.gauge, rec, round(level + cast(0.1 as double) * (c * cos(2 * pi() / 12.4206012 * rec) + s * sin(2 * pi() / 12.4206012 * rec)), 6) + cast(0 as double) as level from rec r join (select gauge, (cx * ss - sx * cs) / (cc * ss - cs * cs) as c, (sx * cc - cx * cs) / (cc * ss - cs * cs) as s from (select gauge, sum(c * c) as cc, sum(s * s) as ss, sum(c * s) as cs, sum(c * x) as cx, sum(s * x) as sx from m2 group by gauge)) q on r.gauge = q.gauge", "rec", more=_M2))
def harmonic_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return series.scale_harmonic(records(spark, sf), 10.0, 60).withColumn("level", F.round("level", 6))


# High and low waters

_SEG = "seg as (select gauge, t_min as t0, lead(t_min) over w as t1, level as h0, lead(level) over w as h1 from hl window w as (partition by gauge order by t_min))"


@register(sql("select gauge, t0, t1, h0, h1 from seg where t1 > t0", "hl", more=_SEG))
def hilo_segments(spark: SparkSession, sf: str) -> DataFrame:
    """D7, A12"""
    return hilo.segments(hilo_events(spark, sf))


@register(sql(f"select g as gauge, m as minute, round(coalesce(cast(0.5 as double) * (h0 + h1) + cast(0.5 as double) * (h1 - h0) * sin(pi() * (cast(m - t0 as double) / (t1 - t0) - cast(0.5 as double))), case when m >= e then tail else 0 end), 6) + cast(0 as double) as level from (select gauge as g, max(t_min) as e, arg_max(level, t_min) as tail from hl group by gauge) x cross join (select unnest(range(0, {HOURS * 60})) as m) left join seg on gauge = g and t1 > t0 and m >= t0 and m < t1", "hl", more=_SEG))
def hilo_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """J6 over all days"""
    return hilo.minute_series(hilo_events(spark, sf), HOURS * 60).withColumn("level", F.round("level", 6))


@register(sql("select gauge, t_min, level from hl where t_min between -2880 and 4320", "hl"))
def hilo_near(spark: SparkSession, sf: str) -> DataFrame:
    """P25"""
    return hilo.near(hilo_events(spark, sf), 1440)


# Gauges for cells


@register(sql(f"select cell_id, case when nodata then 0 else g end as gauge from (select cell_id, nodata, arg_min(g, 1000 * ((col + 0.5 - x) * (col + 0.5 - x) + (row + 0.5 - y) * (row + 0.5 - y)) + g) as g from cells, (values {', '.join(map(str, SITES))}) s(g, x, y) group by all)", "cells"))
def nearest_gauge(spark: SparkSession, sf: str) -> DataFrame:
    """J2, P18, F11, D2"""
    sites = spark.createDataFrame(SITES, "gauge int, x double, y double")
    x, y = geo.pixel_x(F.col("col"), F.col("row"), 1.0, 0.0, 0.0), geo.pixel_x(F.col("col"), F.col("row"), 0.0, 1.0, 0.0)
    return stations.nearest_gauge(cells(spark, sf), sites, x, y, F.col("nodata")).select("cell_id", "gauge")


@register(sql("select cell_id, g as gauge from (select cell_id, arg_min(s_suppkey, ((col * 7 - s_suppkey * 37 % 400) * (col * 7 - s_suppkey * 37 % 400) + (row * 3 - s_suppkey * 91 % 300) * (row * 3 - s_suppkey * 91 % 300)) * 100000 + s_suppkey) as g from cells, supplier group by cell_id)", "cells"))
def nearest_of_many(spark: SparkSession, sf: str) -> DataFrame:
    """J2 with more sites than fit a plan"""
    sites = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("gauge"), (F.col("s_suppkey") * 37 % 400).alias("x"), (F.col("s_suppkey") * 91 % 300).alias("y"))
    return stations.nearest_gauge(cells(spark, sf), sites, F.col("col") * 7.0, F.col("row") * 3.0).select("cell_id", "gauge")


# Stations

_BOXED = f"lon between {BOX[0]} and {BOX[2]} and lat between {BOX[1]} and {BOX[3]}"


@register(sql(f"select station_id, name, lat, lon, state, offset_m, row_number() over (order by station_id) - 1 as gauge_idx from st where {_BOXED}", "st"))
def stations_in_box(spark: SparkSession, sf: str) -> DataFrame:
    """P15, P16, O1, W8, D8"""
    return stations.numbered(stations.at_least(stations.within(station_table(spark, sf), BOX), 0))


@register(sql("select station_id, source from (select station_id, 'a' as source, 0 as r from st where cast(station_id as int) % 3 = 0 union all select station_id, 'b', 1 from st) qualify row_number() over (partition by station_id order by r) = 1", "st"))
def station_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """U1, U2, A12"""
    every = station_table(spark, sf)
    first = every.filter(F.col("station_id").cast("int") % 3 == 0).withColumn("source", F.lit("a"))
    return stations.catalogue(first, every.withColumn("source", F.lit("b"))).select("station_id", "source")


_ST2 = "one as (select station_id, offset_m from st where cast(station_id as int) % 2 = 0), two as (select station_id, cast(station_id as int) / cast(1000 as double) as offset_m from st where cast(station_id as int) % 3 = 0)"


@register(sql("select st.station_id, coalesce(one.offset_m, two.offset_m) as offset_m, case when one.offset_m is not null then 'published' when two.offset_m is not null then 'manual' end as offset_source from st left join one using (station_id) left join two using (station_id)", "st", more=_ST2))
def offset_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """J17, S10-S12"""
    return _cascade(spark, sf)


def _cascade(spark: SparkSession, sf: str) -> DataFrame:
    every, key = station_table(spark, sf), F.col("station_id").cast("int")
    one = every.filter(key % 2 == 0).select("station_id", "offset_m")
    two = every.filter(key % 3 == 0).select("station_id", (key / F.lit(1000.0)).alias("offset_m"))
    return stations.cascade(every.select("station_id"), [("published", one), ("manual", two)])


@register(sql("select coalesce(case when one.offset_m is not null then 'published' when two.offset_m is not null then 'manual' end, 'unresolved') as offset_source, count(*) as n from st left join one using (station_id) left join two using (station_id) group by 1", "st", more=_ST2))
def offset_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A13"""
    return stations.source_counts(_cascade(spark, sf))


_HAV = "2 * 6371.0088::double * asin(sqrt(pow(sin(radians(k.lat - u.lat) / 2), 2) + cos(radians(u.lat)) * cos(radians(k.lat)) * pow(sin(radians(k.lon - u.lon) / 2), 2)))"


@register(sql(f"select station_id, round(sum(pow(km, -2) * v) / sum(pow(km, -2)), 6) as offset_m from (select u.station_id, k.station_id as from_id, k.offset_m as v, {_HAV} as km from st u, st k where u.offset_m is null and k.offset_m is not null qualify row_number() over (partition by u.station_id order by round({_HAV}, 9), k.station_id) <= 3) group by station_id", "st"))
def offset_idw(spark: SparkSession, sf: str) -> DataFrame:
    """J14, A15, W10, F2"""
    return stations.interpolated(station_table(spark, sf), 2.0, 3).withColumn("offset_m", F.round("offset_m", 6))


@register(sql("select station_id, offset_m, row_number() over (order by station_id) - 1 as gauge_idx from st where offset_m is not null", "st"))
def usable_stations(spark: SparkSession, sf: str) -> DataFrame:
    """P17"""
    return stations.split_usable(station_table(spark, sf))[0].select("station_id", "offset_m", "gauge_idx")


@register(sql("select gauge, rec, round(level + gauge * cast(0.1 as double), 9) + cast(0 as double) as level from obs", "obs"))
def datum_shift(spark: SparkSession, sf: str) -> DataFrame:
    """P12, J9"""
    offsets = spark.createDataFrame([(g, g * 0.1) for g in range(1, GAUGES + 1)], "gauge int, offset_m double")
    return stations.apply_offsets(observed(spark, sf), offsets).select("gauge", "rec", F.round("level", 9).alias("level"))


@register(sql("select cast(gauge as varchar) as station_id, count(*) as n_records, round(count(*) * cast(100 as double) / 720, 6) as coverage_pct, case when count(*) * cast(100 as double) / 720 >= 80 then 'obs_6min' when gauge < 3 then 'pred_hilo' else 'empty' end as record_type from obs group by gauge", "obs"))
def record_types(spark: SparkSession, sf: str) -> DataFrame:
    """S9, A10, A14, D9"""
    obs = observed(spark, sf).select(F.col("gauge").cast("string").alias("station_id"), F.col("level").alias("v"))
    predicted = spark.createDataFrame([("1",), ("2",)], "station_id string")
    out = stations.record_types(stations.coverage(obs, 30, 24), predicted)
    return out.withColumn("coverage_pct", F.round("coverage_pct", 6))


@register(sql("select cast(gauge as varchar) as station_id, rec, level from rec", "rec"))
def grid_exact(spark: SparkSession, sf: str) -> DataFrame:
    """J4"""
    return stations.onto_grid(*_station_obs(spark, sf), "2024-01-01", HOURS, 60, bridge=False)


def _station_obs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    at = F.timestamp_micros(F.lit(EPOCH) + F.col("rec").cast("long") * 3_600_000_000)
    obs = observed(spark, sf).select(F.col("gauge").cast("string").alias("station_id"), at.alias("t"), F.col("level").cast("string").alias("v"))
    return obs, spark.range(1, GAUGES + 1).select(F.col("id").cast("string").alias("station_id"))


@register(sql("select cast(gauge as varchar) as station_id, rec, round(case when v0 is not null and (v1 is null or t0 = t1) then v0 when v0 is not null then v0 + (v1 - v0) * (cast(rec - t0 as double) / (t1 - t0)) end, 9) + cast(0 as double) as level from nb", "rec", more=_NB))
def grid_bridged(spark: SparkSession, sf: str) -> DataFrame:
    """J5, U3"""
    return stations.onto_grid(*_station_obs(spark, sf), "2024-01-01", HOURS, 60).withColumn("level", F.round("level", 9))


@register(sql("select gauge, rec, level from rec union all select gauge + 5, rec, level + 1 from rec", "rec"))
def hybrid_series(spark: SparkSession, sf: str) -> DataFrame:
    """J18, X19"""
    own = records(spark, sf)
    return stations.hybrid(own, series.shifted(own, 1.0))


# Geodesy, sun and text


@register("select s_suppkey, 'EPSG:' || case when lat >= 0 then '326' else '327' end || lpad(cast(least(60, greatest(1, cast(trunc((lon + 180) / 6) as int) + 1)) as varchar), 2, '0') as epsg, case when lon between -180 and -129 and lat between 50 and 72 then 'ak' when lon between -172 and -168 and lat between -16 and -13 then 'as' when lon between 144 and 146.5 and lat between 13 and 21 then 'gcnmi' when lon between -68 and -64 and lat between 17 and 19 then 'prvi' when lon between -180 and -154 and lat between 18 and 23 then 'westcoast' else 'contiguous' end as region from (select s_suppkey, cast(s_suppkey * 7919 % 3600 - 1800 as double) / 10 as lon, cast(s_suppkey * 104729 % 1600 - 800 as double) / 10 as lat from supplier)")
def crs_and_region(spark: SparkSession, sf: str) -> DataFrame:
    """F9, J12, F23, S22"""
    k = F.col("s_suppkey")
    lon, lat = (k * 7919 % 3600 - 1800).cast("double") / 10, (k * 104729 % 1600 - 800).cast("double") / 10
    return read(spark, sf, "supplier").select("s_suppkey", geo.utm_epsg(lon, lat).alias("epsg"), tiles.datum_region(lon, lat).alias("region"))


@register(sql("select station_id, round(greatest(-180, lon - 10 / (cast(111.32 as double) * greatest(abs(cos(radians(lat))), 1e-6))), 9) as xmin, round(greatest(-90, lat - 10 / cast(110.574 as double)), 9) as ymin, round(least(180, lon + 10 / (cast(111.32 as double) * greatest(abs(cos(radians(lat))), 1e-6))), 9) as xmax, round(least(90, lat + 10 / cast(110.574 as double)), 9) as ymax from st", "st"))
def boxes_around(spark: SparkSession, sf: str) -> DataFrame:
    """F3-F5"""
    lon, lat = F.col("lon"), F.col("lat")
    box = geo.buffered(lon, lat, lon, lat, F.lit(10.0))
    return station_table(spark, sf).select("station_id", *[F.round(c, 9).alias(n) for c, n in zip(box, ("xmin", "ymin", "xmax", "ymax"), strict=True)])


@register(sql("select station_id, i, round(lon + 2 / (cast(111.32 as double) * cos(radians(lat))) * cos((i % 128) * (2 * pi() / 128)), 9) as x, round(lat + 2 / cast(110.574 as double) * sin((i % 128) * (2 * pi() / 128)), 9) as y from (select *, unnest(range(0, 129)) as i from st)", "st"))
def circles(spark: SparkSession, sf: str) -> DataFrame:
    """F6"""
    rings = station_table(spark, sf).select("station_id", F.posexplode(geo.circle(F.col("lon"), F.col("lat"), F.lit(2.0))).alias("i", "p"))
    return rings.select("station_id", "i", F.round("p.lon", 9).alias("x"), F.round("p.lat", 9).alias("y"))


@register("with d as (select unnest(range(0, 366)) as day), g as (select day, 2 * pi() / 366 * day as g from d), s as (select day, greatest(-1, least(1, -tan(radians(24.6)) * tan(cast(0.006918 as double) + cast(-0.399912 as double) * cos(g) + cast(0.070257 as double) * sin(g) + cast(-0.006758 as double) * cos(2 * g) + cast(0.000907 as double) * sin(2 * g)))) as c from g) select cast(day as int) as day, cast(trunc(720 + 4 * 81.5 - degrees(acos(c)) / 15 * 60) as int) as sunrise, cast(trunc(720 + 4 * 81.5 + degrees(acos(c)) / 15 * 60) as int) as sunset from s")
def sun_table(spark: SparkSession, sf: str) -> DataFrame:
    """F15, X17"""
    return sun.daylight_table(spark, 24.6, -81.5, 2024)


@register(sql("select k, name, sw_lat, sw_lon, year, version from parsed", "parsed"))
def tiles_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """F16, D13"""
    return tile_names(spark, sf).withColumn("t", text.tile(F.col("name"))).select("k", "name", "t.*")


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return tiles_parsed(spark, sf).withColumn("size_mb", (F.col("k") % 50).cast("double"))


@register(sql("select distinct name from parsed where sw_lon < -83.2 and sw_lon + 0.25 > -85.6 and sw_lat < 27.6 and sw_lat + 0.25 > 25.1", "parsed"))
def tiles_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    """J10, X14"""
    return tiles.tiles_in(_parsed(spark, sf), (-85.6, 25.1, -83.2, 27.6)).select("name").distinct()


@register(sql("select sw_lat, sw_lon, year, version from parsed qualify row_number() over (partition by round(sw_lat, 4), round(sw_lon, 4) order by year desc, version desc, name) = 1", "parsed"))
def tiles_newest(spark: SparkSession, sf: str) -> DataFrame:
    """A12 by footprint"""
    return tiles.newest(_parsed(spark, sf)).select("sw_lat", "sw_lon", "year", "version")


@register(sql("select min(sw_lon) as xmin, min(sw_lat) as ymin, max(sw_lon + 0.25) as xmax, max(sw_lat + 0.25) as ymax, count(*) as n, sum(cast(k % 50 as double)) as size_mb from parsed", "parsed"))
def tiles_footprint(spark: SparkSession, sf: str) -> DataFrame:
    """A18, A19"""
    return tiles.footprint(_parsed(spark, sf))


@register(sql("select name, row_number() over (order by sw_lat, sw_lon, name) as priority from (select distinct name, sw_lat, sw_lon from parsed)", "parsed"))
def tiles_priority(spark: SparkSession, sf: str) -> DataFrame:
    """O3"""
    return tiles.prioritised(_parsed(spark, sf).select("name", "sw_lat", "sw_lon").distinct()).select("name", "priority")


@register("select p_partkey // 4 % 50 as row, p_partkey // 200 % 50 as col, arg_min(z, priority) as dem from (select p_partkey, p_partkey % 4 as priority, case when p_size > 5 then p_size end as z from part) where z is not null group by 1, 2")
def mosaic(spark: SparkSession, sf: str) -> DataFrame:
    """J13 (overlay); of equal priorities the lowest key's, which the SQL meets first"""
    k = F.col("p_partkey")
    pixels = read(spark, sf, "part").select(F.expr("p_partkey div 4 % 50").alias("row"), F.expr("p_partkey div 200 % 50").alias("col"), F.struct((k % 4).alias("tile"), k.alias("key")).alias("priority"), F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("z"))
    first = tiles.mosaic(pixels).filter("dem is not null")
    return first.select("row", "col", F.col("dem").cast("int").alias("dem"))


@register("with r(region, xmin, ymin, xmax, ymax) as (values ('AL_nwFL', -88.6, 29.5, -84.0, 31.1), ('FL', -84.5, 24.2, -79.8, 31.2), ('southeast', -82.0, 30.3, -78.5, 34.0)) select lower(region) as region from r")
def regions_for_box(spark: SparkSession, sf: str) -> DataFrame:
    """Spelled as the listing has it"""
    listed = tiles.regions(spark).select(F.lower("region").alias("region"))
    return tiles.regions_for(spark, (-86.0, 30.0, -81.0, 31.0), listed)


@register("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as link from pages")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """S13, S14"""
    return read(spark, sf, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("link"))


@register("select link, min(rank) as first from (select unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as link, page_id as rank from pages) group by link")
def links_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """U6"""
    return page_links(spark, sf).groupBy("link").agg(F.min("page_id").alias("first"))


@register("select event_id, try_cast(json_extract_string(props, '$.k') as double) as k from events")
def json_picks(spark: SparkSession, sf: str) -> DataFrame:
    """F20, P14, P26"""
    return read(spark, sf, "events").select("event_id", text.number(text.first_of(F.col("props"), "$.missing", "$.k")).alias("k"))


@register(f"select event_id, cast(trunc((epoch_us(ts) - {EPOCH + 86_400_000_000}) / cast(60000000 as double)) as int) as minute from events")
def relative_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """F19, F18"""
    return read(spark, sf, "events").select("event_id", text.relative_minutes(F.col("ts").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")).alias("minute"))


@register("select p_partkey, replace(printf('%.2f', p_size / cast(50 as double)), '.', 'p') as thr, translate(trim(p_name), ' /', '_-') as slug from part")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    """F17, K2"""
    return read(spark, sf, "part").select("p_partkey", levels.threshold_slug(F.col("p_size") / F.lit(50.0)).alias("thr"), levels.slug(F.col("p_name")).alias("slug"))


@register("select o_orderkey, cast(o_orderdate as date) as day, datediff('day', date '1992-01-01', cast(o_orderdate as date)) as n_days, make_date(year(o_orderdate), 12, 31) as year_end from orders")
def date_windows(spark: SparkSession, sf: str) -> DataFrame:
    """F18"""
    day = F.to_date("o_orderdate")
    return read(spark, sf, "orders").select("o_orderkey", day.alias("day"), F.datediff(day, F.lit("1992-01-01").cast("date")).alias("n_days"), F.make_date(F.year(day), F.lit(12), F.lit(31)).alias("year_end"))


# Shapes of tables, checks and results


@register(sql("select rec, max(case when gauge = 1 then level end) as g1, max(case when gauge = 2 then level end) as g2, max(case when gauge = 3 then level end) as g3, max(case when gauge = 4 then level end) as g4, max(case when gauge = 5 then level end) as g5 from rec group by rec", "rec"))
def series_wide(spark: SparkSession, sf: str) -> DataFrame:
    """K5: a column a gauge"""
    wide = records(spark, sf).groupBy("rec").pivot("gauge", list(range(1, GAUGES + 1))).agg(F.first("level"))
    return wide.toDF("rec", *[f"g{i}" for i in range(1, GAUGES + 1)])


@register(sql("select gauge, rec, level from rec", "rec"))
def series_long(spark: SparkSession, sf: str) -> DataFrame:
    """And back"""
    long = series_wide(spark, sf).unpivot("rec", [f"g{i}" for i in range(1, GAUGES + 1)], "name", "level")
    return long.select(F.substring("name", 2, 9).cast("int").alias("gauge"), "rec", "level")


@register(sql("select row, string_agg(cast(case when nodata then 0 else gauge end as varchar), ' ' order by col) as line from cells group by row", "cells"))
def ascii_rows(spark: SparkSession, sf: str) -> DataFrame:
    """K6, K7: lines of a zone grid"""
    from tidewright.sources.grids import ascii_rows as lines

    zones = cells(spark, sf).select("row", "col", F.when(F.col("nodata"), 0).otherwise(F.col("gauge")).alias("z"))
    return lines(zones, "z", "0")


@register(sql("select gauge, count(*) as n from cells where gauge not in (select gauge from obs where rec < 24 and gauge < 4) group by gauge", "cells", "obs"))
def cells_without_series(spark: SparkSession, sf: str) -> DataFrame:
    """Cells whose gauge has no record among some"""
    known = observed(spark, sf).filter("rec < 24 and gauge < 4").select("gauge").distinct()
    return cells(spark, sf).join(known, "gauge", "left_anti").groupBy("gauge").agg(F.count("*").alias("n"))


@register(sql("select st.station_id, name, lat, lon, coalesce(kind, 'error') as record_type, coalesce(n, 0) as n_records, case when coalesce(n, 0) > 0 then row_number() over (partition by coalesce(n, 0) > 0 order by st.station_id) - 1 else -1 end as gauge_idx from st left join (select lpad(cast(gauge as varchar), 7, '0') as station_id, count(level) as n, case when count(level) * cast(100 as double) / 720 >= 80 then 'obs_6min' else 'empty' end as kind from rec group by gauge) using (station_id)", "st", "rec"))
def station_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """J7, J8, D9, O2"""
    key = F.lpad(F.col("gauge").cast("string"), 7, "0").alias("station_id")
    long = records(spark, sf).select(key, "rec", "level")
    kinds = stations.record_types(stations.coverage(long.withColumnRenamed("level", "v"), 30, 24), long.limit(0))
    return stations.manifest(kinds.select("station_id", "record_type"), long, station_table(spark, sf)).drop("gap_pct").withColumn("gauge_idx", F.coalesce("gauge_idx", F.lit(-1)))


@register(sql("select record_type, count(*) as n from (select case when count(*) * cast(100 as double) / 720 >= 95 then 'obs_6min' when gauge < 3 then 'pred_hilo' else 'empty' end as record_type from obs group by gauge) group by record_type", "obs"))
def record_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A14"""
    obs = observed(spark, sf).select(F.col("gauge").cast("string").alias("station_id"), F.col("level").alias("v"))
    predicted = spark.createDataFrame([("1",), ("2",)], "station_id string")
    return stations.record_types(stations.coverage(obs, 30, 24), predicted, 95.0).groupBy("record_type").agg(F.count("*").alias("n"))


@register(sql("select station_id from st where offset_m is null", "st"))
def stations_without_offset(spark: SparkSession, sf: str) -> DataFrame:
    """X16, U4"""
    return stations.split_usable(station_table(spark, sf))[1].select("station_id")


@register(sql("select metric, key, cell_id, value from (select 'time_integrated' as metric, 'shallow_band' as key, cell_id, case when nodata then -9999 else cast(win_shallow_band as double) end as value from cells left join m using (cell_id) union all select 'area_available', 'shallow_band', cell_id, case when nodata then 255 else cast(win_shallow_band > 0 as double) end from cells left join m using (cell_id) union all select 'refugia_time', '0.5', cell_id, case when nodata then -9999 else cast(ref_0p50 as double) end from cells left join m using (cell_id) union all select 'never_submerged', '', cell_id, case when nodata then 255 else cast(never as double) end from cells left join (select cell_id, dem - max_ws >= 0 as never from base join ext using (gauge)) using (cell_id))", "held", "base", more=f"{_MIN}, {_EXT}"))
def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    """What is written for a run"""
    from tidewright.sources.results import long_metrics

    every = cells(spark, sf)
    found = duration.inundation(every, _steps(spark, sf), WINDOWS, REFUGES, 60)
    return long_metrics(every, found, "r", ["shallow_band"], [0.5], 30).select("metric", "key", "cell_id", "value")


@register(sql("select gauge, us // 86400000000 as day, count(*) as n, min(cents) as low, max(cents) as high from ev group by all", "ev"))
def tumbling_days(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the streaming day window"""
    rows = gauge_events(spark, sf).groupBy("gauge", F.window("ts", "1 day").alias("w"))
    found = rows.agg(F.count("*").alias("n"), F.min("cents").alias("low"), F.max("cents").alias("high"))
    return found.select("gauge", F.expr(f"(unix_micros(w.start) - {EPOCH}) div 86400000000").alias("day"), "n", "low", "high")


@register(sql("select region, count(*) as n from parsed join (values ('FL', -84.5, 24.2, -79.8, 31.2), ('southeast', -82.0, 30.3, -78.5, 34.0), ('AL_nwFL', -88.6, 29.5, -84.0, 31.1)) r(region, xmin, ymin, xmax, ymax) on sw_lon < xmax and sw_lon + 0.25 > xmin and sw_lat < ymax and sw_lat + 0.25 > ymin group by region", "parsed"))
def tiles_by_region(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles and regions that overlap"""
    some = tiles.regions(spark).filter(F.col("region").isin("FL", "southeast", "AL_nwFL"))
    x, y = F.col("sw_lon"), F.col("sw_lat")
    near = (x < F.col("xmax")) & (x + 0.25 > F.col("xmin")) & (y < F.col("ymax")) & (y + 0.25 > F.col("ymin"))
    return _parsed(spark, sf).join(some, near).groupBy("region").agg(F.count("*").alias("n"))


@register(sql("select station_id, round((cast(station_id as int) % 7 - cast(station_id as int) % 5) * case when cast(station_id as int) % 2 = 0 then cast(0.3048 as double) else 1 end, 9) as offset_m from st", "st"))
def json_datums(spark: SparkSession, sf: str) -> DataFrame:
    """Published datums in JSON"""
    from tidewright.sources.remote import parse_datums

    k = F.col("station_id").cast("int")
    body = F.format_string('{"units": "%s", "datums": [{"name": "NAVD88", "value": %d}, {"name": "MLLW", "value": %d}]}', F.when(k % 2 == 0, "feet").otherwise("meters"), k % 7, k % 5)
    bodies = station_table(spark, sf).select(F.col("station_id").alias("key"), body.alias("body"))
    return parse_datums(bodies).withColumn("offset_m", F.round("offset_m", 9))


@register(sql("select station_id, t, v from (select cast(gauge as varchar) as station_id, ts as t, min(cents) as v from ev group by gauge, ts)", "ev"))
def first_by_time(spark: SparkSession, sf: str) -> DataFrame:
    """One observation a time"""
    obs = gauge_events(spark, sf).select(F.col("gauge").cast("string").alias("station_id"), F.col("ts").alias("t"), F.col("cents").cast("string").alias("v"))
    found = stations.first_by_time(obs.unionByName(obs.withColumn("v", F.lit("bad"))))
    return found.select("station_id", F.col("t").cast("timestamp_ntz").alias("t"), F.col("v").cast("long").alias("v"))


@register(sql("select cell_id, sum(win)::bigint as win, sum(ref)::bigint as ref from (select cell_id, rec // 24 as day, sum(case when dem - ws >= cast(-1.5 as double) and dem - ws <= 0 then 60 else 0 end) as win, sum(case when dem - ws < 0 and dem - ws >= cast(-0.5 as double) then 60 else 0 end) as ref from base join held using (gauge) group by cell_id, day) group by cell_id", "held", "base"))
def days_add_up(spark: SparkSession, sf: str) -> DataFrame:
    """A3: the sums of the days"""
    daily = kernel_daily(spark, sf).groupBy("cell_id")
    return daily.agg(F.sum("win_shallow_band").alias("win"), F.sum("ref_0p50").alias("ref"))
