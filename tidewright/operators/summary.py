"""Domain summaries in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.levels import threshold_slug_of

CORE = ("run_id", "metric", "window_or_threshold", "value", "units")


def totals(minutes: DataFrame, windows: list[str], thresholds: list[float], cell_area_m2: float) -> DataFrame:
    """One row: for each test, minutes summed up as hectare-hours, and for each window its area in hectares."""
    ha = cell_area_m2 / 1e4
    out = []
    for w in windows:
        out += [(F.count_if(F.col(f"win_{w}") > 0) * F.lit(ha)).alias(f"area_{w}"), (F.coalesce(F.sum(f"win_{w}"), F.lit(0)) * F.lit(ha) / 60).alias(f"hours_{w}")]
    for t in thresholds:
        s = threshold_slug_of(t)
        out.append((F.coalesce(F.sum(f"ref_{s}"), F.lit(0)) * F.lit(ha) / 60).alias(f"refuge_{s}"))
    return minutes.agg(*out)


def long_form(totals_row: DataFrame, run_id: str, windows: list[str], thresholds: list[float], metadata: dict[str, str] | None = None) -> DataFrame:
    """(run_id, metric, window_or_threshold, value, units) and a column for each metadata key that is none of these."""
    parts = [("area_available", w, f"area_{w}", "ha") for w in windows]
    parts += [("time_integrated", w, f"hours_{w}", "ha_hours") for w in windows]
    parts += [("refugia_time", f"{t:g}", f"refuge_{threshold_slug_of(t)}", "ha_hours") for t in thresholds]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("window_or_threshold"), F.col(c).cast("double").alias("value"), F.lit(u).alias("units")) for m, k, c, u in parts])).alias("x")
    extra = [F.lit(str(v)).alias(k) for k, v in (metadata or {}).items() if k not in CORE]
    return totals_row.select(rows).select(F.lit(run_id).alias("run_id"), "x.*", *extra)


def table(*runs: DataFrame) -> DataFrame:
    """Several runs' summaries in one table; a column that only some have is null for the others."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run, allowMissingColumns=True)
    return out


def run_counters(cells: DataFrame, active: DataFrame) -> DataFrame:
    """Cells by what becomes of them."""
    used = active.agg(F.count("*").alias("base"), F.count_if("active").alias("active"), F.count_if("never_submerged").alias("never_submerged"))
    every = cells.agg(F.count("*").alias("cells"))
    return used.select(every.scalar().alias("cells"), "base", "active", (F.col("base") - F.col("active")).alias("pruned"), "never_submerged")
