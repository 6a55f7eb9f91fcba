"""The kernel: minutes that each cell spends in depth windows and refuges.

Three plans give the same result, as all test `dem - ws` on the same doubles:

naive    cells joined with every step of their gauge, for comparison;
levels   cells joined with the distinct levels of their gauge and their numbers of steps: all cells of
         a gauge share a series, so only the multiset of levels matters;
search   each gauge's levels sorted once; rounding of `dem - ws` is monotone in ws, so the levels
         that satisfy a test are one stretch, found by binary search. Cells cost a logarithm of the
         steps, not the steps, and are not shuffled at all.

search needs the levels at every task: at most SEARCH_BYTES, which is checked; beyond, or for few
levels, levels is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.levels import area_flag, clean, day_average, depth, in_daylight, in_refuge, in_window, threshold_slug_of

#: Levels (and counts) sent with every task of a search.
SEARCH_BYTES = 64 << 20
#: Up to so many distinct levels a gauge the join with levels is used.
FEW_LEVELS = 64
#: Rows of the levels side that may be broadcast: 24 bytes each.
BROADCAST_ROWS = 500_000

Windows = dict[str, tuple[float, float]]


def metric_columns(windows: Windows, thresholds: list[float]) -> dict[str, Column]:
    """Tests on the column `d`, by name: win_<name> and ref_<threshold>."""
    tests = {f"win_{name}": in_window(F.col("d"), lo, hi) for name, (lo, hi) in windows.items()}
    return tests | {f"ref_{threshold_slug_of(t)}": in_refuge(F.col("d"), t) for t in thresholds}


def lit_steps(series: DataFrame, timestep: int, daylight: DataFrame | None = None, exclusive: bool = False) -> DataFrame:
    """(gauge, day, ws) of whole days; with a daylight table only steps that end in daylight."""
    per_day = 1440 // timestep
    n_days = series.agg(F.expr(f"(max(step) + 1) div {per_day}").alias("n_days")).scalar()
    minute = ((F.col("step") % per_day + 1) * timestep).cast("int")
    rows = series.select("gauge", F.expr(f"cast(step div {per_day} as int)").alias("day"), minute.alias("minute"), clean(F.col("ws")).alias("ws"))
    rows = rows.filter((F.col("day") < n_days) & F.col("ws").isNotNull())
    if daylight is not None:
        days = daylight.select(F.col("day").cast("int").alias("day"), "sunrise", "sunset")
        rows = rows.join(F.broadcast(days), "day").filter(in_daylight(F.col("minute"), F.col("sunrise"), F.col("sunset"), exclusive))
    return rows.select("gauge", "day", "ws")


def usable(cells: DataFrame) -> DataFrame:
    """Cells with a bed and a gauge."""
    return cells.filter(~F.col("nodata") & F.col("dem").isNotNull() & ~F.isnan("dem") & (F.col("gauge") > 0))


def check_gauges(cells: DataFrame, series: DataFrame) -> None:
    """Every zone must have a series, whether or not its cells are used."""
    missing = cells.filter("gauge > 0").select("gauge").distinct().join(series.select("gauge").distinct(), "gauge", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"cells refer to gauges without a series: {sorted(r[0] for r in missing)}")


def prune(cells: DataFrame, extremes: DataFrame, windows: Windows, thresholds: list[float]) -> DataFrame:
    """Adds `active`, false where no step can satisfy a test, and `never_submerged`. extremes has all steps.

    Too deep: even the lowest level leaves more water than any test allows. Too dry: even the highest
    level leaves the bed above every window and dry.
    """
    deepest = max([0.0, *(-lo for lo, _ in windows.values()), *thresholds])
    joined = cells.join(F.broadcast(extremes), "gauge", "left")
    driest = F.col("dem") - F.col("max_ws")
    too_deep = F.col("dem") < F.col("min_ws") - F.lit(deepest)
    too_dry = F.lit(True)
    if windows:
        too_dry = too_dry & (driest > F.lit(max(hi for _, hi in windows.values())))
    if thresholds:
        too_dry = too_dry & (driest >= 0)
    active = F.coalesce(~too_deep & ~too_dry, F.lit(False))
    return joined.select(*cells.columns, active.alias("active"), F.coalesce(driest >= 0, F.lit(False)).alias("never_submerged"))


def histogram(steps: DataFrame, by_day: bool = False) -> DataFrame:
    """(gauge[, day], ws, n): distinct levels with their numbers of steps."""
    return steps.groupBy("gauge", *(["day"] if by_day else []), "ws").agg(F.count("*").alias("n"))


def _sums(joined: DataFrame, keys: list[str], tests: dict[str, Column], timestep: int) -> DataFrame:
    minutes = [F.sum(F.when(test, F.col("n") * F.lit(timestep)).otherwise(F.lit(0))).cast("long").alias(name) for name, test in tests.items()]
    return joined.withColumn("d", depth(F.col("dem"), F.col("ws"))).groupBy(*keys).agg(*minutes)


def minutes_naive(cells: DataFrame, steps: DataFrame, windows: Windows, thresholds: list[float], timestep: int, by_day: bool = False) -> DataFrame:
    joined = cells.select("cell_id", "dem", "gauge").join(steps.withColumn("n", F.lit(1)), "gauge")
    return _sums(joined, ["cell_id", *(["day"] if by_day else [])], metric_columns(windows, thresholds), timestep)


def minutes_levels(cells: DataFrame, hist: DataFrame, windows: Windows, thresholds: list[float], timestep: int, by_day: bool = False, n_rows: int | None = None) -> DataFrame:
    """Cells of equal bed and gauge are one row until their minutes are known."""
    n_rows = hist.count() if n_rows is None else n_rows
    side = F.broadcast(hist) if n_rows <= BROADCAST_ROWS else hist
    keys = ["gauge", "dem", *(["day"] if by_day else [])]
    beds = cells.select("gauge", "dem").distinct().join(side, "gauge")
    found = _sums(beds, keys, metric_columns(windows, thresholds), timestep)
    return cells.select("cell_id", "gauge", "dem").join(found, ["gauge", "dem"]).drop("gauge", "dem")


def _stretch(dem: np.ndarray, ws: np.ndarray, low: float, high: float, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last place in sorted ws of low <= dem - ws <= high (< high if strict), by the test itself."""
    under = (lambda d: d < high) if strict else (lambda d: d <= high)
    begin, end = np.searchsorted(ws, dem - high), np.searchsorted(ws, dem - low, side="right")
    n = len(ws)
    for place, test in ((begin, under), (end, lambda d: ~(d >= low))):
        while True:  # a guess is off by rounding at most, so this ends after a step or two of equal levels
            back = (place > 0) & test(dem - ws[np.maximum(place - 1, 0)])
            on = ~back & (place < n) & ~test(dem - ws[np.minimum(place, n - 1)])
            if not (back.any() or on.any()):
                break
            place -= back
            place += on
    return begin, np.maximum(begin, end)


def _sorted_levels(hist: DataFrame, by_day: bool, timestep: int) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By gauge and day: levels in order, and the minutes below each."""
    rows = hist.orderBy("gauge", *(["day"] if by_day else []), "ws").toArrow()
    gauge, ws, n = (rows[c].to_numpy() for c in ("gauge", "ws", "n"))
    day = rows["day"].to_numpy() if by_day else np.zeros(len(gauge), np.int32)
    cuts = np.flatnonzero(np.r_[True, (gauge[1:] != gauge[:-1]) | (day[1:] != day[:-1])]) if len(gauge) else np.array([], int)
    table: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for a, b in zip(cuts, np.r_[cuts[1:], len(gauge)].astype(int), strict=True):
        table.setdefault(int(gauge[a]), {})[int(day[a])] = ws[a:b].copy(), np.r_[0, np.cumsum(n[a:b])] * timestep
    return table


def _bands(windows: Windows, thresholds: list[float]) -> list[tuple[float, float, bool]]:
    return [(lo, hi, False) for lo, hi in windows.values()] + [(-t, 0.0, True) for t in thresholds]


def minutes_search(cells: DataFrame, hist: DataFrame, windows: Windows, thresholds: list[float], timestep: int, by_day: bool = False) -> DataFrame:
    """hist is collected; the caller has checked its size."""
    table, bands = _sorted_levels(hist, by_day, timestep), _bands(windows, thresholds)
    names = list(metric_columns(windows, thresholds))
    schema = "cell_id long" + ", day int" * by_day + "".join(f", `{x}` long" for x in names)
    columns = ["cell_id", *(["day"] if by_day else []), *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dems, gauges = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for g in np.unique(gauges):
                at = np.flatnonzero(gauges == g)
                dem, cell = dems[at], pa.array(ids[at].astype(np.int64))
                for d, (levels, total) in table.get(int(g), {}).items():
                    out = []
                    for low, high, strict in bands:
                        begin, end = _stretch(dem, levels, low, high, strict)
                        out.append(pa.array((total[end] - total[begin]).astype(np.int64)))
                    days = [pa.array(np.full(len(at), d, np.int32))] if by_day else []
                    yield pa.RecordBatch.from_arrays([cell, *days, *out], names=columns)

    return cells.select(F.col("cell_id").cast("long").alias("cell_id"), "dem", F.col("gauge").cast("int").alias("gauge")).mapInArrow(run, schema)


def _search_in_place(flagged: DataFrame, hist: DataFrame, windows: Windows, thresholds: list[float], timestep: int) -> DataFrame:
    """Cells as they come, each with its minutes: no cell is joined or moved. Cells that are not active get 0."""
    table, bands = _sorted_levels(hist, False, timestep), _bands(windows, thresholds)
    rows = flagged.select("cell_id", "gauge", "dem", "never_submerged", "active")
    schema = rows.drop("active").schema
    for name in metric_columns(windows, thresholds):
        schema = schema.add(name, "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gauges, dems, active = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 4))
            out = np.zeros((len(bands), batch.num_rows), np.int64)
            for g in np.unique(gauges):
                at = np.flatnonzero((gauges == g) & active)
                for levels, total in table.get(int(g), {}).values():
                    for k, (low, high, strict) in enumerate(bands):
                        begin, end = _stretch(dems[at], levels, low, high, strict)
                        out[k, at] = total[end] - total[begin]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, out)], names=names)

    return rows.mapInArrow(run, schema)


def choose(hist: DataFrame, keys: list[str], plan: str) -> tuple[str, int]:
    """The plan to take, and the number of levels."""
    n = hist.count()
    if plan == "auto":
        groups = max(1, hist.select(*keys).distinct().count())
        plan = "search" if n > FEW_LEVELS * groups and n * 24 <= SEARCH_BYTES else "levels"
    if plan == "search" and n * 24 > SEARCH_BYTES:
        raise ValueError(f"{n} levels are too many to send with every task; use the levels plan")
    return plan, n


def minutes(cells: DataFrame, steps: DataFrame, windows: Windows, thresholds: list[float], timestep: int, by_day: bool = False, plan: str = "auto") -> DataFrame:
    """(cell_id[, day], minutes by test) of usable cells. Without steps (all gaps) a cell has no row."""
    if plan == "naive":
        return minutes_naive(cells, steps, windows, thresholds, timestep, by_day)
    hist = histogram(steps, by_day).persist()
    plan, n = choose(hist, ["gauge", *(["day"] if by_day else [])], plan)
    if plan == "search":
        out = minutes_search(cells, hist, windows, thresholds, timestep, by_day)
        hist.unpersist()
        return out
    return minutes_levels(cells, hist, windows, thresholds, timestep, by_day, n)


def inundation(cells: DataFrame, series: DataFrame, windows: Windows, thresholds: list[float], timestep: int, daylight: DataFrame | None = None, exclusive: bool = False, by_day: bool = False, plan: str = "auto", pruned: bool = True) -> DataFrame:
    """Minutes of every usable cell; cells that no step can satisfy are 0 without being looked at. By day, those have no rows.

    With search, cells flow through as they are read. With levels, distinct beds are worked out and
    joined back to the cells, which is the one join of the grid. The series, a row a gauge and step, is
    read several times and is kept in memory, as the histogram is, until the session's cache is cleared.
    """
    from tidewright.operators.series import extremes

    if not (series.storageLevel.useMemory or series.storageLevel.useDisk):
        series = series.persist()
    steps = lit_steps(series, timestep, daylight, exclusive)
    flagged = prune(usable(cells), extremes(series), windows, thresholds)
    if not pruned:
        flagged = flagged.withColumn("active", F.lit(True))
    active = flagged.filter("active")
    if by_day:
        return minutes(active, steps, windows, thresholds, timestep, True, plan)
    names, keys = list(metric_columns(windows, thresholds)), ["cell_id"]
    if plan == "naive":
        found = minutes_naive(active, steps, windows, thresholds, timestep)
    else:
        hist = histogram(steps).persist()
        plan, n = choose(hist, ["gauge"], plan)
        if plan == "search":
            out = _search_in_place(flagged, hist, windows, thresholds, timestep)
            hist.unpersist()
            return out
        side, keys = F.broadcast(hist) if n <= BROADCAST_ROWS else hist, ["gauge", "dem"]
        found = _sums(active.select(*keys).distinct().join(side, "gauge"), keys, metric_columns(windows, thresholds), timestep)
    zero = [F.when(F.col("active"), F.coalesce(n, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias(n) for n in names]
    return flagged.join(found, keys, "left").select("cell_id", "gauge", "dem", "never_submerged", *zero)


def rasters(result: DataFrame, names: list[str], n_days: int, average: bool = True, total: bool = True) -> DataFrame:
    """Per cell: totals, day averages and flags of area."""
    if not (average or total):
        raise ValueError("neither totals nor averages are asked for")
    out = [F.col("cell_id")]
    for n in names:
        out += [F.col(n)] * total + [day_average(F.col(n), n_days).alias(f"{n}_per_day")] * average
        out += [area_flag(F.col(n)).alias(f"{n}_area")] * n.startswith("win_")
    return result.select(*out)
