import math
import warnings

import pytest

from tidewright.operators import duration, series
from tidewright.plans.simulation import Inputs, Run, Settings

SETS = [({"shallow": (-1.5, 0.0)}, [0.2, 0.5]), ({"shallow": (-0.3, 0.4)}, []), ({}, [0.3]), ({"dry": (0.0, 0.5)}, [])]


def ramp(spark, rows=4, columns=60, low=-6.0, high=3.0):
    cells = [(r * columns + c, r, c, low + (high - low) * c / (columns - 1), 1 + (c >= columns // 2), False) for r in range(rows) for c in range(columns)]
    return spark.createDataFrame(cells, "cell_id long, row int, col int, dem double, gauge int, nodata boolean")


def tide(spark, days=2, interval=6, amplitudes=(0.45, 0.36)):
    n = days * 1440 // interval
    rows = [(g + 1, i, a * math.sin(2 * math.pi * i * interval / 60 / 12.42)) for g, a in enumerate(amplitudes) for i in range(n)]
    return spark.createDataFrame(rows, "gauge int, rec int, level double")


def table(df, columns):
    return {r["cell_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize(("windows", "thresholds"), SETS)
def test_plans_and_pruning_match_every_cell_and_step(spark, windows, thresholds):
    cells, levels = ramp(spark), tide(spark)
    steps = series.resample(levels, 6, 6)
    beds = {r["cell_id"]: (r["dem"], r["gauge"]) for r in cells.collect()}
    surface = {g: [r["level"] for r in levels.filter(f"gauge = {g}").orderBy("rec").collect()] for g in (1, 2)}
    tests = [lambda d, lo=lo, hi=hi: lo <= d <= hi for lo, hi in windows.values()] + [lambda d, t=t: -t <= d < 0 for t in thresholds]
    want = {i: tuple(6 * sum(test(dem - ws) for ws in surface[g]) for test in tests) for i, (dem, g) in beds.items()}
    names = list(duration.metric_columns(windows, thresholds))
    for plan in ("naive", "levels", "search"):
        for pruned in (True, False):
            got = duration.inundation(cells.repartition(3), steps, windows, thresholds, 6, plan=plan, pruned=pruned)
            assert table(got, names) == want, (plan, pruned)


def test_single_cells(spark):
    beds = spark.createDataFrame([(0, 0, 0, -0.3, 1, False), (1, 0, 1, 0.4, 1, False), (2, 0, 2, 0.0, 1, True), (3, 0, 3, 0.0, 0, False)], "cell_id long, row int, col int, dem double, gauge int, nodata boolean")
    flat = spark.createDataFrame([(1, i, 0.0) for i in range(240)], "gauge int, rec int, level double")
    got = table(duration.inundation(beds, series.resample(flat, 6, 6), {"b": (-1.5, 0.0)}, [0.5, 0.2], 6), ["win_b", "ref_0p50", "ref_0p20", "never_submerged"])
    assert got == {0: (1440, 1440, 0, False), 1: (0, 0, 0, True)}


def test_days_add_up_and_daylight(spark):
    cells, levels = ramp(spark, 1, 30, -1, 1), tide(spark)
    light = spark.createDataFrame([(0, 360, 1080), (1, 360, 1080)], "day int, sunrise int, sunset int")
    settings = dict(windows={"b": (-1.5, 0.0)}, thresholds=[0.5], timestep=6)
    run = Run(Inputs(cells, levels, 6), Settings(**settings))
    whole = table(run.minutes, ["win_b", "ref_0p50"])
    parts = {}
    for r in run.daily().collect():
        parts[r["cell_id"]] = tuple(a + b for a, b in zip(parts.get(r["cell_id"], (0, 0)), (r["win_b"], r["ref_0p50"]), strict=True))
    assert all(parts.get(i, (0, 0)) == v for i, v in whole.items())
    closed = table(Run(Inputs(cells, levels, 6), Settings(**settings, daylight=light)).minutes, ["win_b"])
    opened = table(Run(Inputs(cells, levels, 6), Settings(**settings, daylight=light, daylight_bounds="exclusive")).minutes, ["win_b"])
    assert max(v[0] for v in closed.values()) == 2 * 726
    assert all(0 <= closed[i][0] - opened[i][0] <= 2 * 2 * 6 for i in closed)


def test_gaps_count_for_nothing(spark):
    beds = ramp(spark, 1, 4, -1, -0.5)
    levels = spark.createDataFrame([(g, i, None if i < 120 else 0.0) for g in (1, 2) for i in range(240)], "gauge int, rec int, level double")
    steps = series.surface(series.resample(levels, 6, 6), "direct", "nan")
    for plan in ("naive", "levels", "search"):
        got = table(duration.inundation(beds, steps, {"b": (-1.5, 0.0)}, [], 6, plan=plan), ["win_b"])
        assert set(got.values()) == {(720,)}


def test_errors_and_warning(spark):
    beds, levels = ramp(spark, 1, 4), tide(spark, amplitudes=(0.4,))
    with pytest.raises(ValueError, match="without a series"):
        Run(Inputs(beds, levels, 6), Settings({"b": (-1.0, 0.0)}, timestep=6))
    for bad in ({"timestep": 7}, {"method": "cubic"}, {"thresholds": [-1.0]}):
        with pytest.raises(ValueError):
            Settings({"b": (-1.0, 0.0)}, **bad)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        Settings({"dry": (0.0, 1.0)})
    assert seen
    short = levels.filter("rec < 100")
    with pytest.raises(ValueError, match="whole day"):
        Run(Inputs(beds.filter("gauge = 1"), short, 6), Settings({"b": (-1.0, 0.0)}, timestep=6))


def test_summary_and_counters(spark):
    run = Run(Inputs(ramp(spark, 1, 60), tide(spark), 6), Settings({"b": (-1.5, 0.0)}, [0.5], 6), "r", 900.0, {"site": "x", "value": "no"})
    rows = {(r["metric"], r["window_or_threshold"]): r for r in run.summary().collect()}
    minutes = run.minutes.collect()
    assert rows["area_available", "b"]["value"] == pytest.approx(0.09 * sum(r["win_b"] > 0 for r in minutes))
    assert rows["time_integrated", "b"]["value"] == pytest.approx(0.09 * sum(r["win_b"] for r in minutes) / 60)
    assert rows["refugia_time", "0.5"]["site"] == "x"
    c = run.counters().first()
    assert c["cells"] == 60 and c["base"] == c["active"] + c["pruned"] and c["never_submerged"] == sum(r["never_submerged"] for r in minutes)
