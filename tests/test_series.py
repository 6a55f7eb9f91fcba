import math

import pytest
from pyspark.sql import functions as F

from tidewright.operators import hilo, series


def records(spark, levels, gauge=1):
    return spark.createDataFrame([(gauge, i, None if x is None else float(x)) for i, x in enumerate(levels)], "gauge int, rec int, level double")


def values(df, order, value):
    return [r[0] for r in df.orderBy("gauge", order).select(value).collect()]


def expected(levels, ri, ts, method):
    """A plain statement of the resampling rules."""
    n, out = len(levels), []
    for j in range(n * ri // ts):
        if ts == ri:
            out.append(levels[j])
            continue
        t = j * ts
        if t > (n - 1) * ri:
            out.append(levels[-1])
            continue
        i = min(t // ri, n - 1) if method == "hold" else max(0, min(t // ri, n - 2))
        if method == "hold":
            out.append(levels[i])
            continue
        a, b, f = levels[i], levels[i + 1], (t - i * ri) / ri
        if t == (n - 1) * ri:
            out.append(levels[-1])
            continue
        if a is None or b is None:
            out.append(None)
        else:
            out.append(a + f * (b - a) if method == "linear" else 0.5 * (a + b) + 0.5 * (b - a) * math.sin(math.pi * (f - 0.5)))
    return out


@pytest.mark.parametrize("method", series.METHODS)
@pytest.mark.parametrize(("ri", "ts"), [(6, 1), (6, 30), (6, 10), (60, 6), (360, 1), (30, 20), (60, 60)])
def test_resample_follows_the_rules(spark, method, ri, ts):
    levels = [None if i % 10 == 3 else math.sin(i) for i in range(24)]
    got = values(series.resample(records(spark, levels), ri, ts, method), "step", "ws")
    want = expected(levels, ri, ts, method)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None)
        assert g is None or abs(g - w) < 1e-12


def test_sine_passes_records_and_middle(spark):
    got = values(series.resample(records(spark, [0, 1, 0]), 360, 1, "sinusoidal"), "step", "ws")
    assert len(got) == 1080 and got[0] == 0 and abs(got[180] - 0.5) < 1e-12 and abs(got[360] - 1) < 1e-12
    assert got[1] - got[0] < got[180] - got[179]


def test_gap_rules(spark):
    gaps = [None, 1, None, None, 4, None]
    assert values(series.hold_gaps(records(spark, gaps)), "rec", "level") == [1, 1, 1, 1, 4, 4]
    assert values(series.bridge_gaps(records(spark, gaps)), "rec", "level") == [1, 1, 2, 3, 4, 4]
    assert values(series.fill_gaps(records(spark, gaps), "nan"), "rec", "level") == gaps
    assert values(series.hold_gaps(records(spark, [None, None])), "rec", "level") == [None, None]


def test_incremental_surface(spark):
    rows = records(spark, [1, None, None, 4, 4.5, None, 5]).withColumnsRenamed({"rec": "step", "level": "ws"})
    assert values(series.surface(rows, "incremental", "nan"), "step", "ws") == [1, 1, 1, 1, 1.5, 1.5, 1.5]
    direct, grown = (values(series.surface(rows, mode, "hold"), "step", "ws") for mode in series.MODES)
    assert direct == grown
    start = records(spark, [None, 2, 3]).withColumnsRenamed({"rec": "step", "level": "ws"})
    assert values(series.surface(start, "incremental", "nan"), "step", "ws") == [None] * 3


def test_longest_gap_counts_any_gauge(spark):
    both = records(spark, [1, None, None, 2]).union(records(spark, [1, 1, 1, None], 2))
    assert series.longest_gap(both).first()[0] == 3
    assert series.longest_gap(records(spark, [1, 2])).first()[0] == 0


def test_spacing(spark):
    times = spark.createDataFrame([(i * 6 + (3 if i == 5 else 0),) for i in range(10)], "m int").select(F.timestamp_seconds(F.col("m") * 60).alias("t"))
    with pytest.raises(ValueError, match="evenly"):
        series.regular_interval(times)
    even = spark.range(10).select(F.timestamp_seconds(F.col("id") * 360).alias("t"))
    assert series.regular_interval(even) == 6


def test_harmonic_recovers_an_amplitude(spark):
    w = 2 * math.pi / 12.4206012
    rows = records(spark, [0.3 * math.cos(w * i) - 0.2 * math.sin(w * i) for i in range(200)])
    c, s = series.harmonic(rows, 60).select("c", "s").first()
    assert abs(c - 0.3) < 1e-9 and abs(s + 0.2) < 1e-9
    more = series.scale_harmonic(rows, 50.0, 60)
    c, s = series.harmonic(more, 60).select("c", "s").first()
    assert abs(c - 0.45) < 1e-9 and abs(s + 0.3) < 1e-9
    assert series.scale_harmonic(rows, 0, 60) is rows


def test_hilo_series(spark):
    events = spark.createDataFrame([(1, 10, 0.0), (1, 20, 1.0), (1, 20, 1.0), (1, 40, -1.0)], "gauge int, t_min int, level double")
    got = values(hilo.minute_series(hilo.rising_events(events), 60), "minute", "level")
    assert got[:10] == [0.0] * 10 and abs(got[15] - 0.5) < 1e-12 and abs(got[30]) < 1e-12 and got[40:] == [-1.0] * 20
    padded = values(hilo.padded_series(events, 60), "minute", "level")
    assert padded[0] == 0.0 and padded[59] == -1.0
    single = spark.createDataFrame([(1, 10, 0.0)], "gauge int, t_min int, level double")
    assert values(hilo.padded_series(single, 5), "minute", "level") == [None] * 5
