import math
import time

import pytest
from pyspark.sql import functions as F

from tidewright.operators import stations, tiles
from tidewright.sources import grids, remote, results, tables


def levels_csv(path, days=2, header=True, gap=False, extra=0, shift=False):
    rows = ["time,8723970,8724580"] if header else []
    for i in range(days * 240 + extra):
        a = 0.45 * math.sin(2 * math.pi * i / 10 / 12.42)
        minute = i * 6 + (3 if shift and i == 5 else 0)
        t = f"2025-01-{1 + minute // 1440:02d} {minute % 1440 // 60:02d}:{minute % 60:02d}:00"
        hole = gap and 10 <= i < 15
        rows.append(f"{t},{'' if hole else repr(a)},{'x' if hole else repr(0.8 * a)}" if header else f"{a!r},{0.8 * a!r}")
    path.write_text("\n".join(rows))
    return str(path)


def test_read_series(spark, tmp_path):
    data = tables.read_series(spark, levels_csv(tmp_path / "a.csv", extra=7))
    assert (data.interval, data.station_ids, data.n_records, data.days, data.filled) == (6, ["8723970", "8724580"], 480, 2, 0)
    assert data.records.count() == 960
    turned = tables.read_series(spark, levels_csv(tmp_path / "b.csv"), order=["8724580"], scale=2.0, offsets={"8724580": 1.0})
    first = {r["rec"]: r["level"] for r in turned.records.collect()}
    assert turned.station_ids == ["8724580"] and first[10] == pytest.approx(1 + 2 * 0.8 * 0.45 * math.sin(2 * math.pi / 12.42))
    assert "1 gauges" in turned.describe()


def test_read_series_gaps(spark, tmp_path):
    path = levels_csv(tmp_path / "g.csv", gap=True)
    data = tables.read_series(spark, path)
    assert data.filled == 10 and data.records.filter("level is null").count() == 0
    assert tables.read_series(spark, path, fill="nan").records.filter("level is null").count() == 10
    with pytest.raises(tables.SeriesError, match="gap of 5"):
        tables.read_series(spark, path, max_gap=4)


def test_read_series_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="evenly"):
        tables.read_series(spark, levels_csv(tmp_path / "s.csv", shift=True))
    path = levels_csv(tmp_path / "a.csv")
    for options in ({"time_col": "when"}, {"order": ["none"]}, {"interval": 12}, {"offsets": {}}, {"fill": "zero"}):
        with pytest.raises(tables.SeriesError):
            tables.read_series(spark, path, **options)
    bare = levels_csv(tmp_path / "n.csv", header=False)
    with pytest.raises(tables.SeriesError, match="interval"):
        tables.read_series(spark, bare, time_col=None)
    assert tables.read_series(spark, bare, time_col=None, interval=6).station_ids == ["gauge_1", "gauge_2"]
    with pytest.raises(tables.SeriesError, match="header"):
        tables.has_header(["8723970", "8724580"], ["0.1", "0.2"])


def test_series_round_trip(spark, tmp_path):
    data = tables.read_series(spark, levels_csv(tmp_path / "a.csv"))
    tables.write_series(data, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    again = tables.read_series(spark, str(part))
    assert again.interval == 6 and again.records.exceptAll(data.records).isEmpty()


def test_stations_offsets_daylight(spark, tmp_path):
    (tmp_path / "s.csv").write_text("StationID,Name,Latitude,Longitude\n0012,a,24.5,-81.5\n13,b,30,-81\n")
    found = tables.read_stations(spark, str(tmp_path / "s.csv"))
    assert [(r["station_id"], r["gauge_idx"]) for r in found.orderBy("gauge_idx").collect()] == [("0012", 0), ("13", 1)]
    inside = stations.within(found, (-82.0, 24.0, -81.0, 25.0))
    assert [r[0] for r in inside.select("station_id").collect()] == ["0012"]
    with pytest.raises(ValueError):
        stations.at_least(inside, 2)
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_stations(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "o.csv").write_text("StationID,vdatum_navd88_offset_m\n0012,-0.5\n13,ERROR\n")
    manual = tables.read_offsets(spark, str(tmp_path / "o.csv"))
    assert manual.collect() == [("0012", -0.5)]
    assert tables.read_offsets(spark, str(tmp_path / "none.csv")).isEmpty()
    resolved = stations.cascade(found, [("manual", manual)])
    with pytest.raises(ValueError, match="13"):
        stations.require_offsets(resolved)
    filled = stations.fill_interpolated(resolved)
    assert {r["station_id"]: (r["offset_m"], r["offset_source"]) for r in filled.collect()} == {"0012": (-0.5, "manual"), "13": (-0.5, "idw")}
    (tmp_path / "d.csv").write_text("rise,set\n360,1080\n361,1079\n")
    assert tables.read_daylight(spark, str(tmp_path / "d.csv")).collect() == [(0, 360, 1080), (1, 361, 1079)]


def test_remote(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"data": [{"t": "2025-01-01 00:00", "v": "0.5"}, {"t": "2025-01-01 00:06", "v": ""}, {"t": "2025-01-01 00:00", "v": "0.5"}]}')
    (tmp_path / "stations.json").write_text('{"stations": [{"id": "1", "name": "a", "lat": 1, "lng": 2, "state": "FL"}, {"id": "2", "name": "b"}]}')
    (tmp_path / "datums.json").write_text('{"units": "feet", "datums": [{"name": "NAVD88", "value": 10}, {"name": "MLLW", "value": 9}]}')
    (tmp_path / "convert.json").write_text('{"t_z": "-0.25"}')
    url = lambda name: (tmp_path / name).as_uri()
    got = remote.fetch(spark, [("s/1", url("page.json")), ("s/2", url("none.json"))], retries=2, backoff=0)
    assert {r["key"]: r["body"] is None for r in got.collect()} == {"s/1": False, "s/2": True}
    assert [(r["station_id"], r["v"]) for r in remote.parse_series(got).collect()] == [("s", 0.5)]
    assert remote.parse_stations(remote.fetch(spark, [("k", url("stations.json"))]), "x").count() == 1
    assert remote.parse_datums(remote.fetch(spark, [("7", url("datums.json"))])).first()["offset_m"] == pytest.approx(0.3048)
    assert remote.parse_conversion(remote.fetch(spark, [("7", url("convert.json"))])).first()["offset_m"] == -0.25
    kept = str(tmp_path / "cache")
    assert remote.cached(spark, kept, [("k", url("stations.json"))]).count() == 1
    (tmp_path / "stations.json").unlink()
    assert remote.cached(spark, kept, [("k", url("stations.json"))]).count() == 1
    import datetime as dt

    spans = remote.chunks(dt.date(2025, 1, 1), dt.date(2025, 3, 5))
    assert len(spans) == 3 and spans[-1][1] == dt.date(2025, 3, 5)


def test_grids(spark, tmp_path):
    path = tmp_path / "g.asc"
    path.write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    pixels, grid = grids.read_pixels(spark, str(path))
    assert grid.transform == (5, 0, 10, 0, -5, 30) and grid.cell_area_m2() == 25
    cells = grids.cells(pixels, 3, mask=pixels.withColumn("z", (F.col("z") == 6).cast("double")))
    assert {r["cell_id"]: r["nodata"] for r in cells.collect()} == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True}
    grids.write_ascii(pixels.withColumn("z", F.col("z").cast("int")), "z", grid, str(tmp_path / "out"), -9999)
    (part,) = (tmp_path / "out").glob("part*")
    assert part.read_text().split("\n")[:8] == ["ncols 3", "nrows 2", "xllcorner 10", "yllcorner 20", "cellsize 5", "NODATA_value -9999", "1 2 3", "4 -9999 6"]
    with pytest.raises(ValueError):
        grids.write_ascii(pixels, "z", grids.Grid(3, 2, (5, 0, 0, 0, -6, 0)), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        grids.same_shape(grid, grids.Grid(2, 2))
    with pytest.raises(ValueError):
        grids.Grid(1, 1).cell_area_m2()


def test_tiles(spark):
    page = '<a href="ncei19_n25X00_w081x50_2018v1.tif">ncei19_n25X00_w081x50_2018v1.tif</a> (12.5 MB) <a href="ncei19_n25x00_w081x50_2019v1.tif">ncei19_n25x00_w081x50_2019v1.tif</a> (13 MB) <a href="other.tif">other.tif</a> (1 MB) <a href="FL/index.html">FL</a> <a href="TX/index.html">TX</a> <a href="FL/index.html">again</a>'
    pages = spark.createDataFrame([("FL", "https://x.org/t/index.html", page)], "region string, url string, html string")
    found = tiles.listed_tiles(pages)
    assert found.count() == 2 and found.first()["sw_lat"] == 24.75 and found.first()["sw_lon"] == -81.5
    assert found.first()["url"].startswith("https://x.org/t/ncei19")
    assert tiles.newest(found).select("year").collect() == [(2019,)]
    assert [r[0] for r in tiles.folders(pages).orderBy("pos").select("region").collect()] == ["FL", "TX"]
    assert tiles.tiles_in(found, (-81.25, 24.8, -81.0, 25.0)).isEmpty() and tiles.tiles_in(found, (-81.3, 24.8, -81.0, 25.0)).count() == 2
    at = spark.createDataFrame([(-81.5, 24.6), (-150.0, 60.0), (-66.0, 18.0), (0.0, 0.0)], "lon double, lat double")
    assert [r[0] for r in at.select(tiles.datum_region(F.col("lon"), F.col("lat"))).collect()] == ["contiguous", "ak", "prvi", "contiguous"]
    plane = spark.range(100).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col")).withColumn("z", F.col("row") * 2.0 + F.col("col"))
    spots = spark.createDataFrame([(1, 2.5, 3.25), (2, 9.5, 0.0), (3, 4.0, 4.0)], "tid int, r double, c double")
    assert {r["tid"]: r["z"] for r in tiles.bilinear(plane, spots).collect()} == {1: 8.25, 2: None, 3: 12.0}


def test_mosaic_of_equal_priorities(spark, tmp_path):
    from tidewright import queries

    size = lambda k: k * 7919 // 1000 % 50 + 1
    part = spark.range(0, 30000, 1, 6).select(F.col("id").alias("p_partkey"), F.expr("cast(id * 7919 div 1000 % 50 + 1 as int)").alias("p_size"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    want = {}
    for tile, k in sorted((k % 4, k) for k in range(30000) if size(k) > 5):
        want.setdefault((k // 4 % 50, k // 200 % 50), size(k))
    assert {(r["row"], r["col"]): r["dem"] for r in queries.mosaic(spark, str(tmp_path)).collect()} == want


def test_utm(spark):
    from tidewright.functions.geo import to_utm

    x, y = to_utm(F.lit(-81.0), F.lit(24.5), 17)
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert got["x"] == pytest.approx(500000, abs=1e-6) and got["y"] == pytest.approx(2709528.7, abs=60)


def test_nearest_gauge_matches_brute_force(spark):
    points = [(i, (i * 37 % 101) / 3, (i * 53 % 89) / 2) for i in range(1, 90)]
    cells = spark.range(400).select(F.col("id").alias("cell_id"), (F.col("id") % 20 * 1.7).alias("x"), F.expr("id div 20 * 2.1").cast("double").alias("y"))
    for n in (5, 89):
        sites = spark.createDataFrame(points[:n], "gauge int, x double, y double")
        for r in stations.nearest_gauge(cells, sites, F.col("x"), F.col("y")).collect():
            assert r["gauge"] == min(points[:n], key=lambda p: ((p[1] - r["x"]) ** 2 + (p[2] - r["y"]) ** 2, p[0]))[0]


def test_nearest_of_crowded_sites_far_away():
    import numpy as np

    from tidewright.operators.sites import SiteTree

    class Counted(SiteTree):
        opened = 0

        def _open(self, points, p, leaf):
            self.opened += len(p)
            return super()._open(points, p, leaf)

    r = np.random.default_rng(1)
    points = np.r_[r.random((200, 2)) * 400, np.c_[r.random(200) * 400, 70000 + r.random(200)], [[np.nan, 1]]]
    for sites in (r.random((3000, 2)) * [400, 300], r.integers(0, 40, (700, 2)).astype(float), r.random((3, 2))):
        tree = Counted(sites)
        for k in (1, 3, 20):
            i, j = tree.near(points, k)
            far = ((points[:, None] - sites) ** 2).sum(axis=2)
            want = far <= (np.sort(far, axis=1)[:, k - 1 : k] if k <= len(sites) else np.inf)
            assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == list(zip(*(x.tolist() for x in np.nonzero(want)), strict=True))
    tree = Counted(r.random((20000, 2)) * [400, 300])
    tree.near(points)
    assert tree.opened < 100 * len(points) < len(tree.members) * len(points) / 10


def test_nearest_gauge_far_from_many_sites(spark):
    # 30,000 sites at 1,200 places; the lowest gauge of a place counts.
    sites = spark.range(30000).select(F.col("id").cast("int").alias("gauge"), (F.col("id") * 37 % 400).alias("x"), (F.col("id") * 91 % 300).alias("y"))
    cells = spark.range(2000).select((F.col("id") % 50 * 7.0).alias("x"), (F.expr("id div 50") * 3.0 + 20000).alias("y")).unionAll(spark.sql("select double(null), 1d"))
    got = stations.nearest_gauge(cells, sites, F.col("x"), F.col("y")).collect()
    places = {}
    for g in range(30000):
        places.setdefault((g * 37 % 400, g * 91 % 300), g)
    assert len(got) == 2001
    for r in got[::50]:
        assert r["gauge"] == (min((((x - r["x"]) ** 2 + (y - r["y"]) ** 2, g) for (x, y), g in places.items()))[1] if r["x"] is not None else 0)


def test_nearest_gauge_of_very_many_sites_takes_no_pass_over_all(spark):
    import numpy as np
    import pandas as pd

    n = 300_000
    sites = np.random.default_rng(2).random((n, 2))
    x, y = pd.Series(np.linspace(0, 1, 2000)), pd.Series(np.full(2000, 50.0))
    start = time.monotonic()
    got = stations._nearest(np.arange(n, dtype=np.int32), sites).func(x, y)
    assert time.monotonic() - start < 15
    for at in range(0, 2000, 200):
        assert got[at] == ((sites[:, 0] - x[at]) ** 2 + (sites[:, 1] - y[at]) ** 2).argmin()


def test_offsets_of_the_k_nearest(spark):
    import random

    r = random.Random(5)
    grid = [(-82 + r.randrange(6) * 0.05, 24 + r.randrange(6) * 0.05) for _ in range(150)]
    globe = [(r.uniform(-180, 180), r.uniform(-90, 90)) for _ in range(150)] + [(180.0, 10.0), (-180.0, 10.0), (0.0, 90.0), (90.0, -90.0), (179.9, 10.0), (30.0, 80.0)]
    for places in (grid, globe):
        rows = [(f"{n:04d}", x, y, None if n % 4 == 0 else r.uniform(-1, 1)) for n, (x, y) in enumerate(places)]
        known = [t for t in rows if t[3] is not None]
        df = spark.createDataFrame([*rows, ("none", None, 1.0, None), ("nowhere", 1.0, None, 9.0)], "station_id string, lon double, lat double, offset_m double")

        def km(a, b):
            p, q = math.radians(a[2]), math.radians(b[2])
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
            return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))

        for k in (1, 3, 40, 500):
            got = {x["station_id"]: x["offset_m"] for x in stations.interpolated(df, 2.0, k).collect()}
            assert got.pop("none") is None and len(got) == len(rows) - len(known)
            for a in rows:
                if a[3] is None:
                    near = sorted((round(km(a, b), 9), b[0], b[3]) for b in known)[:k]
                    twin = near[0][0] <= 0.001
                    w = [d**-2 if d else 0 for d, *_ in near]
                    want = near[0][2] if twin else sum(x * v for x, (*_, v) in zip(w, near, strict=True)) / sum(w)
                    assert twin and got[a[0]] in {v for d, _, v in near if d <= 0.001} or abs(got[a[0]] - want) < 1e-9
        plan = stations.interpolated(df, 2.0, 3)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert stations.interpolated(df.filter("offset_m is null"), 2.0, 3).count() == 0
    assert stations.interpolated(df, 2.0, 0).count() == 0


def test_runs_stand_side_by_side(spark, tmp_path):
    from tidewright.plans.simulation import Inputs, Run, Settings

    cells, levels = grids.synthetic(spark, 6, 8, 1)
    path, sums = str(tmp_path / "m"), {}
    for run_id, t in (("one", [0.5, 1.0]), ("two", [0.2]), ("one", [0.5])):
        run = Run(Inputs(cells, levels, 6), Settings({"b": (-1.5, 0.0)}, t, 6), run_id)
        results.write_metrics(results.long_metrics(cells, run.minutes, run_id, ["b"], t, 1), path, run_id)
        sums[run_id] = run.minutes.agg({"win_b": "sum"}).first()[0]
    for run_id, t in (("one", [0.5]), ("two", [0.2])):
        assert results.has_run(spark, path, run_id, ["b"], t)
        assert results.read_metrics(spark, path, run_id, ["b"], t).agg({"win_b": "sum"}).first()[0] == sums[run_id]
    assert not results.has_run(spark, path, "one", ["b"], [1.0])
    results.write_metrics(results.long_metrics(cells, run.minutes, "bare", ["b"], [0.5], 1, False, True), path, "bare")
    assert results.has_run(spark, path, "bare", ["b"], [0.5], True, False) and not results.has_run(spark, path, "bare", ["b"], [0.5])


def test_exported_rasters_and_daily_settings(spark, tmp_path):
    from tidewright.plans.simulation import Inputs, Run, Settings

    cells, levels = grids.synthetic(spark, 6, 8, 2)
    run = Run(Inputs(cells, levels, 6), Settings({"b": (-1.5, 0.0)}, [0.5], 6), "r1")
    metrics = results.long_metrics(cells, run.minutes, "r1", ["b"], [0.5], 2)
    grid = grids.Grid(8, 6, (30.0, 0.0, 0.0, 0.0, -30.0, 180.0))
    written = results.export_rasters(metrics, grid, str(tmp_path), results.metric_names("r1", ["b"], [0.5]))
    assert len(written) == 4 and f"{tmp_path}/r1__refugia_time_min__thr_0p50.asc" in written
    back, there = grids.read_pixels(spark, f"{tmp_path}/r1__time_integrated_min__b.asc")
    assert (there.width, there.height) == (8, 6) and back.agg({"z": "sum"}).first()[0] == run.minutes.agg({"win_b": "sum"}).first()[0]
    assert results.daily_columns(["b"], [0.5], ["refugia_time__thr_0p50"]) == results.daily_columns(["b"], [0.5], ["ref_0p50"]) == ["ref_0p50"]
    results.write_daily(run.daily(), f"{tmp_path}/d", 10, ["win_b"], "int16", "deflate")
    daily = spark.read.parquet(f"{tmp_path}/d")
    assert dict(daily.dtypes) == {"cell_id": "bigint", "win_b": "smallint", "day": "int"} and {r[0] for r in daily.select("day").distinct().collect()} == {10, 11}


def test_listings(spark):
    page = """<A class=x HREF='TX/index.html'>TX</A> <a href="FL/INDEX.html">FL</a> <a href="http://x.org/old/index.html">no</a>
      <a href="./ncei19_n27X75_w097x25_2022v1.tif" >ncei19_n27X75_w097x25_2022v1.tif</a> ( 12.5 MB ) <a href="a.tif">a.tif</a> (1 MB)
      <a href="https://y.org/ncei19_n27x75_w097x25_2019v1.tif"> ncei19_n27x75_w097x25_2019v1.tif</a>\n(3MB) <a href="ncei19_n27x75_w097x50_2019v1.tif">ncei19_n27x75_w097x50_2019v1.tif</a>"""
    pages = spark.createDataFrame([("TX", "https://z.org/dem/TX/index.html", page)], "region string, url string, html string")
    assert [r["region"] for r in tiles.folders(pages).orderBy("pos").collect()] == ["TX", "FL"]
    found = {r["url"]: (r["sw_lat"], r["sw_lon"], r["year"], r["size_mb"]) for r in tiles.listed_tiles(pages).collect()}
    assert found == {"https://z.org/dem/TX/ncei19_n27X75_w097x25_2022v1.tif": (27.5, -97.25, 2022, 12.5), "https://y.org/ncei19_n27x75_w097x25_2019v1.tif": (27.5, -97.25, 2019, 3.0)}


def test_metrics_round_trip(spark, tmp_path):
    cells, levels = grids.synthetic(spark, 6, 8, 1)
    from tidewright.plans.simulation import Inputs, Run, Settings

    run = Run(Inputs(cells, levels, 6), Settings({"b": (-1.5, 0.0)}, [0.5], 6), "r1")
    path = str(tmp_path / "m")
    assert not results.has_run(spark, path, "r1", ["b"], [0.5])
    results.write_metrics(results.long_metrics(cells, run.minutes, "r1", ["b"], [0.5], 1), path, "r1")
    assert results.has_run(spark, path, "r1", ["b"], [0.5]) and not results.has_run(spark, path, "r1", ["b"], [0.5], True)
    back = results.read_metrics(spark, path, "r1", ["b"], [0.5])
    assert back.agg({"win_b": "sum"}).first()[0] == run.minutes.agg({"win_b": "sum"}).first()[0]
    names = results.metric_names("r1", ["my band"], [0.2])
    assert names["time_integrated", "my band"].endswith("my_band") and names["refugia_time", 0.2].endswith("0p20")
    with pytest.raises(ValueError):
        results.long_metrics(cells, run.minutes, "r1", ["b"], [], 1, total=False)


def test_hybrid_and_zones(spark):
    rows = lambda n, g: spark.createDataFrame([(k + 1, i, float(i)) for k in range(g) for i in range(n)], "gauge int, rec int, level double")
    both = stations.hybrid(rows(5, 2), rows(5, 2))
    assert sorted(r[0] for r in both.select("gauge").distinct().collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="length"):
        stations.hybrid(rows(5, 2), rows(4, 2))
    names = spark.createDataFrame([(0, "a"), (1, "b")], "gauge_idx int, station_id string")
    assert stations.zones_match(names, names) and not stations.zones_match(names, names.limit(1))
    with pytest.raises(ValueError, match="no place"):
        stations.with_sites(names, spark.createDataFrame([("a", 1.0, 2.0)], "station_id string, lat double, lon double"))


def test_download(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 1000)
    asked = [("t.tif", (tmp_path / "a").as_uri(), 0.001)]
    (path,) = remote.download(asked, str(tmp_path / "out"))
    (tmp_path / "a").write_bytes(b"y" * 1000)
    assert remote.download(asked, str(tmp_path / "out")) == [path] and open(path, "rb").read(1) == b"x"
    remote.download(asked, str(tmp_path / "out"), skip_existing=False)
    assert open(path, "rb").read(1) == b"y"
    with pytest.raises(OSError):
        remote.download([("u.tif", (tmp_path / "none").as_uri(), None)], str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["t.tif"]


def test_type_report(spark):
    kinds = spark.createDataFrame([("a", "empty"), ("b", "obs_6min"), ("c", "empty")], "station_id string, record_type string")
    assert stations.type_report(kinds).split() == ["empty", "2", "obs_6min", "1"]


def test_warp(spark):
    from tidewright.functions.geo import from_utm, to_utm

    at = spark.createDataFrame([(-97.005, 27.805), (-98.9, 27.0)], "lon double, lat double")
    x, y = to_utm(F.col("lon"), F.col("lat"), 14)
    lon, lat = from_utm(F.col("x"), F.col("y"), 14)
    for r in at.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r["lon"] - r["a"]) < 1e-7 and abs(r["lat"] - r["b"]) < 1e-7
    step, n = 0.0005, 20
    sources = spark.createDataFrame([(1, -97.01, 27.81, step, n, n), (2, -97.0, 27.81, step, n, n)], "priority int, west double, north double, step double, rows int, columns int")
    pixels = spark.range(2 * n * n).select((F.expr(f"id div {n * n}") + 1).cast("int").alias("priority"), F.expr(f"cast(id % {n * n} div {n} as int)").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    west = F.when(F.col("priority") == 1, -97.01).otherwise(-97.0)
    plane = lambda lon, lat: 10 * (lon + 97) + 5 * (lat - 27.8)
    pixels = pixels.withColumn("z", plane(west + (F.col("col") + 0.5) * step, 27.81 - (F.col("row") + 0.5) * step))
    corner = at.limit(1).select(*(c.alias(k) for c, k in zip(to_utm(F.lit(-97.009), F.lit(27.809), 14), "xy", strict=True))).first()
    got = tiles.warp(spark, pixels, sources, corner["x"], corner["y"], 40, 25, 30.0, 14)
    lon, lat = from_utm(F.lit(corner["x"]) + (F.col("col") + 0.5) * 30, F.lit(corner["y"]) - (F.col("row") + 0.5) * 30, 14)
    rows = got.withColumns({"want": plane(lon, lat)}).collect()
    assert len(rows) == 1000 and sum(r["dem"] is not None for r in rows) > 950
    assert max(abs(r["dem"] - r["want"]) for r in rows if r["dem"] is not None) < 5e-3


def test_zones(spark, tmp_path):
    from tidewright.functions.geo import to_utm
    from tidewright.plans import zones

    table = spark.createDataFrame([(0, "a", -81.0, 24.5), (1, "b", -80.99, 24.5)], "gauge_idx int, station_id string, lon double, lat double")
    x, y = to_utm(F.lit(-81.0), F.lit(24.5), 17)
    at = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    grid = grids.Grid(40, 2, (30.0, 0.0, at["x"], 0.0, -30.0, at["y"] + 30))
    cells = spark.range(80).select(F.col("id").alias("cell_id"), F.expr("cast(id div 40 as int)").alias("row"), (F.col("id") % 40).cast("int").alias("col"), (F.col("id") == 0).alias("nodata"))
    drawn = zones.draw_zones(cells, grid, table, "EPSG:32617")
    found = {r["cell_id"]: r["gauge"] for r in drawn.collect()}
    assert found[0] == 0 and found[1] == 1 and found[39] == 2
    path = str(tmp_path / "z")
    assert not zones.zones_current(spark, path, table)
    zones.write_zones(drawn, table, path, grid)
    assert zones.zones_current(spark, path, table) and not zones.zones_current(spark, path, table.limit(1))
    assert grids.read_pixels(spark, path)[1].width == 40
    with pytest.raises(ValueError):
        zones.draw_zones(cells, grid, table, "EPSG:3857")
