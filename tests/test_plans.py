import json
import math
import warnings

import pytest

from tidewright.functions import geo
from tidewright.plans import cli
from tidewright.plans.config import ConfigError, RunConfig
from tidewright.plans.domain import Domain, DomainError, target_crs
from tidewright.plans.estimate import auto_chunk, estimate, readable


def raw(**more):
    base = {
        "domain": {"name": "keys", "bbox": [-81.95, 24.45, -80.95, 24.83], "resolution_m": 30},
        "gauges": {"source": "prescribed", "prescribed_file": "levels.csv"},
        "simulation": {"timestep_min": 6},
        "depth_windows": {"shallow_band": [-1.5, 0.0]},
        "refugia_thresholds": [0.2, 0.5],
    }
    for k, v in more.items():
        base[k] = {**base[k], **v} if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return base


def test_config_parses_and_reports():
    c = RunConfig.from_dict(raw(figures={}))
    assert c.windows == {"shallow_band": (-1.5, 0.0)} and c.thresholds == [0.2, 0.5] and c.unknown == ["figures"]
    assert "shallow_band" in c.report()
    nested = raw(depth_windows={"refugia_thresholds": [1.0]})
    del nested["refugia_thresholds"]
    assert RunConfig.from_dict(nested).thresholds == [1.0]
    old = RunConfig.from_dict(raw(simulation={"daylight_bounds_exclusive": True, "cell_chunk": "5000"}))
    assert old.simulation.daylight_bounds == "exclusive" and old.simulation.cell_chunk == 5000


@pytest.mark.parametrize(
    "change",
    [
        {"simulation": {"timestep_min": 7}},
        {"simulation": {"gauge_interp": "cubic"}},
        {"gauges": {"source": "other"}},
        {"gauges": {"prescribed_file": None}},
        {"gauges": {"time_col": None}},
        {"gauges": {"source": "coops"}},
        {"gauges": {"source": "coops", "year": 2025, "start": "2024-01-01"}},
        {"gauges": {"source": "coops", "year": 2025, "start": "2025-03-01", "end": "2025-02-01"}},
        {"gauges": {"source": "hybrid", "year": 2025}},
        {"refugia_thresholds": [-0.2]},
        {"depth_windows": {"shallow_band": [1, 0]}},
        {"depth_windows": {"shallow_band": [1]}},
        {"output": {"write_total": False}},
    ],
)
def test_config_rejects(change):
    with pytest.raises(ConfigError):
        RunConfig.from_dict(raw(**change))


def test_no_metric_and_no_domain():
    bare = raw(refugia_thresholds=[])
    bare["depth_windows"] = {}
    with pytest.raises(ConfigError):
        RunConfig.from_dict(bare)
    with pytest.raises(ConfigError):
        RunConfig.from_dict({})


def test_yaml_and_dates(tmp_path):
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump(raw(gauges={"source": "coops", "year": 2024})))
    c = RunConfig.from_yaml(path)
    assert c.n_days() == 366 and c.path == str(path)
    with pytest.raises(ConfigError):
        RunConfig.from_yaml(tmp_path / "none.yaml")


def test_domains(tmp_path):
    round_one = Domain.from_dict({"center": [-97.1, 27.75], "radius_km": 15, "shape": "circle"})
    assert len(round_one.ring) == 129 and round_one.ring[0] == round_one.ring[-1] and round_one.utm == "EPSG:32614"
    grown = round_one.buffered(10)
    assert grown[0] < round_one.bbox[0] and round_one.buffered(0) == round_one.bbox
    edge = tmp_path / "a.geojson"
    edge.write_text(json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [1, 3], [0, 0]]]}}))
    assert Domain.from_dict({"boundary_file": str(edge)}).bbox == (0, 0, 2, 3)
    for bad in ({}, {"bbox": [0, 0, 1, 1], "center": [0, 0]}, {"center": [0, 0]}, {"center": [0], "radius_km": 1}, {"center": [0, 0], "radius_km": 1, "shape": "star"}, {"bbox": [1, 0, 0, 1]}, {"bbox": [0, 0, 200, 1]}, {"boundary_file": "none.geojson"}):
        with pytest.raises(DomainError):
            Domain.from_dict(bad)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert target_crs(Domain.from_dict({"bbox": [-100, 20, -80, 21]})) == "EPSG:32616"
    assert seen


def test_geo_numbers():
    assert [geo.utm_of(*p) for p in ((-81.5, 24.6), (-122.4, 37.8), (151.2, -33.9))] == ["EPSG:32617", "EPSG:32610", "EPSG:32756"]
    rows, columns = geo.grid_shape(geo.bbox_around(-97.1, 27.75, 15), 30)
    assert 0.9e6 < rows * columns < 1.15e6
    assert geo.snapped_grid(1, 1, 59, 61, 30) == (0, 90, 2, 3)


def test_estimates():
    assert auto_chunk(256, 240) == 6 * auto_chunk(256, 1440) or abs(auto_chunk(256, 240) / auto_chunk(256, 1440) - 6) < 0.01
    assert auto_chunk(0.001, 1440) == 1000
    c = RunConfig.from_dict(raw(domain={"bbox": None, "center": [-97.1, 27.75], "radius_km": 15}, gauges={"source": "coops", "year": 2025}))
    e = estimate(c)
    assert e.steps == 87_600 and e.cell_steps == e.cells * 87_600 and e.grid_mb == pytest.approx(e.cells * (23 + 16 * 3) / 2**20)
    assert estimate(RunConfig.from_dict(raw())).steps is None and "unknown" in estimate(RunConfig.from_dict(raw())).report()
    assert readable(3 << 20) == "3.0 MB" and readable(None) == "unknown"


def test_cli(spark, tmp_path, capsys):
    pytest.importorskip("yaml")
    import yaml

    bad = tmp_path / "bad.yaml"
    bad.write_text(yaml.safe_dump(raw(simulation={"timestep_min": 7})))
    assert cli.main(["run", str(bad)]) == 1 and "does not divide" in capsys.readouterr().err
    good = tmp_path / "good.yaml"
    good.write_text(yaml.safe_dump(raw()))
    assert cli.main(["run", str(good), "--dry-run"]) == 0 and "cells" in capsys.readouterr().out
    out = tmp_path / "out"
    assert cli.main(["run", "--synthetic", "--out", str(out), "--daily-rasters", "--average"]) == 0
    found = spark.read.parquet(f"{out}/rasters")
    assert {r[0] for r in found.select("metric").distinct().collect()} == {"time_integrated", "time_average", "area_available", "refugia_time", "refugia_average", "never_submerged"}
    total, average = (found.filter(f"metric = '{m}' and value >= 0").agg({"value": "sum"}).first()[0] for m in ("time_integrated", "time_average"))
    assert average == pytest.approx(total / 3)
    assert found.filter("metric = 'time_integrated' and value = -9999").count() == 25
    daily = spark.read.parquet(f"{out}/daily/run_id=synthetic")
    assert daily.agg({"win_shallow_band": "sum"}).first()[0] == total


def test_cli_prescribed_run(spark, tmp_path):
    pytest.importorskip("yaml")
    import yaml

    lines = ["time,a"] + [f"2025-01-{1 + i // 240:02d}T{i % 240 // 10:02d}:{i % 10 * 6:02d}:00Z,{0.3 * math.sin(i / 20):.4f}" for i in range(480)]
    (tmp_path / "levels.csv").write_text("\n".join(lines))
    dem = tmp_path / "dem.asc"
    dem.write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 30\nNODATA_value -9999\n-0.3 0.4\n-0.1 -9999\n")
    config = tmp_path / "c.yaml"
    config.write_text(yaml.safe_dump(raw(domain={"dem_path": str(dem)}, gauges={"prescribed_file": str(tmp_path / "levels.csv")}, output={"root": str(tmp_path / "o"), "run_id": "two days"})))
    assert cli.main(["run", str(config)]) == 0
    assert spark.read.csv(f"{tmp_path}/o/summaries/two days", header=True).count() == 4
    assert cli.main(["run", str(config), "--skip-existing"]) == 0
    assert cli.main(["run", str(config), "--quick-test", "1", "--run-id", "short"]) == 0
    found = spark.read.parquet(f"{tmp_path}/o/rasters")
    assert {r[0] for r in found.select("run_id").distinct().collect()} == {"two days", "short"}


def test_cli_custom_folders_and_skipping(spark, tmp_path, capsys):
    pytest.importorskip("yaml")
    import yaml

    (tmp_path / "levels.csv").write_text("\n".join(["time,a"] + [f"2025-01-01T{i // 10:02d}:{i % 10 * 6:02d}:00Z,{0.3 * math.sin(i / 20):.4f}" for i in range(240)]))
    (tmp_path / "dem.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 30\nNODATA_value -9999\n-0.3 0.4\n-0.1 -9999\n")
    output = {"root": str(tmp_path / "o"), "rasters": str(tmp_path / "r"), "summaries": str(tmp_path / "s"), "run_id": "mine", "write_daily": True, "daily_metrics": ["time_integrated__shallow_band"]}
    config = tmp_path / "c.yaml"
    config.write_text(yaml.safe_dump(raw(domain={"dem_path": str(tmp_path / "dem.asc")}, gauges={"prescribed_file": str(tmp_path / "levels.csv")}, output=output)))
    verb = ["run", str(config), "--average", "--no-total", "--export", "asc"]
    assert cli.main(verb) == 0 and "there already" not in capsys.readouterr().out
    assert cli.main([*verb, "--skip-existing"]) == 0 and "there already" in capsys.readouterr().out
    assert cli.main(["run", str(config), "--skip-existing"]) == 0 and "there already" not in capsys.readouterr().out
    assert (tmp_path / "s" / "mine").exists() and (tmp_path / "r_asc" / "mine__area_available_bin__shallow_band.asc").exists()
    assert "win_shallow_band" in spark.read.parquet(f"{tmp_path}/o/daily/run_id=mine").columns and not (tmp_path / "o" / "rasters").exists()
    assert spark.read.parquet(f"{tmp_path}/o/daily/run_id=mine").columns == ["cell_id", "win_shallow_band", "day"]


def test_days_results_and_alias(spark, tmp_path):
    from tidewright.plans.simulation import Inputs, Result, Run, Settings
    from tidewright.sources import grids

    cells, levels = grids.synthetic(spark, 6, 8, 2)
    run = Run(Inputs(cells, levels, 6), Settings({"b": (-1.5, 0.0)}, [0.5], 6, first_day=40), "r", metadata={"domain": "d"})
    days = {}
    assert run.each_day(lambda day, df: days.__setitem__(day, df.agg({"win_b": "sum"}).first()[0])) == 2
    assert list(days) == [40, 41] and sum(days.values()) == run.minutes.agg({"win_b": "sum"}).first()[0]
    run.result().save(str(tmp_path))
    back = Result.load(spark, str(tmp_path), "r")
    assert (back.n_days, back.cell_area_m2, back.metadata) == (2, 900.0, {"domain": "d"})
    assert sorted(map(str, back.summary.collect())) == sorted(map(str, run.summary().collect())) and back.minutes.count() == run.minutes.count()
    with pytest.warns(DeprecationWarning):
        assert Settings(slr_offset_m=0.5).offset == 0.5
    with pytest.warns(DeprecationWarning), pytest.raises(ValueError):
        Settings(offset=1.0, slr_offset_m=0.5)


def test_fetch_and_run_from_files(spark, tmp_path, monkeypatch, capsys):
    """Stations, offsets, levels and tiles from files: one gauge's offset is filled from around, one gauge has no levels."""
    yaml = pytest.importorskip("yaml")
    from datetime import date, timedelta

    from tidewright.operators import hilo
    from tidewright.plans import zones
    from tidewright.sources import grids, remote

    web = tmp_path / "web"
    web.mkdir()
    base = f"file://{web}"
    sites = {"a": (-97.06, 27.60), "b": (-97.02, 27.62), "c": (-97.04, 27.64)}
    listed = {"stations": [{"id": k, "name": k.upper(), "lat": y, "lng": x, "state": "TX"} for k, (x, y) in sites.items()]}
    (web / "stations.json?type=waterlevels").write_text(json.dumps(listed))
    for k, height in (("a", 1.0), ("c", 2.0)):
        (web / f"{k}.json?units=metric").write_text(json.dumps({"units": "meters", "datums": [{"name": "NAVD88", "value": height}, {"name": "MLLW", "value": 0.5}]}))
    first, last = date(2025, 1, 2), date(2025, 1, 3)
    span = first - timedelta(hilo.PAD_DAYS), last + timedelta(hilo.PAD_DAYS)
    for k in ("a", "b"):
        (_, url), = remote.series_requests(f"{base}/levels", k, *span, product="water_level", datum="MLLW", units="metric", time_zone="gmt", format="json")
        rows = [{"t": f"{first + timedelta(i // 240)} {i % 240 // 10:02d}:{i % 10 * 6:02d}", "v": f"{0.4 * math.sin(i / 20):.3f}"} for i in range(480)]
        (web / url.rsplit("/", 1)[1]).write_text(json.dumps({"data": rows}))
    (web / "index.html").write_text('<a href="TX/index.html">TX</a><a href="FL/index.html">FL</a>')
    (web / "TX").mkdir()
    name, n = "ncei19_n27x75_w097x25_2022v1.tif", 60
    plane = lambda lon, lat: 20 * (lon + 97.04) + 5 * (lat - 27.62)
    lines = [" ".join(f"{plane(-97.25 + (c + 0.5) / 240, 27.75 - (r + 0.5) / 240):.5f}" for c in range(n)) for r in range(n)]
    (web / "TX" / name).write_text(f"ncols {n}\nnrows {n}\nxllcorner -97.25\nyllcorner 27.5\ncellsize {1 / 240!r}\nNODATA_value -9999\n" + "\n".join(lines) + "\n")
    (web / "TX" / "index.html").write_text(f'<a href="{name}">{name}</a> ({(web / "TX" / name).stat().st_size / 1e6:.4f} MB)')
    for attribute, value in (("CATALOGUE", f"{base}/stations.json"), ("DATUMS", base + "/{}.json"), ("LEVELS", f"{base}/levels"), ("CONVERSION", f"{base}/none"), ("TILES", base)):
        monkeypatch.setattr(cli, attribute, value)
    monkeypatch.setattr(grids, "read_geotiff", grids.read_ascii)
    monkeypatch.setattr(remote, "RETRIES", 1)
    paths = {"dem_path": str(tmp_path / "dem"), "gauge_zones_path": str(tmp_path / "zones")}
    gauges = {"source": "coops", "year": 2025, "start": str(first), "end": str(last), "cache_dir": str(tmp_path / "cache"), "min_obs_coverage_pct": 50}
    config = tmp_path / "c.yaml"
    config.write_text(yaml.safe_dump(raw(domain={"bbox": [-97.08, 27.58, -97.01, 27.66], "resolution_m": 200, **paths}, gauges=gauges, output={"root": str(tmp_path / "o")}, refugia_thresholds=[0.2])))
    assert cli.main(["fetch", str(config)]) == 0, capsys.readouterr()
    told = capsys.readouterr().out
    assert "1 tiles" in told and "dropped for want of levels: c" in told
    kept = {r["station_id"]: (r["gauge_idx"], r["offset_source"], r["offset_m"]) for r in zones.kept_gauges(spark, paths["gauge_zones_path"]).collect()}
    assert set(kept) == {"a", "b"} and kept["a"][1:] == ("published", 0.5) and kept["b"][1] == "idw" and 0.5 < kept["b"][2] < 1.5
    dem, grid = grids.read_pixels(spark, paths["dem_path"])
    assert grid.transform[0] == 200 and grid.transform[2] % 200 == 0 and dem.filter("z is not null").count() == grid.width * grid.height
    zoned = {r["z"] for r in grids.read_pixels(spark, paths["gauge_zones_path"])[0].select("z").distinct().collect()}
    assert zoned == {1.0, 2.0}

    # The run starts from what was kept: the services are gone.
    monkeypatch.setattr(cli, "CATALOGUE", "file:///nowhere")
    monkeypatch.setattr(cli, "offsets", lambda *a, **k: pytest.fail("offsets are known"))
    assert cli.main(["run", str(config)]) == 0, capsys.readouterr()
    assert "drawing them again" not in capsys.readouterr().out
    values = spark.read.parquet(f"{tmp_path}/o/rasters").filter("metric = 'time_integrated' and value > 0")
    assert values.count() > 0
    # A second fetch finds all in place.
    monkeypatch.undo()

