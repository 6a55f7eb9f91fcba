"""Command line: run and fetch."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.geo import utm_grid
from tidewright.functions.sun import daylight_table
from tidewright.operators import hilo, series, stations, tiles
from tidewright.plans import zones
from tidewright.plans.config import Output, RunConfig
from tidewright.plans.domain import target_crs
from tidewright.plans.estimate import estimate
from tidewright.plans.simulation import Inputs, Run, Settings
from tidewright.sources import grids, remote, results, tables

CATALOGUE = "https://api.tidesandcurrents.noaa.gov/mdapi/prod/webapi/stations.json"
DATUMS = "https://api.tidesandcurrents.noaa.gov/mdapi/prod/webapi/stations/{}/datums.json"
LEVELS = "https://api.tidesandcurrents.noaa.gov/api/prod/datagetter"
CONVERSION = "https://vdatum.noaa.gov/vdatumweb/api/convert"
TYPES = ("waterlevels", "tidepredictions")
TILES = "https://noaa-nos-coastal-lidar-pds.s3.amazonaws.com/dem/NCEI_ninth_Topobathy_2014_8483"


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tidewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewright", description="Time that places spend at a usable depth of water.")
    verbs = top.add_subparsers(dest="verb", required=True)
    run = verbs.add_parser("run", help="compute durations")
    run.add_argument("config", nargs="?")
    run.add_argument("--run-id")
    run.add_argument("--out")
    run.add_argument("--timestep-min", type=int)
    run.add_argument("--gauge-interp", choices=series.METHODS)
    run.add_argument("--daily-rasters", action=argparse.BooleanOptionalAction, default=None)
    run.add_argument("--average", action="store_true")
    run.add_argument("--no-total", action="store_true")
    run.add_argument("--dry-run", action="store_true", help="estimate only")
    run.add_argument("--quick-test", type=int, nargs="?", const=3, metavar="DAYS", help="the first days only")
    run.add_argument("--skip-existing", action="store_true")
    run.add_argument("--export", choices=("asc", "tif"), help="rasters besides the tables")
    run.add_argument("--synthetic", action="store_true", help="a made-up ramp and tide")
    fetch = verbs.add_parser("fetch", help="gather stations, offsets, levels and tiles")
    fetch.add_argument("config")
    fetch.add_argument("--refresh", action="store_true")
    fetch.add_argument("--cudem-regions", nargs="*", metavar="REGION", help="these of the listing's regions, not those around the domain")
    fetch.add_argument("--allow-missing-offsets", action="store_true")
    fetch.add_argument("--idw-fill-offsets", action=argparse.BooleanOptionalAction, default=None)
    fetch.add_argument("--dry-run", action="store_true")
    return top


def overridden(config: RunConfig, args: argparse.Namespace) -> RunConfig:
    """The configuration with what the command line says, checked again."""
    out, sim = config.output, config.simulation
    out.run_id = args.run_id or out.run_id
    if args.out:
        out.root, out.rasters, out.summaries = args.out, f"{args.out}/rasters", f"{args.out}/summaries"
    sim.timestep_min = args.timestep_min or sim.timestep_min
    sim.gauge_interp = args.gauge_interp or sim.gauge_interp
    out.write_average = out.write_average or args.average
    out.write_total = out.write_total and not args.no_total
    if args.daily_rasters is not None:
        out.write_daily = args.daily_rasters
    config.check()
    return config


def prescribed(spark: SparkSession, config: RunConfig) -> tables.Series:
    g = config.gauges
    return tables.read_series(spark, g.prescribed_file, g.time_col, g.record_interval_min, g.station_order, g.value_scale, g.datum_offsets, g.fill_gaps, g.max_gap_records, g.has_header)


def station_table(spark: SparkSession, config: RunConfig, refresh: bool = False) -> DataFrame:
    """The configured table, or all catalogue stations in and around the domain, numbered."""
    g, d = config.gauges, config.domain
    if g.stations_csv:
        return d.filter(tables.read_stations(spark, g.stations_csv), 1)
    found = []
    for kind in TYPES:
        bodies = remote.cached(spark, f"{g.cache_dir}/catalogue_{kind}", [(kind, f"{CATALOGUE}?type={kind}")], refresh)
        found.append(remote.parse_stations(bodies.filter(F.col("key") == kind), kind))
    return stations.discover(found, d.bbox, d.buffer_km, None)


def offsets(spark: SparkSession, config: RunConfig, table: DataFrame, refresh: bool = False) -> DataFrame:
    """Stations with the first offset of published datums, conversion service and manual table."""
    g = config.gauges
    places = table.select("station_id", "lon", "lat", tiles.datum_region(F.col("lon"), F.col("lat")).alias("region")).collect()
    published = remote.cached(spark, f"{g.cache_dir}/datums", [(p["station_id"], DATUMS.format(p["station_id"]) + "?units=metric") for p in places], refresh)
    query = "s_x={lon}&s_y={lat}&s_z=0&region={region}&s_h_frame=NAD83_2011&s_v_frame=MLLW&t_h_frame=NAD83_2011&t_v_frame=NAVD88&t_v_unit=m&s_v_unit=m"
    converted = remote.cached(spark, f"{g.cache_dir}/conversion", [(p["station_id"], f"{CONVERSION}?{query.format(**p.asDict())}") for p in places], refresh)
    manual = tables.read_offsets(spark, g.vdatum_csv) if g.vdatum_csv else spark.createDataFrame([], "station_id string, offset_m double")
    return stations.cascade(table, [("published", remote.parse_datums(published)), ("conversion", remote.parse_conversion(converted)), ("manual", manual)])


def fetched(spark: SparkSession, config: RunConfig, table: DataFrame, interval: int = 6, refresh: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records (gauge, rec, level) shifted to the bed's datum, manifest, dropped stations) of the configured year."""
    g, (first, last) = config.gauges, config.dates()
    kept, dropped = stations.split_usable(table)
    ids = [r[0] for r in kept.select("station_id").collect()]
    days = (last - first).days + 1
    pages = {}
    for product, extra in (("water_level", {}), ("predictions", {"interval": "hilo"})):
        asked = [q for s in ids for q in remote.series_requests(LEVELS, s, first - timedelta(hilo.PAD_DAYS), last + timedelta(hilo.PAD_DAYS), product=product, datum=g.datum, units="metric", time_zone="gmt", format="json", **extra)]
        pages[product] = remote.parse_series(remote.cached(spark, f"{g.cache_dir}/{product}_{g.year}", asked, refresh))
    start, n_records = f"{first} 00:00:00", days * 1440 // interval
    inside = F.col("t").between(F.lit(start).cast("timestamp"), F.lit(f"{last + timedelta(1)} 00:00:00").cast("timestamp"))
    kinds = stations.record_types(stations.coverage(pages["water_level"].filter(inside), days), pages["predictions"], g.min_obs_coverage_pct)
    observed = kinds.filter("record_type = 'obs_6min'").select("station_id")
    levels = stations.onto_grid(pages["water_level"].join(observed, "station_id", "left_semi"), observed, start, n_records, interval)
    numbers = kept.select("station_id", F.col("gauge_idx").alias("gauge"))
    events = pages["predictions"].join(kinds.filter("record_type = 'pred_hilo'").select("station_id"), "station_id", "left_semi").join(numbers, "station_id")
    minute = ((F.unix_micros("t") - F.unix_micros(F.lit(start).cast("timestamp"))) / 60_000_000).cast("int")
    tide = hilo.padded_series(events.select("gauge", minute.alias("t_min"), F.col("v").alias("level")), days * 1440, g.hilo_interp)
    tide = tide.filter(F.col("minute") % interval == 0).join(numbers, "gauge").select("station_id", F.expr(f"minute div {interval}").cast("int").alias("rec"), "level")
    every = levels.unionByName(tide)
    book = stations.manifest(kinds, every, kept.drop("gauge_idx"))
    gauges = book.filter("gauge_idx is not null").select("station_id", (F.col("gauge_idx") + 1).alias("gauge"))
    shifted = stations.apply_offsets(every.join(gauges, "station_id").select("gauge", "rec", "level"), gauges.join(kept.select("station_id", "offset_m"), "station_id"))
    return shifted, book, dropped


def resolved(spark: SparkSession, config: RunConfig) -> DataFrame:
    """The stations with their offsets: those that a fetch has kept, if it has, else found and resolved, with gaps filled from around."""
    g = config.gauges
    kept = zones.kept_gauges(spark, config.zones_path) if g.source == "coops" else None
    if kept is not None and "offset_m" in kept.columns:
        return kept
    table = offsets(spark, config, station_table(spark, config))
    if g.vdatum_idw_fill:
        table = stations.fill_interpolated(table, g.vdatum_idw_power, g.vdatum_idw_k)
    return table


def report_dropped(dropped: DataFrame, book: DataFrame | None = None) -> None:
    for row in dropped.select("station_id").collect():
        print(f"dropped for want of an offset: {row['station_id']}")
    for row in (book.filter("gauge_idx is null").select("station_id").collect() if book is not None else ()):
        print(f"dropped for want of levels: {row['station_id']}")


def both_kinds(spark: SparkSession, config: RunConfig, data: tables.Series, book: DataFrame) -> DataFrame:
    """(gauge_idx, station_id, lat, lon) of a hybrid run: the own gauges in their columns' order, the fetched after them."""
    names = spark.createDataFrame([(i, s) for i, s in enumerate(data.station_ids)], "gauge_idx int, station_id string")
    own = stations.with_sites(names, tables.read_stations(spark, config.gauges.sensor_meta_csv).drop("gauge_idx"))
    rest = book.filter("gauge_idx is not null").withColumn("gauge_idx", F.col("gauge_idx") + len(data.station_ids))
    return own.select("gauge_idx", "station_id", "lat", "lon").unionByName(rest.select("gauge_idx", "station_id", "lat", "lon"))


def water_levels(spark: SparkSession, config: RunConfig) -> tuple[DataFrame, int, DataFrame | None]:
    """(records, interval, gauges by number) from the configured source."""
    g = config.gauges
    if g.source == "prescribed":
        data = prescribed(spark, config)
        return data.records, data.interval, None
    if g.source == "coops":
        interval = g.record_interval_min or 6
        records, book, dropped = fetched(spark, config, resolved(spark, config), interval)
        report_dropped(dropped, book)
        return records, interval, book.filter("gauge_idx is not null")
    data = prescribed(spark, config)
    records, book, dropped = fetched(spark, config, resolved(spark, config), data.interval)
    report_dropped(dropped, book)
    return stations.hybrid(data.records, records), data.interval, both_kinds(spark, config, data, book)


def elevation(spark: SparkSession, config: RunConfig, regions: Sequence[str] | None = None, refresh: bool = False, dry: bool = False) -> int:
    """Fetch the tiles of the domain and write their mosaic to the bed's path; the number of tiles."""
    d, folder = config.domain, config.gauges.cache_dir
    if not regions:
        listing = remote.cached(spark, f"{folder}/tile_regions", [("listing", f"{TILES}/index.html")], refresh)
        listed = tiles.folders(listing, "body").select("region")
        regions = [r[0] for r in tiles.regions_for(spark, d.bbox, None if listed.isEmpty() else listed).collect()]
    pages = remote.cached(spark, f"{folder}/tile_listings", [(r, f"{TILES}/{r}/index.html") for r in sorted(regions)], refresh)
    found = tiles.tiles_in(tiles.newest(tiles.listed_tiles(pages.filter(F.col("key").isin(list(regions))), "body", "key", "url")), d.bbox)
    chosen = tiles.prioritised(found).orderBy("priority").collect()
    if not chosen:
        raise tiles.TileError(f"no tile of {', '.join(sorted(regions)) or 'any region'} covers {d.name}")
    print(f"{len(chosen)} tiles, {sum(t['size_mb'] for t in chosen):.0f} MB")
    if dry:
        return len(chosen)
    paths = remote.download([(t["name"], t["url"], t["size_mb"]) for t in chosen], f"{folder}/tiles", not refresh, 1.0 if TILES.startswith("http") else 0.0)
    pixels, sources = None, []
    for t, path in zip(chosen, paths, strict=True):
        part, g = grids.read_pixels(spark, path)
        if g.transform is None:
            raise tiles.TileError(f"{t['name']} has no place")
        step, _, west, _, _, north = g.transform
        sources.append((t["priority"], west, north, step, g.height, g.width))
        part = part.select(F.lit(t["priority"]).alias("priority"), "row", "col", "z")
        pixels = part if pixels is None else pixels.unionByName(part)
    crs = config.target_crs or target_crs(d)
    code = int(crs.rsplit(":", 1)[-1])
    x, y, width, height = utm_grid(spark, d.bbox, code, d.resolution_m)
    places = spark.createDataFrame(sources, "priority int, west double, north double, step double, rows int, columns int")
    dem = tiles.warp(spark, pixels, places, x, y, width, height, d.resolution_m, code % 100, code // 100 == 326)
    grid = grids.Grid(width, height, (d.resolution_m, 0.0, x, 0.0, -d.resolution_m, y), crs)
    grids.write_pixels(dem, "dem", grid, config.dem_path)
    return len(chosen)


def daylight(spark: SparkSession, config: RunConfig) -> DataFrame | None:
    """The given table, or one computed for the domain's middle."""
    if not config.simulation.constrain_daylight:
        return None
    if config.simulation.daylight_table:
        return tables.read_daylight(spark, config.simulation.daylight_table)
    if config.gauges.year is None:
        raise ValueError("daylight needs a year or a table")
    lon, lat = config.domain.centroid
    return daylight_table(spark, lat, lon, config.gauges.year)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.synthetic:
        cells, records = grids.synthetic(spark, days=args.quick_test or 3)
        sim = Run(Inputs(cells, records, 6), Settings({"shallow_band": (-1.5, 0.0)}, [0.2, 0.5], args.timestep_min or 6, args.gauge_interp or "linear"), args.run_id or "synthetic")
        out, days, daily, average, total = args.out or "outputs", sim.n_days, bool(args.daily_rasters), args.average, not args.no_total
        output = Output(root=out)
        grid, annual = grids.Grid(90, 60, (30.0, 0.0, 0.0, 0.0, -30.0, 1800.0)), True
    else:
        if not args.config:
            raise ValueError("a configuration is needed, or --synthetic")
        config = overridden(RunConfig.from_yaml(args.config), args)
        print(config.report())
        if args.dry_run:
            print(estimate(config).report())
            return 0
        output = config.output
        out, daily, average, total, annual = output.root, output.write_daily, output.write_average, output.write_total, output.write_annual
        if args.skip_existing and results.has_run(spark, output.rasters, output.run_id, list(config.windows), config.thresholds, average, total):
            print(f"{config.output.run_id} is there already")
            return 0
        dem, grid = grids.read_pixels(spark, config.dem_path)
        drawn = grids.read_pixels(spark, config.zones_path) if config.zones_path else None
        mask = grids.read_pixels(spark, config.mask_path) if config.mask_path else None
        for other in filter(None, (drawn, mask)):
            grids.same_shape(grid, other[1])
        records, interval, gauges = water_levels(spark, config)
        cells = grids.cells(dem, grid.width, drawn and drawn[0], mask and mask[0])
        if gauges is not None and drawn is not None and not zones.zones_current(spark, config.zones_path, gauges):
            print("zones were drawn for other gauges; drawing them again")
            cells = zones.draw_zones(cells, grid, gauges, config.target_crs or target_crs(config.domain))
        if args.quick_test:
            records = series.first_days(records, interval, args.quick_test)
        sim = Run(Inputs(cells, records, interval), Settings.of(config, daylight(spark, config)), config.output.run_id, grid.cell_area_m2(900.0), {"domain": config.domain.name, "crs": config.target_crs or target_crs(config.domain)})
        days = sim.n_days
    s = sim.settings
    print(sim.describe(), f"({grid.width} columns)")
    windows = list(s.windows)
    if annual and (total or average):
        metrics = results.long_metrics(cells, sim.minutes, sim.run_id, windows, s.thresholds, days, total, average)
        results.write_metrics(metrics, output.rasters, sim.run_id)
        if args.export:
            written = spark.read.option("basePath", output.rasters).parquet(f"{output.rasters}/run_id={sim.run_id}").withColumn("key", F.coalesce(F.col("key").cast("string"), F.lit("")))
            for path in results.export_rasters(written, grid, f"{output.rasters}_{args.export}", results.metric_names(sim.run_id, windows, s.thresholds), args.export):
                print(f"wrote {path}")
    if daily:
        chosen = results.daily_columns(windows, s.thresholds, output.daily_metrics)
        results.write_daily(sim.daily(), f"{out}/daily/run_id={sim.run_id}", s.first_day, chosen, output.daily_dtype, output.daily_compress)
    tables.write_csv(sim.summary(), f"{output.summaries}/{sim.run_id}")
    sim.summary().show(50, False)
    return 0


def fetch(spark: SparkSession, args: argparse.Namespace) -> int:
    config = RunConfig.from_yaml(args.config)
    print(config.report())
    if args.dry_run:
        print(estimate(config).report())
        return 0
    g = config.gauges
    if g.source == "prescribed" and not g.stations_csv:
        if not config.dem_path or grids.exists(spark, config.dem_path) and not args.refresh:
            print("levels are prescribed; there is nothing to fetch")
        else:
            elevation(spark, config, args.cudem_regions, args.refresh)
        return 0
    table = offsets(spark, config, station_table(spark, config, args.refresh), args.refresh)
    if g.vdatum_idw_fill if args.idw_fill_offsets is None else args.idw_fill_offsets:
        table = stations.fill_interpolated(table, g.vdatum_idw_power, g.vdatum_idw_k)
    if not args.allow_missing_offsets:
        stations.require_offsets(table)
    tables.write_csv(table, f"{g.cache_dir}/stations_{config.domain.key}")
    stations.source_counts(table).show()
    data = prescribed(spark, config) if g.source == "hybrid" else None
    _, book, dropped = fetched(spark, config, table, data.interval if data else g.record_interval_min or 6, args.refresh)
    tables.write_csv(book, f"{g.cache_dir}/manifest_{config.domain.key}")
    report_dropped(dropped, book)
    if not config.dem_path:
        return 0
    if args.refresh or not grids.exists(spark, config.dem_path):
        elevation(spark, config, args.cudem_regions, args.refresh)
    if config.zones_path:
        kept = book.filter("gauge_idx is not null").select("gauge_idx", "station_id", "name", "lat", "lon")
        gauges = both_kinds(spark, config, data, book) if data else kept.join(table.select("station_id", "offset_m", "offset_source"), "station_id")
        if args.refresh or not zones.zones_current(spark, config.zones_path, gauges):
            dem, grid = grids.read_pixels(spark, config.dem_path)
            drawn = zones.draw_zones(grids.cells(dem, grid.width), grid, gauges, config.target_crs or target_crs(config.domain))
            zones.write_zones(drawn, gauges, config.zones_path, grid)
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    """0, or 1 with the error's message on stderr."""
    args = parser().parse_args(argv)
    try:
        return {"run": run, "fetch": fetch}[args.verb](session(), args)
    except Exception as e:  # noqa: BLE001
        print(f"tidewright: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
