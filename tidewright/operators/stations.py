"""Stations: catalogues, area, records, datum offsets, gauges for cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewright.functions.geo import EARTH_KM, BBox, grow, haversine_km, in_ring
from tidewright.operators.sites import SiteTree

STATION = "station_id string, name string, lat double, lon double, state string, station_type string"
#: Sites held as literals of the plan; more go to the tasks as an array.
LITERAL_SITES = 64
#: Sites sent with every task: 24 bytes each.
MOST_SITES = 1_000_000
#: Stations that a broadcast may hold: 100,000 rows of 40 bytes.
MOST_KNOWN = 100_000
COINCIDENT_KM = 0.001
SLACK_KM = 1e-8


class StationError(ValueError):
    """Stations are missing or cannot be used."""


class DatumError(ValueError):
    """A datum offset is missing."""


class HybridError(ValueError):
    """Own and fetched gauges do not go together."""


def catalogue(*sources: DataFrame) -> DataFrame:
    """Stations of all sources; of one id, that of the first source that has it."""
    every = None
    for rank, source in enumerate(sources):
        one = source.withColumn("_rank", F.lit(rank))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("station_id").orderBy("_rank", "lat", "lon"))
    return every.withColumn("_nth", first).filter("_nth = 1").drop("_nth", "_rank")


def within(points: DataFrame, bbox: BBox, buffer_km: float = 0.0, ring: list[tuple[float, float]] | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points in the grown box, its edges included; with a ring, those inside it too."""
    x0, y0, x1, y1 = grow(bbox, buffer_km)
    test = F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1)
    return points.filter(test & in_ring(F.col(lon), F.col(lat), ring) if ring else test)


def at_least(stations: DataFrame, n: int, what: str = "stations") -> DataFrame:
    found = len(stations.limit(n).collect()) if n else 0
    if found < n:
        raise ValueError(f"{found} {what} found, {n} are needed")
    return stations


def numbered(stations: DataFrame, order: list[str | Column] | str = "station_id", as_name: str = "gauge_idx", start: int = 0) -> DataFrame:
    """Dense numbers in an order. One task: for dimension tables only."""
    keys = [order] if isinstance(order, (str, Column)) else order
    return stations.withColumn(as_name, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)) - 1 + start).cast("int"))


def discover(sources: list[DataFrame], bbox: BBox, buffer_km: float = 10.0, ring: list[tuple[float, float]] | None = None, min_stations: int = 1) -> DataFrame:
    return numbered(at_least(within(catalogue(*sources), bbox, buffer_km, ring), min_stations))


def coverage(observations: DataFrame, n_days: int, per_day: int = 240) -> DataFrame:
    """Share of the expected observations there are, in percent, by station."""
    return observations.groupBy("station_id").agg(F.count("v").alias("n_records"), (F.count("v") * F.lit(100.0) / F.lit(float(n_days * per_day))).alias("coverage_pct"))


def record_types(covered: DataFrame, predicted: DataFrame, min_pct: float = 80.0) -> DataFrame:
    """obs_6min where coverage suffices, else pred_hilo where there are predictions, else empty."""
    has = predicted.select("station_id").distinct().withColumn("has", F.lit(True))
    kind = F.when(F.col("coverage_pct") >= min_pct, "obs_6min").when(F.col("has"), "pred_hilo").otherwise("empty")
    return covered.join(has, "station_id", "full_outer").select("station_id", F.coalesce("n_records", F.lit(0).cast("long")).alias("n_records"), F.coalesce("coverage_pct", F.lit(0.0)).alias("coverage_pct"), kind.alias("record_type"))


def type_report(kinds: DataFrame) -> str:
    """Stations by record type, as text."""
    rows = kinds.groupBy("record_type").count().orderBy("record_type").collect()
    return "\n".join(f"{r['record_type']:12s}{r['count']:6d}" for r in rows)


def first_by_time(observations: DataFrame) -> DataFrame:
    """One observation a time, the first by value; nulls and text that is no number are dropped."""
    clean = observations.withColumn("v", F.col("v").try_cast("double")).filter("v is not null and t is not null")
    return clean.groupBy("station_id", "t").agg(F.min("v").alias("v"))


def onto_grid(observations: DataFrame, stations: DataFrame, start: str, n_records: int, interval: int, bridge: bool | None = None) -> DataFrame:
    """(station_id, rec, level) on a grid of n records. Six-minute grids take exact matches only.

    On others levels are interpolated in time between the observations around, which bridges gaps; before
    the first there is none, after the last it holds.
    """
    bridge = interval != 6 if bridge is None else bridge
    micros = F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    obs = first_by_time(observations).select("station_id", micros.alias("at"), "v")
    slots = stations.select("station_id").distinct().select("station_id", F.explode(F.sequence(F.lit(0), F.lit(n_records - 1))).alias("rec"))
    slots = slots.withColumn("at", F.col("rec").cast("long") * F.lit(interval * 60_000_000))
    if not bridge:
        return slots.join(obs, ["station_id", "at"], "left").select("station_id", "rec", F.col("v").alias("level"))
    every = slots.join(obs, ["station_id", "at"], "full_outer")
    back = Window.partitionBy("station_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("station_id").orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.col("at"))
    v0, t0, v1, t1 = F.last("v", True).over(back), F.last(known, True).over(back), F.first("v", True).over(ahead), F.first(known, True).over(ahead)
    level = F.when(v1.isNull() | (t0 == t1), v0).otherwise(v0 + (v1 - v0) * ((F.col("at") - t0) / (t1 - t0)))
    return every.select("station_id", "rec", F.when(v0.isNotNull(), level).alias("level")).filter("rec is not null")


def manifest(kinds: DataFrame, levels: DataFrame, stations: DataFrame) -> DataFrame:
    """Each station with its record type, records and gaps; gauge_idx numbers those that have a level."""
    gaps = levels.groupBy("station_id").agg(F.count("level").alias("n_levels"), (F.count_if(F.col("level").isNull()) * F.lit(100.0) / F.count("*")).alias("gap_pct"))
    every = stations.join(kinds, "station_id", "left").join(gaps, "station_id", "left")
    kept = numbered(every.filter("n_levels > 0"), "station_id").select("station_id", "gauge_idx")
    return every.join(kept, "station_id", "left").select("station_id", "name", "lat", "lon", F.coalesce("record_type", F.lit("error")).alias("record_type"), F.coalesce("n_levels", F.lit(0).cast("long")).alias("n_records"), F.coalesce("gap_pct", F.lit(100.0)).alias("gap_pct"), "gauge_idx")


# Datum offsets


def cascade(stations: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each station's offset from the first source that has one, and that source's name."""
    out, values, labels = stations, [], F.lit(None).cast("string")
    for i, (name, table) in enumerate(sources):
        out = out.join(table.select("station_id", F.col("offset_m").alias(f"_o{i}")), "station_id", "left")
        values.append(F.col(f"_o{i}"))
    for name, value in reversed(list(zip((n for n, _ in sources), values, strict=True))):
        labels = F.when(value.isNotNull(), F.lit(name)).otherwise(labels)
    return out.select(*stations.columns, F.coalesce(*values).alias("offset_m"), labels.alias("offset_source"))


def source_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy(F.coalesce("offset_source", F.lit("unresolved")).alias("offset_source")).agg(F.count("*").alias("n"))


def require_offsets(resolved: DataFrame) -> DataFrame:
    missing = [r[0] for r in resolved.filter("offset_m is null").select("station_id").orderBy("station_id").limit(5).collect()]
    if missing:
        raise DatumError(f"no datum offset for stations {', '.join(missing)}")
    return resolved


def interpolated(resolved: DataFrame, power: float = 2.0, k: int | None = None, coincident_km: float = COINCIDENT_KM) -> DataFrame:
    """Offsets of stations without one, weighted by inverse distance from the k nearest that have one.

    One that stands at the same place gives its own. The k nearest are sought in a tree of the known
    places, which goes along with the tasks; there may be MOST_SITES of these. Without k each unresolved
    station is weighed against all resolved ones; there may be MOST_KNOWN of these.
    """
    known = resolved.filter("offset_m is not null").select(F.col("station_id").alias("from_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("offset_m").alias("v"))
    wanted = resolved.filter("offset_m is null").select("station_id", "lon", "lat")
    if k is not None:
        pairs = _near_pairs(wanted, known, k)
    else:
        if known.limit(MOST_KNOWN + 1).count() > MOST_KNOWN:
            raise StationError(f"more than {MOST_KNOWN} stations with an offset")
        pairs = wanted.crossJoin(F.broadcast(known))
    pairs = pairs.withColumn("km", haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")))
    if k is not None:
        nearest = Window.partitionBy("station_id").orderBy(F.round("km", 9), "from_id")
        pairs = pairs.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k)
    w = F.pow(F.greatest("km", F.lit(1e-12)), F.lit(-power))
    same = F.col("km") <= coincident_km
    mean = pairs.groupBy("station_id").agg(F.min_by(F.when(same, F.col("v")), F.when(same, F.col("km"))).alias("twin"), (F.sum(w * F.col("v")) / F.sum(w)).alias("mean"))
    return mean.select("station_id", F.coalesce("twin", "mean").alias("offset_m"))


def _near_pairs(wanted: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Wanted stations with known ones, their k nearest among them; one without a place has a row of nulls, if any is known with its place.

    Of known stations at one place the first k by id are all that can be among the k nearest.
    """
    placed = known.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    first = placed.withColumn("nth", F.row_number().over(Window.partitionBy("x", "y").orderBy("from_id"))).filter(F.col("nth") <= k).drop("nth")
    places = np.array([tuple(r) for r in placed.select("x", "y").distinct().limit(MOST_SITES + 1).collect()], np.float64).reshape(-1, 2)
    if len(places) > MOST_SITES:
        raise StationError(f"more than {MOST_SITES} places of stations with an offset")
    if not len(places):
        return wanted.join(known, F.lit(False))
    tree = SiteTree(_on_sphere(places))
    schema = StructType([*wanted.schema, StructField("x", DoubleType()), StructField("y", DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 4096):
                part = batch.slice(b, 4096)
                points = np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in (1, 2)])
                i, j = tree.near(_on_sphere(points), max(k, 1), _widened)
                none = np.setdiff1d(np.arange(len(points)), i)
                x, y = (pa.array(np.r_[places[j, c], np.zeros(len(none))], mask=np.arange(len(j) + len(none)) >= len(j)) for c in (0, 1))
                rows = part.take(pa.array(np.r_[i, none]))
                yield pa.RecordBatch.from_arrays([*rows.columns, x, y], names=names)

    # Merged, as Spark's estimate leaves out that a station has a row for each place.
    return wanted.mapInArrow(run, schema).join(first.hint("merge"), ["x", "y"], "left")


def _on_sphere(places: np.ndarray) -> np.ndarray:
    """Unit vectors of (lon, lat) in degrees: a chord's square is four times the haversine."""
    lon, lat = np.radians(places.T)
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def _widened(chord: np.ndarray) -> np.ndarray:
    """Squared chords longer by SLACK_KM and by rounding: distances are compared to nine digits of a km, in other arithmetic."""
    half = np.arcsin(np.sqrt(np.minimum(chord / 4, 1.0))) + SLACK_KM / (2 * EARTH_KM)
    return np.where(half < np.pi / 2, 4 * np.sin(np.minimum(half, np.pi / 2)) ** 2 + 4e-14, np.inf)


def fill_interpolated(resolved: DataFrame, power: float = 2.0, k: int | None = None) -> DataFrame:
    filled = interpolated(resolved, power, k).select("station_id", F.col("offset_m").alias("_idw"))
    out = resolved.join(filled, "station_id", "left")
    return out.select(*[c for c in resolved.columns if c not in ("offset_m", "offset_source")], F.coalesce("offset_m", "_idw").alias("offset_m"), F.when(F.col("offset_m").isNull() & F.col("_idw").isNotNull(), F.lit("idw")).otherwise(F.col("offset_source")).alias("offset_source"))


def apply_offsets(levels: DataFrame, offsets: DataFrame, key: str = "gauge") -> DataFrame:
    """Levels shifted by their gauge's offset; a gauge without one is an error when the rows are read."""
    joined = levels.join(offsets.select(key, "offset_m"), key, "left")
    missing = F.raise_error(F.concat(F.lit("no datum offset for "), F.col(key).cast("string"))).cast("double")
    return joined.select(*[c for c in levels.columns if c != "level"], (F.col("level") + F.when(F.col("offset_m").isNull(), missing).otherwise(F.col("offset_m"))).alias("level"))


def split_usable(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stations with an offset, numbered anew; those dropped for want of one)."""
    return numbered(resolved.filter("offset_m is not null").drop("gauge_idx")), resolved.filter("offset_m is null")


# Gauges for cells


def nearest_gauge(cells: DataFrame, sites: DataFrame, x: Column, y: Column, exclude: Column | None = None) -> DataFrame:
    """cells with `gauge`, the number of the nearest site (ties: the lowest); 0 where excluded. sites: (gauge, x, y), planar."""
    points = sites.select(F.col("gauge").cast("int"), F.col("x").cast("double"), F.col("y").cast("double")).orderBy("gauge").limit(MOST_SITES + 1).collect()
    if not points:
        raise StationError("there is no gauge to assign cells to")
    if len(points) > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} gauges")
    rest = [c for c in cells.columns if c != "gauge"]
    if len(points) <= LITERAL_SITES:
        options = [F.struct((F.pow(x - F.lit(p[1]), 2) + F.pow(y - F.lit(p[2]), 2)).alias("d"), F.lit(p[0]).alias("g")) for p in points]
        gauge = F.array_min(F.array(*options))["g"]
    else:
        gauge = _nearest(np.array([p[0] for p in points], np.int32), np.array([(p[1], p[2]) for p in points]))(x.cast("double"), y.cast("double"))
    if exclude is not None:
        gauge = F.when(F.coalesce(exclude, F.lit(True)), F.lit(0)).otherwise(gauge)
    return cells.select(*rest, gauge.alias("gauge"))


def _nearest(gauges: np.ndarray, sites: np.ndarray):
    """Of sites at one place the lowest gauge alone can be the nearest. gauges: rising."""
    places, first = np.unique(sites, axis=0, return_index=True)
    tree, lowest, none = SiteTree(places), gauges[first], np.iinfo(np.int32).max

    @F.pandas_udf("int")
    def find(x, y):  # noqa: ANN001, ANN202
        points = np.column_stack([x.to_numpy(np.float64, na_value=np.nan), y.to_numpy(np.float64, na_value=np.nan)])
        i, j = tree.near(points)
        found = np.full(len(points), none, np.int32)
        np.minimum.at(found, i, lowest[j])
        found[np.isnan(points).any(axis=1)] = 0
        return __import__("pandas").Series(found)

    return find


def zones_match(kept: DataFrame, wanted: DataFrame) -> bool:
    """Whether two (gauge_idx, station_id) tables are the same, number by number."""
    a, b = kept.select("gauge_idx", "station_id"), wanted.select("gauge_idx", "station_id")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def hybrid(own: DataFrame, fetched: DataFrame) -> DataFrame:
    """Own gauges first, the fetched after them, in one series of equal length; both are (gauge, rec, level)."""
    sizes = [df.groupBy("gauge").agg((F.max("rec") + 1).alias("n")).agg(F.min("n"), F.max("n"), F.max("gauge")).first() for df in (own, fetched)]
    lengths = {s[i] for s in sizes for i in (0, 1)}
    if len(lengths) != 1:
        raise HybridError(f"series differ in length: {sorted(x or 0 for x in lengths)} records")
    return own.unionByName(fetched.withColumn("gauge", (F.col("gauge") + F.lit(sizes[0][2])).cast(own.schema["gauge"].dataType)))


def with_sites(columns: DataFrame, sites: DataFrame) -> DataFrame:
    """Series columns with their sites' places; one without a site is an error."""
    missing = [r[0] for r in columns.join(sites, "station_id", "left_anti").select("station_id").limit(5).collect()]
    if missing:
        raise HybridError(f"no place is known for {', '.join(missing)}")
    return columns.join(sites, "station_id")
