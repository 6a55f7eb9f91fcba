"""Geodesy as column expressions (and the same arithmetic for driver-side numbers)."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Mean earth radius in km; km a degree of latitude, and of longitude at the equator.
EARTH_KM, KM_LAT, KM_LON = 6371.0088, 110.574, 111.320
CIRCLE_VERTICES = 128
#: Points along each edge of a box that is projected.
EDGE = 23
LEAST_COS = 1e-6

BBox = tuple[float, float, float, float]


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def degrees_of_km(km: Column, lat: Column) -> tuple[Column, Column]:
    """(degrees of longitude, degrees of latitude) that so many km span at a latitude."""
    cos = F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(LEAST_COS))
    return km / (F.lit(KM_LON) * cos), km / F.lit(KM_LAT)


def buffered(xmin: Column, ymin: Column, xmax: Column, ymax: Column, km: Column) -> list[Column]:
    """A box grown by km on all sides, within the globe. A buffer of zero or less changes nothing."""
    dx, dy = degrees_of_km(km, (ymin + ymax) / 2)
    dx, dy = F.when(km > 0, dx).otherwise(F.lit(0.0)), F.when(km > 0, dy).otherwise(F.lit(0.0))
    return [F.greatest(F.lit(-180.0), xmin - dx), F.greatest(F.lit(-90.0), ymin - dy), F.least(F.lit(180.0), xmax + dx), F.least(F.lit(90.0), ymax + dy)]


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG:326zz north of and on the equator, EPSG:327zz south of it."""
    zone = F.least(F.lit(60), F.greatest(F.lit(1), ((lon + 180) / 6).cast("int") + 1))
    return F.concat(F.lit("EPSG:"), F.when(lat >= 0, F.lit("326")).otherwise(F.lit("327")), F.lpad(zone.cast("string"), 2, "0"))


def pixel_x(col: Column, row: Column, a: float, b: float, c: float) -> Column:
    """x (or y, with d, e, f) of a pixel's centre under an affine transform."""
    return F.lit(a) * (col + F.lit(0.5)) + F.lit(b) * (row + F.lit(0.5)) + F.lit(c)


def circle(lon: Column, lat: Column, km: Column, n: int = CIRCLE_VERTICES) -> Column:
    """Closed ring of (lon, lat) around a point: n vertices and the first again."""
    dx, dy = degrees_of_km(km, lat)
    at = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: (i % n) * (2 * math.pi / n))
    return F.transform(at, lambda t: F.struct((lon + dx * F.cos(t)).alias("lon"), (lat + dy * F.sin(t)).alias("lat")))


# The same for numbers on the driver.


def km_in_degrees(km: float, lat: float) -> tuple[float, float]:
    return km / (KM_LON * max(abs(math.cos(math.radians(lat))), LEAST_COS)), km / KM_LAT


def bbox_around(lon: float, lat: float, radius_km: float) -> BBox:
    dx, dy = km_in_degrees(radius_km, lat)
    return max(-180.0, lon - dx), max(-90.0, lat - dy), min(180.0, lon + dx), min(90.0, lat + dy)


def grow(bbox: BBox, km: float) -> BBox:
    if km <= 0:
        return bbox
    dx, dy = km_in_degrees(km, (bbox[1] + bbox[3]) / 2)
    return max(-180.0, bbox[0] - dx), max(-90.0, bbox[1] - dy), min(180.0, bbox[2] + dx), min(90.0, bbox[3] + dy)


def utm_of(lon: float, lat: float) -> str:
    zone = min(60, max(1, int((lon + 180) / 6) + 1))
    return f"EPSG:{326 if lat >= 0 else 327}{zone:02d}"


def ring(lon: float, lat: float, km: float, n: int = CIRCLE_VERTICES) -> list[tuple[float, float]]:
    dx, dy = km_in_degrees(km, lat)
    points = [(lon + dx * math.cos(2 * math.pi * i / n), lat + dy * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*points, points[0]]


def grid_shape(bbox: BBox, resolution_m: float) -> tuple[int, int]:
    """(rows, columns) of a grid over a lon/lat box, by the length of a degree at its middle."""
    width = (bbox[2] - bbox[0]) * 1000 * KM_LON * math.cos(math.radians((bbox[1] + bbox[3]) / 2))
    height = (bbox[3] - bbox[1]) * 1000 * KM_LAT
    return max(1, math.ceil(height / resolution_m)), max(1, math.ceil(width / resolution_m))


def snapped_grid(left: float, bottom: float, right: float, top: float, res: float) -> tuple[float, float, int, int]:
    """(x origin, y origin, width, height) of a grid whose origin is a multiple of the resolution, from projected bounds."""
    x, y = math.floor(left / res) * res, math.ceil(top / res) * res
    return x, y, max(1, math.ceil((right - x) / res)), max(1, math.ceil((y - bottom) / res))


_A, _F = 6378137.0, 1 / 298.257223563
_E2 = _F * (2 - _F)


def to_utm(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """(easting, northing) on WGS84 by the transverse Mercator series; millimetres within a zone."""
    ep2 = _E2 / (1 - _E2)
    phi = F.radians(lat)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(_A) / F.sqrt(1 - F.lit(_E2) * s * s)
    tt, cc = t * t, F.lit(ep2) * c * c
    a = F.radians(lon - F.lit(zone * 6 - 183.0)) * c
    m = F.lit(_A) * (
        (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256) * phi
        - (3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024) * F.sin(2 * phi)
        + (15 * _E2**2 / 256 + 45 * _E2**3 / 1024) * F.sin(4 * phi)
        - (35 * _E2**3 / 3072) * F.sin(6 * phi)
    )
    x = 0.9996 * n * (a + (1 - tt + cc) * F.pow(a, 3) / 6 + (5 - 18 * tt + tt * tt + 72 * cc - 58 * ep2) * F.pow(a, 5) / 120) + 500000.0
    y = 0.9996 * (m + n * t * (a * a / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * F.pow(a, 4) / 24 + (61 - 58 * tt + tt * tt + 600 * cc - 330 * ep2) * F.pow(a, 6) / 720))
    return x, y + F.lit(0.0 if north else 1e7)


def utm_grid(spark: SparkSession, bbox: BBox, epsg: int, res: float) -> tuple[float, float, int, int]:
    """(x origin, y origin, width, height) of the snapped grid of a UTM zone that covers a lon/lat box, whose edges are followed at EDGE points each."""
    if epsg // 100 not in (326, 327):
        raise ValueError(f"EPSG:{epsg} is no UTM zone")
    x0, y0, x1, y1 = bbox
    along = [i / (EDGE - 1) for i in range(EDGE)]
    edge = [(x0 + t * (x1 - x0), y) for t in along for y in (y0, y1)] + [(x, y0 + t * (y1 - y0)) for t in along for x in (x0, x1)]
    x, y = to_utm(F.col("lon"), F.col("lat"), epsg % 100, epsg // 100 == 326)
    projected = spark.createDataFrame(edge, "lon double, lat double").select(x.alias("x"), y.alias("y"))
    return snapped_grid(*projected.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first(), res)


def from_utm(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """(lon, lat) of an easting and northing: the inverse of to_utm."""
    ep2, e1 = _E2 / (1 - _E2), (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    mu = (y - F.lit(0.0 if north else 1e7)) / F.lit(0.9996 * _A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    phi = (
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu)
        + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    w = 1 - F.lit(_E2) * s * s
    n, r = F.lit(_A) / F.sqrt(w), F.lit(_A * (1 - _E2)) / F.pow(w, 1.5)
    tt, cc = t * t, F.lit(ep2) * c * c
    d = (x - 500000.0) / (n * 0.9996)
    lat = phi - (n * t / r) * (d * d / 2 - (5 + 3 * tt + 10 * cc - 4 * cc * cc - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * tt + 298 * cc + 45 * tt * tt - 252 * ep2 - 3 * cc * cc) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * tt + cc) * F.pow(d, 3) / 6 + (5 - 2 * cc + 28 * tt - 3 * cc * cc + 8 * ep2 + 24 * tt * tt) * F.pow(d, 5) / 120) / c
    return F.lit(zone * 6 - 183.0) + F.degrees(lon), F.degrees(lat)


def in_ring(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a closed ring, by crossings of a ray; edges are literals of the plan."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, points[1:], strict=False):
        if y1 == y2:
            continue
        spans = (F.lit(min(y1, y2)) <= y) & (y < F.lit(max(y1, y2)))
        crossings = crossings + (spans & (x < F.lit(x1) + (y - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1)))).cast("int")
    return crossings % 2 == 1
