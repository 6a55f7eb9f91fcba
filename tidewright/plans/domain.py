"""The area of a run: a box, a circle or a boundary."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from tidewright.functions.geo import BBox, bbox_around, grow, ring, utm_of
from tidewright.operators import stations

LONLAT = {"EPSG:4326", "WGS84", "OGC:CRS84"}
WIDE_DEGREES, BUFFER_KM = 80.0, 10.0


class DomainError(ValueError):
    """A domain that is not given properly."""


@dataclass(frozen=True)
class Domain:
    name: str
    bbox: BBox
    ring: tuple[tuple[float, float], ...] | None = None
    buffer_km: float = BUFFER_KM
    resolution_m: float | None = None
    source: str = "bbox"
    extra: dict = field(default_factory=dict, compare=False)

    @classmethod
    def from_dict(cls, raw: dict) -> Domain:
        """From exactly one of bbox, boundary_file, or center with radius_km (shape: box or circle)."""
        raw = raw.get("domain", raw)
        given = [k for k in ("bbox", "boundary_file", "center") if raw.get(k) is not None]
        if len(given) != 1:
            raise DomainError(f"give one of bbox, boundary_file and center; there are {len(given)}")
        shared = {
            "name": str(raw.get("name") or "domain"),
            "buffer_km": float(raw.get("gauge_search_buffer_km", BUFFER_KM)),
            "resolution_m": None if raw.get("resolution_m") is None else float(raw["resolution_m"]),
            "extra": dict(raw),
        }
        if given == ["center"]:
            return cls._around(raw, shared)
        if given == ["bbox"]:
            box = tuple(float(x) for x in raw["bbox"])
            crs = str(raw.get("bbox_crs") or "EPSG:4326").upper()
            if crs not in LONLAT:
                box = reprojected(box, crs)
            return cls(bbox=checked(box), source="bbox", **shared)
        points = boundary(Path(raw["boundary_file"]))
        xs, ys = zip(*points, strict=True)
        return cls(bbox=checked((min(xs), min(ys), max(xs), max(ys))), ring=tuple(points), source=str(raw["boundary_file"]), **shared)

    @classmethod
    def _around(cls, raw: dict, shared: dict) -> Domain:
        at, km, shape = raw["center"], raw.get("radius_km"), str(raw.get("shape", "box")).lower()
        if not isinstance(at, (list, tuple)) or len(at) != 2:
            raise DomainError("center must be a pair of longitude and latitude")
        if km is None or float(km) <= 0:
            raise DomainError("center needs a radius_km above zero")
        if shape not in ("box", "circle"):
            raise DomainError(f"unknown shape: {shape}")
        lon, lat, km = float(at[0]), float(at[1]), float(km)
        edge = tuple(ring(lon, lat, km)) if shape == "circle" else None
        return cls(bbox=checked(bbox_around(lon, lat, km)), ring=edge, source=f"center and radius, {shape}", **shared)

    @property
    def centroid(self) -> tuple[float, float]:
        return (self.bbox[0] + self.bbox[2]) / 2, (self.bbox[1] + self.bbox[3]) / 2

    @property
    def utm(self) -> str:
        return utm_of(*self.centroid)

    def buffered(self, km: float | None = None) -> BBox:
        return grow(self.bbox, self.buffer_km if km is None else km)

    def filter(self, points: DataFrame, min_stations: int = 0, buffer_km: float | None = None, use_ring: bool = False) -> DataFrame:
        km = self.buffer_km if buffer_km is None else buffer_km
        return stations.at_least(stations.within(points, self.bbox, km, list(self.ring) if use_ring and self.ring else None), min_stations)

    @property
    def key(self) -> str:
        """The domain as part of a cache's name."""
        return "_".join([self.name.strip().replace(" ", "_"), *(f"{x:.4f}" for x in self.bbox)])

    def to_dict(self) -> dict:
        return {"name": self.name, "bbox": list(self.bbox), "buffer_km": self.buffer_km, "resolution_m": self.resolution_m, "source": self.source, "circle_or_boundary": self.ring is not None}


def checked(box: tuple[float, ...]) -> BBox:
    if len(box) != 4:
        raise DomainError("a box has four numbers: west, south, east, north")
    x0, y0, x1, y1 = box
    if x0 >= x1 or y0 >= y1:
        raise DomainError(f"the box's corners are in the wrong order: {box}")
    if not (-180 <= x0 and x1 <= 180 and -90 <= y0 and y1 <= 90):
        raise DomainError(f"the box is not in degrees: {box}")
    if max(abs(y0), abs(y1)) > WIDE_DEGREES:
        warnings.warn(f"the box reaches beyond {WIDE_DEGREES:g} degrees of latitude, where lengths of degrees are rough", stacklevel=3)
    return x0, y0, x1, y1


def reprojected(box: tuple[float, ...], crs: str) -> tuple[float, ...]:
    """Corners in longitude and latitude; needs pyproj."""
    from pyproj import Transformer

    to = Transformer.from_crs(crs, "EPSG:4326", always_xy=True)
    xs, ys = zip(*(to.transform(x, y) for x in box[::2] for y in box[1::2]), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def boundary(path: Path) -> list[tuple[float, float]]:
    """Outer ring of a boundary: GeoJSON as it is, other formats through geopandas, dissolved and in degrees."""
    if not path.exists():
        raise DomainError(f"there is no boundary file {path}")
    if path.suffix.lower() in (".geojson", ".json"):
        geometry = json.loads(path.read_text())
        while geometry.get("type") in ("FeatureCollection", "Feature"):
            if geometry["type"] == "FeatureCollection" and len(geometry["features"]) != 1:
                break
            geometry = geometry["features"][0] if geometry["type"] == "FeatureCollection" else geometry["geometry"]
        if geometry.get("type") == "Polygon":
            return [(float(p[0]), float(p[1])) for p in geometry["coordinates"][0]]
    import geopandas

    shape = geopandas.read_file(path).to_crs("EPSG:4326").union_all()
    return [(x, y) for x, y in shape.convex_hull.exterior.coords] if shape.geom_type != "Polygon" else list(shape.exterior.coords)


def target_crs(domain: Domain, explicit: str | None = None) -> str:
    """The CRS that is asked for, else the UTM zone of the middle; a domain over several zones warns."""
    if explicit:
        return explicit
    zones = [int(utm_of(x, domain.centroid[1])[-2:]) for x in (domain.bbox[0], domain.bbox[2])]
    if zones[1] - zones[0] >= 2:
        warnings.warn(f"the domain spans UTM zones {zones[0]} to {zones[1]}; distances at its edges are distorted", stacklevel=2)
    return domain.utm
