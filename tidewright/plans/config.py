"""Run configuration: parsed from YAML or a dict, checked, and turned into a simulation's settings."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields
from datetime import date, datetime
from pathlib import Path

from tidewright.operators.series import METHODS, MODES, POLICIES
from tidewright.plans.domain import Domain

SOURCES, BOUNDS = ("coops", "prescribed", "hybrid"), ("inclusive", "exclusive")
SECTIONS = ("domain", "gauges", "simulation", "depth_windows", "refugia_thresholds", "output")
NOTHING = (None, "", "null", "none", "None")


class ConfigError(ValueError):
    """A configuration that cannot be run."""


# The keys of the configuration file and their defaults, which existing files rely on.


@dataclass
class Gauges:
    source: str = "coops"
    prescribed_file: str | None = None
    time_col: str | None = "time"
    record_interval_min: int | None = None
    fill_gaps: str = "hold"
    max_gap_records: int | None = None
    value_scale: float = 1.0
    station_order: list[str] | None = None
    datum_offsets: dict[str, float] | None = None
    has_header: bool | None = None
    sensor_meta_csv: str | None = None
    stations_csv: str | None = None
    datum: str = "MLLW"
    year: int | None = None
    start: date | None = None
    end: date | None = None
    min_obs_coverage_pct: float = 80.0
    cache_dir: str = "cache/coops"
    vdatum_csv: str | None = None
    vdatum_idw_fill: bool = True
    vdatum_idw_power: float = 2.0
    vdatum_idw_k: int | None = None
    hilo_interp: str = "sinusoidal"


@dataclass
class Simulation:
    timestep_min: int = 1
    gauge_interp: str = "linear"
    surface_update: str = "direct"
    gap_policy: str = "hold"
    constrain_daylight: bool = False
    daylight_bounds: str = "inclusive"
    daylight_table: str | None = None
    water_level_offset_m: float = 0.0
    cell_chunk: int | str = "auto"
    chunk_mem_mb: float = 256.0
    plan: str = "auto"


@dataclass
class Output:
    root: str = "outputs"
    rasters: str | None = None
    summaries: str | None = None
    run_id: str = "run"
    write_annual: bool = True
    write_total: bool = True
    write_average: bool = False
    write_daily: bool = False
    daily_dtype: str = "float32"
    daily_compress: str = "lzw"
    daily_metrics: list[str] | None = None

    def __post_init__(self) -> None:
        self.rasters = self.rasters or f"{self.root}/rasters"
        self.summaries = self.summaries or f"{self.root}/summaries"


def as_date(value: object) -> date | None:
    if value in NOTHING:
        return None
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else date.fromisoformat(str(value))


def _typed(kind: str, value: object) -> object:
    """A value as a field's annotation says; the ways of writing nothing are None."""
    optional = "None" in kind
    if optional and value in NOTHING:
        return None
    base = kind.split(" | ")[0]
    if base == "date":
        return as_date(value)
    if base in ("int", "float", "bool", "str"):
        return {"int": int, "float": float, "bool": bool, "str": str}[base](value)
    return value


def section(cls: type, raw: dict | None) -> object:
    """A section's dataclass from its dict; keys that are no fields are left to the caller."""
    raw = raw or {}
    return cls(**{f.name: _typed(str(f.type), raw[f.name]) for f in fields(cls) if f.name in raw and f.name != "cell_chunk"})


def windows_of(raw: dict | None) -> dict[str, tuple[float, float]]:
    out: dict[str, tuple[float, float]] = {}
    for name, pair in (raw or {}).items():
        if name == "refugia_thresholds":  # an older place for these
            continue
        if not isinstance(pair, (list, tuple)) or len(pair) != 2:
            raise ConfigError(f"depth window {name} needs a low and a high bound")
        low, high = map(float, pair)
        if low > high:
            raise ConfigError(f"depth window {name}: {low:g} is above {high:g}")
        out[str(name)] = low, high
    return out


def thresholds_of(raw: list | None, windows: object) -> list[float]:
    if raw is None and isinstance(windows, dict):
        raw = windows.get("refugia_thresholds")
    out = [float(t) for t in raw or []]
    if any(t <= 0 for t in out):
        raise ConfigError("refuge thresholds are depths of water and must be above zero")
    return out


@dataclass
class RunConfig:
    domain: Domain
    gauges: Gauges
    simulation: Simulation
    output: Output
    windows: dict[str, tuple[float, float]]
    thresholds: list[float]
    dem_path: str | None = None
    zones_path: str | None = None
    mask_path: str | None = None
    target_crs: str | None = None
    path: str | None = None
    unknown: list[str] = field(default_factory=list)

    @classmethod
    def from_yaml(cls, path: str | Path) -> RunConfig:
        import yaml

        if not Path(path).exists():
            raise ConfigError(f"there is no configuration {path}")
        out = cls.from_dict(yaml.safe_load(Path(path).read_text()) or {})
        out.path = str(path)
        return out

    @classmethod
    def from_dict(cls, raw: dict) -> RunConfig:
        if "domain" not in raw:
            raise ConfigError("the configuration has no domain")
        area, sim = dict(raw["domain"]), dict(raw.get("simulation") or {})
        settings = section(Simulation, sim)
        if "daylight_bounds" not in sim and "daylight_bounds_exclusive" in sim:  # the older spelling
            settings.daylight_bounds = BOUNDS[bool(sim["daylight_bounds_exclusive"])]
        chunk = sim.get("cell_chunk", "auto")
        settings.cell_chunk = "auto" if chunk in NOTHING or str(chunk).lower() == "auto" else int(chunk)
        paths = [None if area.get(k) in NOTHING else str(area[k]) for k in ("dem_path", "gauge_zones_path", "land_mask_path")]
        out = cls(
            Domain.from_dict(area), section(Gauges, raw.get("gauges")), settings, section(Output, raw.get("output")),
            windows_of(raw.get("depth_windows")), thresholds_of(raw.get("refugia_thresholds"), raw.get("depth_windows")),
            *paths, target_crs=area.get("crs") or None, unknown=[str(k) for k in raw if k not in SECTIONS],
        )
        out.check()
        return out

    def check(self) -> None:
        s, g = self.simulation, self.gauges
        if s.timestep_min < 1 or 1440 % s.timestep_min:
            raise ConfigError(f"a timestep of {s.timestep_min} min does not divide a day")
        for value, allowed, what in ((s.gauge_interp, METHODS, "interpolation"), (s.surface_update, MODES, "surface rule"), (s.gap_policy, POLICIES, "gap rule"), (s.daylight_bounds, BOUNDS, "daylight bounds"), (g.source, SOURCES, "gauge source"), (g.fill_gaps, ("hold", "interpolate", "nan"), "filling"), (g.hilo_interp, METHODS, "interpolation of high and low waters")):
            if value not in allowed:
                raise ConfigError(f"unknown {what}: {value}; choose from {', '.join(allowed)}")
        if g.source != "coops":
            if g.prescribed_file is None:
                raise ConfigError(f"source {g.source} needs a prescribed_file")
            if g.time_col is None and g.record_interval_min is None:
                raise ConfigError("without a time column, record_interval_min is needed")
        if g.source != "prescribed":
            if g.year is None:
                raise ConfigError(f"source {g.source} needs a year")
            if any(d is not None and d.year != g.year for d in (g.start, g.end)):
                raise ConfigError(f"start and end must lie in {g.year}")
            if g.start and g.end and g.end < g.start:
                raise ConfigError("end lies before start")
        if g.source == "hybrid" and g.sensor_meta_csv is None:
            raise ConfigError("source hybrid needs sensor_meta_csv, the places of the sensors")
        if not self.windows and not self.thresholds:
            raise ConfigError("no depth window and no refuge threshold is asked for")
        if not self.output.write_total and not self.output.write_average and self.output.write_annual:
            raise ConfigError("neither totals nor averages are asked for")
        for name, (low, _) in self.windows.items():
            if low >= 0:
                warnings.warn(f"window {name} lies above the water: positive depths are dry", stacklevel=3)

    def dates(self) -> tuple[date, date] | None:
        """First and last day of the run, where the year is known."""
        g = self.gauges
        if g.year is None:
            return None
        return g.start or date(g.year, 1, 1), g.end or date(g.year, 12, 31)

    def n_days(self) -> int | None:
        if self.gauges.source == "prescribed" or self.dates() is None:
            return None
        first, last = self.dates()
        return (last - first).days + 1

    def report(self) -> str:
        s, g = self.simulation, self.gauges
        lines = [
            f"run        {self.output.run_id}",
            f"domain     {self.domain.name} {tuple(round(x, 4) for x in self.domain.bbox)} ({self.domain.source})",
            f"gauges     {g.source}" + (f", {self.dates()[0]} to {self.dates()[1]}" if self.dates() else ""),
            f"steps      {s.timestep_min} min, {s.gauge_interp}, {s.surface_update}, gaps {s.gap_policy}",
            f"daylight   {s.daylight_bounds if s.constrain_daylight else 'not considered'}",
            *(f"window     {n}: {lo:g} to {hi:g} m" for n, (lo, hi) in self.windows.items()),
            *(f"refuge     {t:g} m" for t in self.thresholds),
            *(f"ignored    {k}" for k in self.unknown),
        ]
        return "\n".join(lines)
