"""A run: inputs and settings to minutes by cell, summaries and daily results, all as DataFrames."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import duration, series, summary
from tidewright.plans.config import BOUNDS, RunConfig


ABOUT = "run_id string, n_days int, cell_area_m2 double, metadata map<string,string>"


@dataclass
class Inputs:
    """Cells (cell_id, row, col, dem, gauge, nodata) and records (gauge, rec, level) of an interval in minutes."""

    cells: DataFrame
    records: DataFrame
    interval: int

    def __post_init__(self) -> None:
        if self.interval < 1 or 1440 % self.interval:
            raise ValueError(f"an interval of {self.interval} min does not divide a day")
        for table, columns in ((self.cells, ("cell_id", "dem", "gauge", "nodata")), (self.records, ("gauge", "rec", "level"))):
            if missing := [c for c in columns if c not in table.columns]:
                raise ValueError(f"columns are missing: {', '.join(missing)}")


@dataclass
class Settings:
    windows: dict[str, tuple[float, float]] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    timestep: int = 1
    method: str = "linear"
    mode: str = "direct"
    gaps: str = "hold"
    offset: float = 0.0
    daylight: DataFrame | None = None
    daylight_bounds: str = "inclusive"
    first_day: int = 0
    plan: str = "auto"
    #: Deprecated name of offset.
    slr_offset_m: float | None = None

    def __post_init__(self) -> None:
        if self.slr_offset_m is not None:
            warnings.warn("slr_offset_m is deprecated; say offset", DeprecationWarning, stacklevel=3)
            if self.offset:
                raise ValueError("offset and its deprecated name are both given")
            self.offset = float(self.slr_offset_m)
        if self.timestep < 1 or 1440 % self.timestep:
            raise ValueError(f"a timestep of {self.timestep} min does not divide a day")
        for value, allowed in ((self.method, series.METHODS), (self.mode, series.MODES), (self.gaps, series.POLICIES), (self.daylight_bounds, BOUNDS)):
            if value not in allowed:
                raise ValueError(f"{value} is none of {', '.join(allowed)}")
        if any(t <= 0 for t in self.thresholds) or any(lo > hi for lo, hi in self.windows.values()):
            raise ValueError("thresholds must be above zero, and bounds of windows in order")
        if any(lo >= 0 for lo, _ in self.windows.values()):
            warnings.warn("a window lies above the water: positive depths are dry", stacklevel=3)

    @classmethod
    def of(cls, config: RunConfig, daylight: DataFrame | None = None) -> Settings:
        s, first = config.simulation, config.dates()
        day = (first[0] - first[0].replace(month=1, day=1)).days if first else 0
        return cls(config.windows, config.thresholds, s.timestep_min, s.gauge_interp, s.surface_update, s.gap_policy, s.water_level_offset_m, daylight if s.constrain_daylight else None, s.daylight_bounds, day, s.plan)


@dataclass
class Result:
    """What a run gives: minutes by cell, the long summary, and what they were made with."""

    run_id: str
    minutes: DataFrame
    summary: DataFrame
    n_days: int
    cell_area_m2: float
    metadata: dict[str, str] = field(default_factory=dict)

    def save(self, path: str) -> None:
        """Below path in a folder of the run's own."""
        to = f"{path}/{self.run_id}"
        self.minutes.write.mode("overwrite").parquet(f"{to}/minutes")
        self.summary.coalesce(1).write.mode("overwrite").parquet(f"{to}/summary")
        about = [(self.run_id, self.n_days, self.cell_area_m2, self.metadata)]
        self.minutes.sparkSession.createDataFrame(about, ABOUT).coalesce(1).write.mode("overwrite").json(f"{to}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str, run_id: str) -> Result:
        at = f"{path}/{run_id}"
        about = spark.read.schema(ABOUT).json(f"{at}/about").first()
        return cls(run_id, spark.read.parquet(f"{at}/minutes"), spark.read.parquet(f"{at}/summary"), about["n_days"], about["cell_area_m2"], about["metadata"] or {})


class Run:
    """Lazy until a result is read. The series is small (a row a gauge and step) and is kept once made."""

    def __init__(self, inputs: Inputs, settings: Settings, run_id: str = "run", cell_area_m2: float = 900.0, metadata: dict[str, str] | None = None) -> None:
        self.inputs, self.settings, self.run_id, self.cell_area_m2, self.metadata = inputs, settings, run_id, cell_area_m2, metadata or {}
        duration.check_gauges(inputs.cells, inputs.records)
        if self.n_days < 1:
            raise ValueError("the records do not cover a whole day")

    @cached_property
    def series(self) -> DataFrame:
        s = self.settings
        shifted = series.shifted(self.inputs.records, s.offset) if s.offset else self.inputs.records
        return series.surface(series.resample(shifted, self.inputs.interval, s.timestep, s.method), s.mode, s.gaps).persist()

    @cached_property
    def n_days(self) -> int:
        return int(self.series.agg(F.max("step")).first()[0] + 1) * self.settings.timestep // 1440

    @cached_property
    def _daylight(self) -> DataFrame | None:
        table = self.settings.daylight
        return None if table is None else table.select((F.col("day") - self.settings.first_day).alias("day"), "sunrise", "sunset")

    def _options(self) -> dict:
        return {"daylight": self._daylight, "exclusive": self.settings.daylight_bounds == "exclusive", "plan": self.settings.plan}

    @cached_property
    def minutes(self) -> DataFrame:
        """(cell_id, gauge, dem, never_submerged, minutes by test) of every usable cell."""
        s = self.settings
        return duration.inundation(self.inputs.cells, self.series, s.windows, s.thresholds, s.timestep, **self._options())

    def daily(self) -> DataFrame:
        """(cell_id, day, minutes by test) of cells that a step can satisfy."""
        s = self.settings
        return duration.inundation(self.inputs.cells, self.series, s.windows, s.thresholds, s.timestep, by_day=True, **self._options())

    def each_day(self, callback: Callable[[int, DataFrame], None]) -> int:
        """Call back with every day's number (as written, from the first day on) and its minutes, in order; the number of days.

        Days are made together, once, and kept while they are handed out.
        """
        daily = self.daily().persist()
        try:
            for day in range(self.n_days):
                callback(day + self.settings.first_day, daily.filter(F.col("day") == day).drop("day"))
        finally:
            daily.unpersist()
        return self.n_days

    def result(self) -> Result:
        return Result(self.run_id, self.minutes, self.summary(), self.n_days, self.cell_area_m2, self.metadata)

    def summary(self) -> DataFrame:
        s = self.settings
        row = summary.totals(self.minutes, list(s.windows), s.thresholds, self.cell_area_m2)
        return summary.long_form(row, self.run_id, list(s.windows), s.thresholds, self.metadata)

    def counters(self) -> DataFrame:
        base = duration.usable(self.inputs.cells)
        flags = duration.prune(base, series.extremes(self.series), self.settings.windows, self.settings.thresholds)
        return summary.run_counters(self.inputs.cells, flags)

    def describe(self) -> str:
        c = self.counters().first()
        return f"{self.run_id}: {c['cells']} cells, {c['base']} usable, {c['pruned']} pruned, {c['never_submerged']} never under water; {self.n_days} days of {self.settings.timestep} min"
