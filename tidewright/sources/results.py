"""Results: metrics as partitioned Parquet, their names, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.levels import FLAG_NODATA, NODATA, area_flag, day_average, filled, slug_of, threshold_slug_of
from tidewright.sources.grids import Grid, write_ascii, write_geotiff

TYPES = {"float32": "float", "float64": "double", "int16": "short", "int32": "int"}
CODECS = {"lzw": "snappy", "deflate": "gzip", "zstd": "zstd", "none": "uncompressed"}


def metric_names(run_id: str, windows: list[str], thresholds: list[float]) -> dict[tuple[str, str | float], str]:
    """The name of each output of a run."""
    out: dict[tuple[str, str | float], str] = {}
    for w in windows:
        for kind, word in (("time_integrated", "time_integrated_min"), ("time_average", "time_average_min_per_day"), ("area_available", "area_available_bin")):
            out[kind, w] = f"{run_id}__{word}__{slug_of(w)}"
    for t in thresholds:
        for kind, word in (("refugia_time", "refugia_time_min"), ("refugia_average", "refugia_average_min_per_day")):
            out[kind, float(t)] = f"{run_id}__{word}__thr_{threshold_slug_of(t)}"
    out["never_submerged", ""] = f"{run_id}__never_submerged_bin"
    return out


def long_metrics(cells: DataFrame, minutes: DataFrame, run_id: str, windows: list[str], thresholds: list[float], n_days: int, total: bool = True, average: bool = False) -> DataFrame:
    """(run_id, metric, key, cell_id, row, col, value): one row a metric and cell, no-data filled."""
    if not (total or average):
        raise ValueError("neither totals nor averages are asked for")
    parts = []
    for w in windows:
        m = F.col(f"win_{w}")
        parts += [("time_integrated", w, m.cast("double"), NODATA)] * total + [("time_average", w, day_average(m, n_days), NODATA)] * average
        parts.append(("area_available", w, area_flag(m).cast("double"), float(FLAG_NODATA)))
    for t in thresholds:
        m = F.col(f"ref_{threshold_slug_of(t)}")
        parts += [("refugia_time", f"{t:g}", m.cast("double"), NODATA)] * total + [("refugia_average", f"{t:g}", day_average(m, n_days), NODATA)] * average
    parts.append(("never_submerged", "", F.col("never_submerged").cast("double"), float(FLAG_NODATA)))
    joined = cells.select("cell_id", "row", "col").join(minutes, "cell_id", "left").withColumn("valid", F.col("never_submerged").isNotNull())
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("key"), filled(v, F.col("valid"), n).alias("value")) for m, k, v, n in parts])
    return joined.select("cell_id", "row", "col", F.explode(rows).alias("x")).select(F.lit(run_id).alias("run_id"), "x.metric", "x.key", "cell_id", "row", "col", "x.value")


def write_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    """A run's metrics in a folder of its own: other runs at the path stay, and nothing of an earlier run of that id does."""
    metrics.drop("run_id").write.mode("overwrite").partitionBy("metric", "key").parquet(f"{path}/run_id={run_id}")


def read_metrics(spark: SparkSession, path: str, run_id: str, windows: list[str], thresholds: list[float]) -> DataFrame:
    """(cell_id, minutes by test) of a run, for its summary; no-data counts as 0. Only the totals' folders are read."""
    rows = spark.read.option("basePath", path).parquet(path).filter((F.col("run_id") == run_id) & F.col("metric").isin("time_integrated", "refugia_time"))
    value = F.when(F.col("value") != NODATA, F.col("value")).otherwise(F.lit(0.0))
    out = [F.coalesce(F.max(F.when((F.col("metric") == "time_integrated") & (F.col("key") == w), value)), F.lit(0.0)).cast("long").alias(f"win_{w}") for w in windows]
    out += [F.coalesce(F.max(F.when((F.col("metric") == "refugia_time") & (F.abs(F.col("key").cast("double") - t) < 1e-9), value)), F.lit(0.0)).cast("long").alias(f"ref_{threshold_slug_of(t)}") for t in thresholds]
    return rows.groupBy("cell_id").agg(*out)


def has_run(spark: SparkSession, path: str, run_id: str, windows: list[str], thresholds: list[float], average: bool = False, total: bool = True) -> bool:
    """Whether all that a run writes is there."""
    jvm = spark.sparkContext._jvm
    wanted = [("area_available", w) for w in windows]
    if total:
        wanted += [("time_integrated", w) for w in windows] + [("refugia_time", f"{t:g}") for t in thresholds]
    if average:
        wanted += [("time_average", w) for w in windows] + [("refugia_average", f"{t:g}") for t in thresholds]
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return all(fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run_id}/metric={m}/key={k}")) for m, k in wanted)


def daily_columns(windows: list[str], thresholds: list[float], metrics: list[str] | None = None) -> list[str]:
    """The columns of daily minutes that metrics names, all without; names are columns or outputs (time_integrated__, refugia_time__thr_)."""
    known = {f"time_integrated__{slug_of(w)}": f"win_{w}" for w in windows} | {f"refugia_time__thr_{threshold_slug_of(t)}": f"ref_{threshold_slug_of(t)}" for t in thresholds}
    return [c for name, c in known.items() if not metrics or name in metrics or c in metrics]


def write_daily(daily: DataFrame, path: str, day_offset: int = 0, metrics: list[str] | None = None, dtype: str | None = None, compress: str | None = None) -> None:
    """Minutes by day in a folder a day; metrics picks columns, dtype is their type, compress the files' (of a kind Parquet has)."""
    chosen = [c for c in daily.columns if c not in ("cell_id", "day")] if metrics is None else metrics
    values = [F.col(f"`{c}`").cast(TYPES[dtype]).alias(c) if dtype in TYPES else F.col(f"`{c}`") for c in chosen]
    writer = daily.select("cell_id", (F.col("day") + day_offset).alias("day"), *values).write.mode("overwrite").partitionBy("day")
    if compress in CODECS:
        writer = writer.option("compression", CODECS[compress])
    writer.parquet(path)


def export_rasters(metrics: DataFrame, grid: Grid, folder: str, names: dict[tuple[str, str | float], str], form: str = "asc") -> list[str]:
    """One raster a metric, as `asc` or `tif`, under the outputs' names; the paths written. metrics is long_metrics of one run."""
    out = []
    for (metric, key), name in names.items():
        shown = f"{key:g}" if isinstance(key, float) else key
        one = metrics.filter((F.col("metric") == metric) & (F.col("key") == shown))
        flag = metric in ("area_available", "never_submerged")
        if one.isEmpty():
            continue
        out.append(f"{folder}/{name}.{form}")
        if form == "tif":
            write_geotiff(one, "value", grid, out[-1], "uint8" if flag else "float32", FLAG_NODATA if flag else NODATA)
        else:
            write_ascii(one, "value", grid, out[-1], FLAG_NODATA if flag else NODATA)
    return out
