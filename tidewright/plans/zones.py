"""Gauge zones of a grid: drawn, kept beside the list of gauges they were drawn for, and drawn again when that changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.geo import pixel_x, to_utm
from tidewright.operators import stations
from tidewright.sources.grids import Grid, write_pixels


def utm_sites(table: DataFrame, epsg: str) -> DataFrame:
    """(gauge, x, y) of stations (gauge_idx, lon, lat) in a UTM zone; gauges count from 1."""
    code = int(epsg.rsplit(":", 1)[-1])
    if code // 100 not in (326, 327):
        raise ValueError(f"{epsg} is no UTM zone")
    x, y = to_utm(F.col("lon"), F.col("lat"), code % 100, code // 100 == 326)
    return table.select((F.col("gauge_idx") + 1).alias("gauge"), x.alias("x"), y.alias("y"))


def draw_zones(cells: DataFrame, grid: Grid, table: DataFrame, epsg: str) -> DataFrame:
    """Cells with the number of the nearest gauge, 0 where there is no data."""
    if grid.transform is None:
        raise ValueError("zones need a grid with a transform")
    a, b, c, d, e, f = grid.transform
    x, y = pixel_x(F.col("col"), F.col("row"), a, b, c), pixel_x(F.col("col"), F.col("row"), d, e, f)
    return stations.nearest_gauge(cells, utm_sites(table, epsg), x, y, F.col("nodata"))


def write_zones(zones: DataFrame, table: DataFrame, path: str, grid: Grid) -> None:
    """Pixels (row, col, z) in the form that the path's ending names, and the gauges beside them, with their places and offsets."""
    write_pixels(zones.select("row", "col", F.col("gauge").cast("double").alias("z")), "z", grid, path)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}.stations")


def kept_gauges(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The gauges that the zones at a path were drawn for, if any are."""
    if not path:
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.stations")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(f"{path}.stations") if there else None


def zones_current(spark: SparkSession, path: str, table: DataFrame) -> bool:
    """Whether zones were drawn for just these gauges."""
    kept = kept_gauges(spark, path)
    return kept is not None and stations.zones_match(kept, table)
