"""Grids as cells: (cell_id, row, col, dem, gauge, nodata). Parquet is the native form; ASCII and GeoTIFF are read and written."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.levels import NODATA

PIXELS = "row int, col int, z double"
GRID = "width int, height int, transform array<double>, crs string, nodata double"


@dataclass(frozen=True)
class Grid:
    """Affine transform (x = a col + b row + c, y = d col + e row + f), size and CRS."""

    width: int
    height: int
    transform: tuple[float, float, float, float, float, float] | None = None
    crs: str | None = None
    nodata: float | None = NODATA

    def cell_area_m2(self, default: float | None = None) -> float:
        if self.transform is not None:
            return abs(self.transform[0]) * abs(self.transform[4])
        if default is None:
            raise ValueError("the grid has no transform, and no cell area is given")
        return default


def _ascii(data: bytes) -> tuple[dict[str, float], np.ndarray]:
    lines = data.decode("ascii").splitlines()
    head: dict[str, float] = {}
    while lines and lines[0][:1].isalpha():
        key, value = lines.pop(0).split()
        head[key.lower()] = float(value)
    z = np.array(" ".join(lines).split(), np.float64).reshape(int(head["nrows"]), int(head["ncols"]))
    return head, np.where(z == head.get("nodata_value", NODATA), np.nan, z)


def read_ascii(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Pixels of an ESRI ASCII grid; a missing value is null. A file is read by one task, rows flow out in batches."""
    head = {}
    for line in spark.read.text(path).limit(6).collect():
        part = line[0].split()
        if len(part) == 2 and part[0][:1].isalpha():
            head[part[0].lower()] = float(part[1])
    size, height = head["cellsize"], int(head["nrows"])
    grid = Grid(int(head["ncols"]), height, (size, 0.0, head.get("xllcorner", 0.0), 0.0, -size, head.get("yllcorner", 0.0) + size * height), None, head.get("nodata_value", NODATA))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                _, z = _ascii(data.as_py())
                for r in range(0, len(z), 256):
                    part = z[r : r + 256]
                    row, col = np.indices(part.shape, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array((row + r).ravel().astype(np.int32)), pa.array(col.ravel()), pa.array(part.ravel(), mask=np.isnan(part.ravel()))], names=["row", "col", "z"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, PIXELS), grid


def read_geotiff(spark: SparkSession, path: str, band: int = 1) -> tuple[DataFrame, Grid]:
    """Pixels of a GeoTIFF, a task for each strip of rows. Needs rasterio on every machine."""
    import rasterio

    with rasterio.open(path) as src:
        grid = Grid(src.width, src.height, tuple(src.transform)[:6], src.crs and src.crs.to_string(), src.nodata)
    strips = [(r, min(grid.height, r + 512)) for r in range(0, grid.height, 512)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import rasterio
        from rasterio.windows import Window

        with rasterio.open(path) as src:
            for batch in batches:
                for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    z = src.read(band, window=Window(0, a, src.width, b - a)).astype(np.float64)
                    if src.nodata is not None:
                        z[z == src.nodata] = np.nan
                    row, col = np.indices(z.shape, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array((row + a).ravel().astype(np.int32)), pa.array(col.ravel()), pa.array(z.ravel(), mask=np.isnan(z.ravel()))], names=["row", "col", "z"])

    return spark.createDataFrame(strips, "a int, b int").repartition(len(strips), "a").mapInArrow(rows, PIXELS), grid


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_pixels(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """By the file's ending: .asc, .tif, else a Parquet folder of pixels."""
    end = path.lower().rsplit(".", 1)[-1]
    if end == "asc":
        return read_ascii(spark, path)
    if end in ("tif", "tiff"):
        return read_geotiff(spark, path)
    pixels = spark.read.parquet(path)
    if exists(spark, f"{path}.grid"):
        g = spark.read.schema(GRID).json(f"{path}.grid").first()
        return pixels.select("row", "col", F.col("z").cast("double").alias("z")), Grid(g["width"], g["height"], g["transform"] and tuple(g["transform"]), g["crs"], g["nodata"])
    size = pixels.agg(F.max("col") + 1, F.max("row") + 1).first()
    return pixels.select("row", "col", F.col("z").cast("double").alias("z")), Grid(size[0] or 0, size[1] or 0)


def cells(dem: DataFrame, width: int, zones: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Cells of pixel tables (row, col, z). Without zones all belong to gauge 1; a mask adds to the missing cells."""
    out = dem.select((F.col("row").cast("long") * width + F.col("col")).alias("cell_id"), "row", "col", F.col("z").alias("dem"))
    hole = F.col("dem").isNull() | F.isnan("dem")
    if zones is None:
        out = out.withColumn("gauge", F.lit(1))
    else:
        out = out.join(zones.select("row", "col", F.col("z").cast("int").alias("gauge")), ["row", "col"], "left").withColumn("gauge", F.coalesce("gauge", F.lit(0)))
    if mask is not None:
        out = out.join(mask.select("row", "col", F.col("z").alias("mask")), ["row", "col"], "left")
        hole = hole | (F.coalesce("mask", F.lit(0.0)) != 0)
    return out.select("cell_id", "row", "col", "dem", "gauge", hole.alias("nodata"))


def same_shape(a: Grid, b: Grid) -> None:
    if (a.width, a.height) != (b.width, b.height):
        raise ValueError(f"grids differ in size: {a.width} x {a.height} and {b.width} x {b.height}")


def ascii_rows(pixels: DataFrame, value: str, nodata: str = str(int(NODATA)), decimals: int | None = None) -> DataFrame:
    """(row, line) of an ASCII grid."""
    shown = F.col(value).cast("string") if decimals is None else F.format_string(f"%.{decimals}f", F.col(value).cast("double"))
    cell = F.struct("col", F.coalesce(shown, F.lit(nodata)).alias("v"))
    return pixels.groupBy("row").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["v"])).alias("line"))


def write_ascii(pixels: DataFrame, value: str, grid: Grid, path: str, nodata: float = 0, decimals: int | None = None) -> None:
    """One ASCII grid, as a text folder with a single part; pixels must be square."""
    a, _, c, _, e, f = grid.transform or (1.0, 0.0, 0.0, 0.0, -1.0, float(grid.height))
    if abs(abs(a) - abs(e)) > 1e-9 * abs(a):
        raise ValueError("an ASCII grid needs square pixels")
    head = [f"ncols {grid.width}", f"nrows {grid.height}", f"xllcorner {c:.10g}", f"yllcorner {f - abs(e) * grid.height:.10g}", f"cellsize {abs(a):.10g}", f"NODATA_value {nodata:g}"]
    spark = pixels.sparkSession
    first = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "row int, line string")
    every = first.unionByName(ascii_rows(pixels, value, f"{nodata:g}", decimals).select(F.col("row").cast("int").alias("row"), "line"))
    every.repartitionByRange(1, "row").sortWithinPartitions("row").select("line").write.mode("overwrite").text(path)


def write_geotiff(pixels: DataFrame, value: str, grid: Grid, path: str, dtype: str = "float32", nodata: float = NODATA) -> None:
    """A GeoTIFF, written on the driver strip by strip; needs rasterio and a transform."""
    import rasterio
    from rasterio.transform import Affine
    from rasterio.windows import Window

    profile = {"driver": "GTiff", "width": grid.width, "height": grid.height, "count": 1, "dtype": dtype, "nodata": nodata, "crs": grid.crs, "transform": Affine(*grid.transform), "compress": "lzw"}
    rows = pixels.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", F.col(value).cast("double").alias("v")))).alias("x")).orderBy("row")
    with rasterio.open(path, "w", **profile) as dst:
        for r in rows.toLocalIterator():
            line = np.full((1, grid.width), nodata, dtype)
            for x in r["x"]:
                line[0, x["col"]] = nodata if x["v"] is None else x["v"]
            dst.write(line, 1, window=Window(0, r["row"], grid.width, 1))


def write_pixels(pixels: DataFrame, value: str, grid: Grid, path: str) -> None:
    """By the file's ending, like read_pixels; beside a Parquet folder stands its grid."""
    end = path.lower().rsplit(".", 1)[-1]
    if end == "asc":
        write_ascii(pixels, value, grid, path, NODATA)
    elif end in ("tif", "tiff"):
        write_geotiff(pixels, value, grid, path)
    else:
        pixels.select("row", "col", F.col(value).cast("double").alias("z")).write.mode("overwrite").parquet(path)
        beside = [(grid.width, grid.height, grid.transform and list(grid.transform), grid.crs, grid.nodata)]
        pixels.sparkSession.createDataFrame(beside, GRID).coalesce(1).write.mode("overwrite").json(f"{path}.grid")


def synthetic(spark: SparkSession, rows: int = 60, columns: int = 90, days: int = 3, interval: int = 6, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(cells, records) of a ramp from -1 to 1 m with hashed noise and a missing corner, and a tide of two periods."""
    n = F.col("id")
    row, col = F.expr(f"cast(id div {columns} as int)"), (n % columns).cast("int")
    noise = (F.pmod(F.xxhash64(n, F.lit(seed)), F.lit(2001)) / F.lit(1000.0) - 1.0) * 0.05
    dem = F.lit(-1.0) + col * F.lit(2.0 / max(1, columns - 1)) + noise
    corner = (row < 5) & (col < 5)
    grid = spark.range(rows * columns).select(n.alias("cell_id"), row.alias("row"), col.alias("col"), F.when(~corner, dem).alias("dem"), F.lit(1).alias("gauge"), corner.alias("nodata"))
    hours = n * F.lit(interval / 60.0)
    wave = lambda period: F.sin(F.lit(2 * np.pi / period) * hours)
    levels = spark.range(days * 1440 // interval).select(F.lit(1).alias("gauge"), n.cast("int").alias("rec"), (0.45 * wave(12.42) + 0.20 * wave(24.07)).alias("level"))
    return grid, levels
