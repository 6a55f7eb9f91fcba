"""Elevation tiles: listings, regions, overlap and mosaic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.geo import BBox, from_utm
from tidewright.functions.text import INDEX, MEGABYTES, TILE_DEGREES, anchors, tile

class TileError(ValueError):
    """No tile, or none that can be read, where one is needed."""


BOX = "xmin double, ymin double, xmax double, ymax double"

# Rough extents of the listing's folders (west, south, east, north).
REGIONS = {
    "AK": (-180.0, 50.0, -129.0, 72.0),
    "AL_nwFL": (-88.6, 29.5, -84.0, 31.1),
    "CA": (-125.0, 32.4, -117.0, 42.1),
    "FL": (-84.5, 24.2, -79.8, 31.2),
    "LA_MS": (-94.1, 28.6, -88.0, 31.1),
    "MA_NH_ME": (-73.6, 41.0, -66.8, 45.3),
    "NC": (-78.6, 33.7, -75.4, 36.6),
    "OR": (-124.7, 41.9, -123.2, 46.3),
    "TX": (-97.4, 25.8, -93.5, 30.1),
    "chesapeake_bay": (-77.5, 36.8, -75.5, 39.7),
    "columbia_river": (-124.2, 45.5, -122.0, 46.3),
    "northeast_sandy": (-75.9, 38.3, -71.5, 41.6),
    "rima": (-71.9, 41.0, -69.8, 42.9),
    "southeast": (-82.0, 30.3, -78.5, 34.0),
    "wash_bellingham": (-123.0, 48.5, -122.2, 49.0),
    "wash_juandefuca": (-124.9, 47.9, -122.5, 48.6),
    "wash_outercoast": (-124.9, 46.2, -123.8, 48.5),
    "wash_pugetsound": (-123.3, 47.0, -122.0, 48.6),
}
# Datum regions; the first that holds a point wins, and DEFAULT_DATUM where none does.
DATUM_REGIONS = (
    ("ak", (-180.0, 50.0, -129.0, 72.0)),
    ("as", (-172.0, -16.0, -168.0, -13.0)),
    ("gcnmi", (144.0, 13.0, 146.5, 21.0)),
    ("prvi", (-68.0, 17.0, -64.0, 19.0)),
    ("westcoast", (-180.0, 18.0, -154.0, 23.0)),
    ("contiguous", (-128.0, 23.0, -65.0, 50.0)),
)
DEFAULT_DATUM = "contiguous"


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in REGIONS.items()], f"region string, {BOX}")


def datum_regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, *v) for i, (k, v) in enumerate(DATUM_REGIONS)], f"rank int, region string, {BOX}")


def overlaps(xmin: Column, ymin: Column, xmax: Column, ymax: Column, box: BBox) -> Column:
    """Boxes that share more than an edge."""
    return (xmin < box[2]) & (xmax > box[0]) & (ymin < box[3]) & (ymax > box[1])


def regions_for(spark: SparkSession, box: BBox, listed: DataFrame | None = None) -> DataFrame:
    """Regions that overlap a box; with a listing (region), those it has, as it spells them."""
    found = regions(spark).filter(overlaps(*map(F.col, ("xmin", "ymin", "xmax", "ymax")), box)).select("region")
    if listed is None:
        return found
    return listed.select(F.col("region").alias("listed")).join(found, F.upper("listed") == F.upper("region"), "left_semi").select(F.col("listed").alias("region"))


def datum_region(lon: Column, lat: Column) -> Column:
    out = F.lit(DEFAULT_DATUM)
    for name, (x0, y0, x1, y1) in reversed(DATUM_REGIONS):
        out = F.when(lon.between(x0, x1) & lat.between(y0, y1), F.lit(name)).otherwise(out)
    return out


def folders(pages: DataFrame, html: str = "html") -> DataFrame:
    """(region, pos) of the folders that a listing links to, each at its first place."""
    found = pages.select(F.posexplode(anchors(F.col(html))).alias("pos", "x")).filter(F.lower("x.target").endswith(INDEX))
    found = found.select("pos", F.expr(f"left(x.target, length(x.target) - {len(INDEX)})").alias("region")).filter(F.col("region").rlike("^\\w+$"))
    return found.groupBy("region").agg(F.min("pos").alias("pos"))


def listed_tiles(pages: DataFrame, html: str = "html", region: str = "region", base: str = "url") -> DataFrame:
    """Tiles in listings (region, url, html); links that are no tiles are left out."""
    rows = pages.select(F.col(region).alias("region"), F.regexp_replace(base, "[^/]*$", "").alias("base"), F.explode(anchors(F.col(html))).alias("x"))
    size = F.regexp_extract("x.after", MEGABYTES, 1).try_cast("double")
    whole = F.col("x.target").rlike("(?i)^[a-z]+:")
    url = F.when(whole, F.col("x.target")).otherwise(F.concat("base", F.regexp_replace("x.target", r"^(\./)+", "")))
    rows = rows.filter(F.lower("x.target").endswith(".tif")).select("region", url.alias("url"), F.col("x.shown").alias("name"), size.alias("size_mb")).filter("size_mb is not null")
    return rows.withColumn("t", tile(F.col("name"))).filter("t is not null").select("name", "url", "region", "t.*", "size_mb")


def newest(tiles: DataFrame) -> DataFrame:
    """One tile a footprint: the newest year and version."""
    order = Window.partitionBy(F.round("sw_lat", 4), F.round("sw_lon", 4)).orderBy(F.desc("year"), F.desc("version"), F.lower("name"))
    return tiles.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def tiles_in(tiles: DataFrame, box: BBox) -> DataFrame:
    """Tiles that overlap a box."""
    x, y = F.col("sw_lon"), F.col("sw_lat")
    return tiles.filter(overlaps(x, y, x + TILE_DEGREES, y + TILE_DEGREES, box))


def prioritised(tiles: DataFrame) -> DataFrame:
    """Tiles with their place in the mosaic: south first, then west."""
    return tiles.withColumn("priority", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("sw_lat", "sw_lon", "name")))


def footprint(tiles: DataFrame) -> DataFrame:
    """The box around all tiles, with their number and size."""
    x, y = F.col("sw_lon"), F.col("sw_lat")
    return tiles.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x + TILE_DEGREES).alias("xmax"), F.max(y + TILE_DEGREES).alias("ymax"), F.count("*").alias("n"), F.sum("size_mb").alias("size_mb"))


def mosaic(pixels: DataFrame) -> DataFrame:
    """(row, col, dem): of each pixel, the value of the first tile (by priority, of any ordered type, no two alike at a pixel) that has one."""
    known = F.when(F.col("z").isNotNull() & ~F.isnan("z"), F.col("priority"))
    return pixels.groupBy("row", "col").agg(F.min_by("z", known).alias("dem"))


def bilinear(pixels: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Values at fractional pixel places (tid, r, c) of pixels (row, col, z), of the tile named by `by`; null where a corner is missing.

    Each target makes four rows, one a corner, which are joined by equality and weighted.
    """
    r0, c0 = F.floor("r"), F.floor("c")
    fr, fc = F.col("r") - r0, F.col("c") - c0
    corners = F.array(*[F.struct((r0 + i).cast("int").alias("row"), (c0 + j).cast("int").alias("col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)])
    each = targets.select("tid", *by, F.explode(corners).alias("x")).select("tid", *by, "x.*").filter("w > 0")
    joined = each.join(pixels.select(*by, "row", "col", "z"), [*by, "row", "col"], "left")
    whole = F.count("z") == F.count("*")
    return joined.groupBy("tid", *by).agg(F.when(whole, F.sum(F.col("w") * F.col("z"))).alias("z"))


def warp(spark: SparkSession, pixels: DataFrame, sources: DataFrame, x: float, y: float, width: int, height: int, res: float, zone: int, north: bool = True) -> DataFrame:
    """(row, col, dem) of a UTM grid, bilinear from tiles in degrees; the first tile (by priority) with a value wins.

    sources: (priority, west, north, step, rows, columns) of each tile, few; pixels: (priority, row, col, z).
    Every target pixel is placed in every tile that can cover it by arithmetic; only corners are joined.
    """
    col, row = F.col("id") % width, F.expr(f"id div {width}")
    lon, lat = from_utm(F.lit(x) + (col + 0.5) * res, F.lit(y) - (row + 0.5) * res, zone, north)
    targets = spark.range(width * height).select(F.col("id").alias("tid"), lon.alias("lon"), lat.alias("lat"))
    places = []
    for t in sources.orderBy("priority").collect():
        r, c = (F.lit(t["north"]) - F.col("lat")) / t["step"] - 0.5, (F.col("lon") - F.lit(t["west"])) / t["step"] - 0.5
        inside = r.between(-0.5, t["rows"] - 0.5) & c.between(-0.5, t["columns"] - 0.5)
        hold = lambda v, n: F.least(F.lit(float(n - 1)), F.greatest(F.lit(0.0), v))
        places.append(F.when(inside, F.struct(F.lit(t["priority"]).alias("priority"), hold(r, t["rows"]).alias("r"), hold(c, t["columns"]).alias("c"))))
    spots = targets.select("tid", F.explode(F.array_compact(F.array(*places))).alias("s")).select("tid", "s.*")
    found = bilinear(pixels, spots, ("priority",)).filter("z is not null").groupBy("tid").agg(F.min_by("z", "priority").alias("dem"))
    every = targets.select("tid").join(found, "tid", "left")
    return every.select(F.expr(f"cast(tid div {width} as int)").alias("row"), (F.col("tid") % width).cast("int").alias("col"), "dem")
