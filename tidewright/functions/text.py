"""Links, tile names, JSON picks and times in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of a tile's name.
TILE = r"(?i)ncei19_n(\d+)x(\d+)_w(\d+)x(\d+)_(\d{4})v(\d+)\.tif"
#: A link of a page: its target, what it shows, and the text after it up to the next tag.
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>([^<]*)"""
MEGABYTES = r"(?i)\(\s*(\d+(?:\.\d+)?|\.\d+)\s*MB\s*\)"
INDEX = "/index.html"
TILE_DEGREES = 0.25


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))


def anchors(html: Column) -> Column:
    """(target, shown, after) of each link of a page, in order."""
    part = lambda i: lambda a: F.regexp_extract(a, ANCHOR, i)
    return F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), lambda a: F.struct(F.trim(part(1)(a)).alias("target"), F.trim(part(2)(a)).alias("shown"), part(3)(a).alias("after")))


def tile(name: Column) -> Column:
    """South-west corner, year and version in a tile's name; null if it has another form."""
    part = [F.regexp_extract(name, TILE, i).try_cast("int") for i in range(1, 7)]
    lat, lon = part[0] + part[1] / 100 - F.lit(TILE_DEGREES), -(part[2] + part[3] / 100)
    parsed = F.struct(lat.alias("sw_lat"), lon.alias("sw_lon"), part[4].alias("year"), part[5].alias("version"))
    return F.when(name.rlike(TILE), parsed)


def number(text: Column) -> Column:
    """A number, or null where the text is none."""
    return F.trim(text).try_cast("double")


def first_of(json: Column, *paths: str) -> Column:
    """The first of several JSON paths that is there."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def relative_minutes(at: Column, start: Column) -> Column:
    """Whole minutes from start, cut off towards zero."""
    return ((F.unix_micros(at) - F.unix_micros(start)) / F.lit(60_000_000)).cast("int")
