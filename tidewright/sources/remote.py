"""Remote services as a Spark data source: every request is a partition, so fetching is spread and retried by task.

The source yields (key, url, status, body); bodies are parsed by DataFrame expressions.
"""

from __future__ import annotations

import shutil
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewright.functions.text import first_of, number

CHUNK_DAYS, RETRIES, BACKOFF_S, TIMEOUT_S = 30, 3, 1.0, 60
FEET = 0.3048


class _Request(InputPartition):
    def __init__(self, key: str, url: str) -> None:
        super().__init__((key, url))
        self.key, self.url = key, url


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        pairs = [line.split("\t", 1) for line in options.get("requests", "").split("\n") if "\t" in line]
        self.requests = [_Request(k, u) for k, u in pairs]
        self.retries, self.pause, self.timeout = int(options.get("retries", RETRIES)), float(options.get("backoff", BACKOFF_S)), float(options.get("timeout", TIMEOUT_S))

    def partitions(self) -> list[_Request]:
        return self.requests

    def read(self, partition: _Request) -> Iterator[tuple]:
        """A failed request is a row without a body, after some tries with doubled pauses."""
        status = "none"
        for attempt in range(max(1, self.retries)):
            try:
                with urllib.request.urlopen(partition.url, timeout=self.timeout) as got:  # noqa: S310
                    yield partition.key, partition.url, "ok", got.read().decode("utf-8", "replace")
                    return
            except (urllib.error.URLError, OSError, ValueError) as e:
                status = f"{type(e).__name__}: {e}"[:300]
                if attempt + 1 < self.retries:
                    time.sleep(self.pause * 2**attempt)
        yield partition.key, partition.url, status, None


class Remote(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote"

    def schema(self) -> str:
        return "key string, url string, status string, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def fetch(spark: SparkSession, requests: list[tuple[str, str]], **options) -> DataFrame:
    spark.dataSource.register(Remote)
    reader = spark.read.format("remote").option("requests", "\n".join(f"{k}\t{u}" for k, u in requests))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    if not requests:
        return spark.createDataFrame([], "key string, url string, status string, body string")
    return reader.load()


def cached(spark: SparkSession, path: str, requests: list[tuple[str, str]], refresh: bool = False, **options) -> DataFrame:
    """Bodies kept as Parquet at a path; only keys that are not there (or all, on refresh) are fetched. Failures are not kept."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    known = set()
    if there and not refresh:
        known = {r[0] for r in spark.read.parquet(path).filter(F.col("key").isin([k for k, _ in requests])).select("key").collect()}
    rest = [(k, u) for k, u in requests if k not in known]
    if rest:
        fetch(spark, rest, **options).filter("body is not null").write.mode("overwrite" if refresh else "append").parquet(path)
    return spark.read.parquet(path)


def download(tiles: list[tuple[str, str, float | None]], folder: str, skip_existing: bool = True, pause_s: float = 0.0, tolerance: float = 0.05) -> list[str]:
    """Files (name, url, size in MB) fetched one after another into a folder of the driver; their paths.

    One whose size is within the tolerance is kept; a partial file never takes the name.
    """
    out = []
    for name, url, size_mb in tiles:
        path = Path(folder) / name
        there = path.exists() and (size_mb is None or abs(path.stat().st_size / 1e6 - size_mb) <= tolerance * size_mb)
        if not (skip_existing and there):
            path.parent.mkdir(parents=True, exist_ok=True)
            part = path.with_suffix(path.suffix + ".part")
            try:
                with urllib.request.urlopen(url, timeout=TIMEOUT_S) as got, part.open("wb") as to:  # noqa: S310
                    shutil.copyfileobj(got, to)
                part.replace(path)
            finally:
                part.unlink(missing_ok=True)
            time.sleep(pause_s)
        out.append(str(path))
    return out


def chunks(start: date, end: date, days: int = CHUNK_DAYS) -> list[tuple[date, date]]:
    """Closed stretches of at most so many days."""
    out = []
    while start <= end:
        stop = min(end, start + timedelta(days - 1))
        out.append((start, stop))
        start = stop + timedelta(1)
    return out


def series_requests(base: str, station: str, start: date, end: date, **params: str) -> list[tuple[str, str]]:
    out = []
    for a, b in chunks(start, end):
        query = urllib.parse.urlencode({"station": station, "begin_date": f"{a:%Y%m%d}", "end_date": f"{b:%Y%m%d}", **params})
        out.append((f"{station}/{a:%Y%m%d}", f"{base}?{query}"))
    return out


def parse_series(bodies: DataFrame) -> DataFrame:
    """(station_id, t, v) of level pages; rows without a number or a time are left out."""
    item = "array<struct<t:string,v:string>>"
    rows = F.explode(F.coalesce(F.from_json(F.get_json_object("body", "$.data"), item), F.from_json(F.get_json_object("body", "$.predictions"), item))).alias("x")
    out = bodies.filter("body is not null").select(F.element_at(F.split("key", "/"), 1).alias("station_id"), rows)
    return out.select("station_id", F.col("x.t").try_cast("timestamp").alias("t"), number(F.col("x.v")).alias("v")).dropna().dropDuplicates(["station_id", "t"])


def parse_stations(bodies: DataFrame, station_type: str) -> DataFrame:
    item = "array<struct<id:string,name:string,lat:double,lng:double,state:string>>"
    rows = F.explode(F.from_json(first_of(F.col("body"), "$.stations", "$.stationList"), item)).alias("x")
    out = bodies.filter("body is not null").select(rows)
    return out.filter("x.lat is not null and x.lng is not null").select(F.col("x.id").alias("station_id"), F.col("x.name").alias("name"), F.col("x.lat").alias("lat"), F.col("x.lng").alias("lon"), F.col("x.state").alias("state"), F.lit(station_type).alias("station_type"))


def parse_datums(bodies: DataFrame, upper: str = "NAVD88", lower: str = "MLLW", sign: int = 1) -> DataFrame:
    """(station_id, offset_m): the difference of two published datums, in metres. Which sign is wanted is the caller's to say."""
    items = F.from_json(F.get_json_object("body", "$.datums"), "array<struct<name:string,value:double>>")
    values = F.map_from_entries(F.filter(F.transform(items, lambda x: F.struct(x["name"], x["value"])), lambda x: x["name"].isNotNull()))
    feet = F.lower(F.coalesce(F.get_json_object("body", "$.units"), F.lit("feet"))).startswith("f")
    scale = F.when(feet, F.lit(FEET)).otherwise(F.lit(1.0))
    rows = bodies.filter("body is not null").withColumn("m", values)
    return rows.select(F.col("key").alias("station_id"), (F.lit(sign) * (F.col("m")[upper] - F.col("m")[lower]) * scale).alias("offset_m")).dropna()


def parse_conversion(bodies: DataFrame) -> DataFrame:
    """(station_id, offset_m): the converted height of zero; the service's marks for no value are left out."""
    value = number(F.get_json_object("body", "$.t_z"))
    return bodies.filter("body is not null").select(F.col("key").alias("station_id"), value.alias("offset_m")).filter("offset_m is not null and abs(offset_m) < 100000")
