"""Tables of levels, stations, offsets and daylight in text files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.text import number
from tidewright.operators import series

STATION_ALIASES = {"stationid": "station_id", "station_id": "station_id", "id": "station_id", "name": "name", "latitude": "lat", "lat": "lat", "longitude": "lon", "lon": "lon", "lng": "lon", "state": "state", "stationtype": "station_type", "station_type": "station_type", "gauge_idx": "gauge_idx"}


class SeriesError(ValueError):
    """A table of levels that cannot be used."""


@dataclass
class Series:
    """Levels (gauge from 1, rec, level) with their interval and the columns' names."""

    records: DataFrame
    interval: int
    station_ids: list[str]
    start: object = None
    filled: int = 0
    source: str = ""
    n_records: int = 0
    info: dict = field(default_factory=dict)

    @property
    def per_day(self) -> int:
        return 1440 // self.interval

    @property
    def days(self) -> int:
        return self.n_records // self.per_day

    def describe(self) -> str:
        return f"{len(self.station_ids)} gauges, {self.n_records} records of {self.interval} min ({self.days} days), {self.filled} gaps filled, from {self.source or 'memory'}"


def _is_number(token: str) -> bool:
    try:
        float(token)
    except ValueError:
        return False
    return True


def has_header(first: list[str], second: list[str] | None) -> bool:
    """Whether the first of two lines names columns. A line of numbers that look like ids above a line of levels is ambiguous."""
    if any(not _is_number(t) for t in first if t != ""):
        return True
    ids = all(t.isdigit() and len(t) >= 5 for t in first)
    if ids and second and any(_is_number(t) and abs(float(t)) < 100 for t in second):
        raise SeriesError("the first line may hold station ids; say whether it is a header")
    return False


def _split(path: str, line: str) -> list[str]:
    return [t.strip().strip('"') for t in (line.split() if path.lower().endswith((".txt", ".dat")) else line.split("\t") if path.lower().endswith(".tsv") else line.split(","))]


def read_series(spark: SparkSession, path: str, time_col: str | None = "time", interval: int | None = None, order: list[str] | None = None, scale: float = 1.0, offsets: dict[str, float] | None = None, fill: str = "hold", max_gap: int | None = None, header: bool | None = None) -> Series:
    """A wide table of levels, a column a gauge, as a long one: scaled, shifted, gaps filled, whole days only.

    Lines are read in parallel and keep the order of the time column, or of the file without one. .txt
    and .dat are split at white space, .tsv at tabs, others at commas. Text that is no number is a gap.
    """
    if fill not in ("hold", "interpolate", "nan"):
        raise SeriesError(f"unknown way to fill gaps: {fill}")
    top = [_split(path, r[0]) for r in spark.read.text(path).limit(2).collect()]
    if not top:
        raise SeriesError(f"{path} is empty")
    header = has_header(top[0], top[1] if len(top) > 1 else None) if header is None else header
    names = top[0] if header else [f"gauge_{i + 1}" for i in range(len(top[0]))]
    if path.lower().endswith((".txt", ".dat")):
        parts = F.split(F.trim("value"), r"\s+")
        raw = spark.read.text(path).select(*[F.get(parts, i).alias(f"c{i}") for i in range(len(names))], F.monotonically_increasing_id().alias("line"))
    else:
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        raw = spark.read.csv(path, schema=schema, sep="\t" if path.lower().endswith(".tsv") else ",", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        raw = raw.withColumn("line", F.monotonically_increasing_id())
    if header:
        raw = raw.filter("line > 0")
    start = None
    if time_col is not None:
        if time_col not in names:
            raise SeriesError(f"there is no column {time_col} in {path}")
        raw = raw.withColumn("t", F.col(f"c{names.index(time_col)}").try_cast("timestamp"))
        bad = raw.filter("t is null").count()
        if bad:
            raise SeriesError(f"{bad} times cannot be read")
        found = series.regular_interval(raw)
        start = raw.agg(F.min("t")).first()[0]
        if interval not in (None, found):
            raise SeriesError(f"times are {found} min apart, not {interval}")
        interval = found
    if interval is None:
        raise SeriesError("without a time column the interval must be given")
    if interval < 1 or 1440 % interval:
        raise SeriesError(f"{interval} min does not divide a day")
    gauges = [n for n in names if n != time_col]
    wanted = [str(x) for x in order] if order else gauges
    missing = [x for x in wanted if x not in gauges]
    if missing:
        raise SeriesError(f"there is no column {', '.join(missing)} in {path}")
    if offsets is not None and (without := [x for x in wanted if x not in offsets]):
        raise SeriesError(f"no datum offset for {', '.join(without)}")
    rec = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t" if time_col else "line")) - 1
    pairs = [F.struct(F.lit(g + 1).alias("gauge"), (number(F.col(f"c{names.index(x)}")) * F.lit(float(scale)) + F.lit(float((offsets or {}).get(x, 0.0)))).alias("level")) for g, x in enumerate(wanted)]
    long = raw.withColumn("rec", rec).select("rec", F.explode(F.array(*pairs)).alias("x")).select("x.gauge", "rec", F.when(~F.isnan("x.level"), F.col("x.level")).alias("level"))
    gaps, n = long.agg(F.count_if(F.col("level").isNull()), F.max("rec") + 1).first()
    if gaps and max_gap is not None:
        worst = series.longest_gap(long).first()[0]
        if worst > max_gap:
            raise SeriesError(f"a gap of {worst} records ({worst * interval} min) is longer than {max_gap}")
    filled = 0
    if gaps and fill != "nan":
        long = series.fill_gaps(long, fill)
        filled = gaps - long.filter("level is null").count()
    n = n or 0
    return Series(series.whole_days(long, interval), interval, wanted, start, filled, path, n - n % (1440 // interval))


def write_series(data: Series, path: str, with_time: bool = True) -> None:
    """The wide table again, with times from the start where that is known."""
    wide = data.records.groupBy("rec").pivot("gauge", list(range(1, len(data.station_ids) + 1))).agg(F.first("level"))
    columns = [F.col(str(i + 1)).alias(x) for i, x in enumerate(data.station_ids)]
    if with_time and data.start is not None:
        at = F.timestamp_micros(F.unix_micros(F.lit(data.start)) + F.col("rec").cast("long") * data.interval * 60_000_000)
        columns = [F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), *columns]
    wide.repartitionByRange(1, "rec").sortWithinPartitions("rec").select(*columns).write.mode("overwrite").csv(path, header=True)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations with columns under any of their usual names; ids stay text."""
    raw = spark.read.csv(path, header=True)
    found = {STATION_ALIASES[c.lower().strip()]: c for c in raw.columns if c.lower().strip() in STATION_ALIASES}
    missing = [c for c in ("station_id", "lat", "lon") if c not in found]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    kinds = {"lat": "double", "lon": "double", "gauge_idx": "int"}
    out = raw.select(*[(F.col(found[c]).try_cast(kinds[c]) if c in kinds else F.trim(F.col(found[c]))).alias(c) if c in found else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in ("station_id", "name", "lat", "lon", "state", "station_type", "gauge_idx")])
    if "gauge_idx" in found:
        return out
    order = Window.partitionBy(F.lit(0)).orderBy(F.monotonically_increasing_id())
    return out.withColumn("gauge_idx", (F.row_number().over(order) - 1).cast("int"))


def read_offsets(spark: SparkSession, path: str, column: str = "vdatum_navd88_offset_m", key: str = "StationID") -> DataFrame:
    """(station_id, offset_m); text that is no number is left out, a missing file is an empty table."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "station_id string, offset_m double")
    return spark.read.csv(path, header=True).select(F.trim(F.col(key)).alias("station_id"), number(F.col(column)).alias("offset_m")).dropna()


def read_daylight(spark: SparkSession, path: str) -> DataFrame:
    """(day, sunrise, sunset): a header and two columns, a line a day."""
    raw = spark.read.csv(path, header=True)
    if len(raw.columns) != 2:
        raise ValueError(f"{path} must have two columns")
    day = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.monotonically_increasing_id())) - 1
    return raw.select(day.cast("int").alias("day"), *[F.col(f"`{c}`").cast("double").cast("int").alias(n) for c, n in zip(raw.columns, ("sunrise", "sunset"), strict=True)])


def write_csv(table: DataFrame, path: str) -> None:
    """Stations, offsets, daylight or a summary; one file, as these are small."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)
