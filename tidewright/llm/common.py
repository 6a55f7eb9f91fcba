"""Shared pieces of the corpus operators: word rules, row keys, work tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Terms are runs of ASCII letters, digits and everything beyond ASCII (after lower-casing A-Z).
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LAST = (1 << 63) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast path, on which lower() does the same."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as bucket 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(0))


def ordered_id(docs: DataFrame, doc_id: str) -> Column:
    """The id with null as the largest: a long for whole numbers, else a struct that orders alike."""
    if isinstance(docs.schema[doc_id].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many `_` after it as make it differ from those taken in more than case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that tell rows apart by id and text; equal rows share them."""
    return [F.xxhash64(doc_id, text, F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), text, doc_id).alias("k2")]


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def id_order(docs: DataFrame, doc_id: str) -> Column:
    """A number that no smaller id has a larger of; null ids have the largest. Ids of types without one all have 0."""
    kind, null = docs.schema[doc_id].dataType, F.lit(LAST)
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return F.coalesce(F.col(doc_id).cast("long"), null)
    if isinstance(kind, StringType):
        first = F.rpad(F.hex(F.substring(F.encode(F.col(doc_id), "UTF-8"), 1, 7)), 14, "0")
        return F.coalesce(F.conv(first, 16, 10).cast("long"), null)
    return F.when(F.col(doc_id).isNull(), null).otherwise(F.lit(0).cast("long"))


class Workspace:
    """Work tables of one operator call, as Parquet in the shared folder.

    save() cuts lineage: a lost executor costs the tasks of one step only. drop() frees a table that
    no later step reads; close() frees all but the named ones.
    """

    tracked: list[Workspace] = []
    tracking = False

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        if Workspace.tracking:
            Workspace.tracked.append(self)
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: set[str] = set()
        self.catalogued: dict[str, str] = {}
        self._n = 0

    def save(self, df: DataFrame, name: str | None = None) -> DataFrame:
        name = self._name(name)
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
        out.work_table = name
        return out

    def bucketed(self, df: DataFrame, by: list[str], name: str | None = None, dealt: bool = False) -> DataFrame:
        """Like save(), in as many buckets by the given columns as shuffles have partitions: joins and sums by all of these move no row of it.

        With dealt, df comes from a join or sum by these columns, and is not dealt out again.
        """
        name = self._name(name)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"tidewright_{uuid.uuid4().hex}"
        writer = (df if dealt else df.repartition(n, *by)).write.bucketBy(n, *by).sortBy(*by)
        writer.mode("overwrite").format("parquet").option("path", f"{self.path}/{name}").saveAsTable(table)
        self.catalogued[name] = table
        out = self.spark.table(table)
        out.work_table = name
        return out

    def _name(self, name: str | None) -> str:
        self._n += 1
        name = f"{name or 't'}-{self._n}"
        self.tables.add(name)
        return name

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df.work_table)

    def close(self, *keep: DataFrame) -> None:
        for name in self.tables - {df.work_table for df in keep}:
            self._delete(name)
        # Spark removes shuffle files when the driver's JVM finds their plans gone, by default every 30 minutes.
        self.spark.sparkContext._jvm.System.gc()

    @classmethod
    @contextmanager
    def stage(cls, docs: DataFrame) -> Iterator[None]:
        """A pipeline's stage: frees what earlier stages left, as they are written, but not what docs is read from."""
        read = docs.inputFiles()
        for ws in cls.tracked:
            if ws.spark is docs.sparkSession and not any(ws.path.split(":", 1)[-1] in f for f in read):
                ws.close()
        cls.tracking = True
        try:
            yield
        finally:
            cls.tracking = False

    def _delete(self, name: str) -> None:
        if name in self.catalogued:
            self.spark.sql(f"drop table if exists {self.catalogued.pop(name)}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.tables.discard(name)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
