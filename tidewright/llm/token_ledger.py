"""Operator 7, token counts as delta-maintained rollups.

The ledger keeps signed entries: an insert adds a document's token count, a delete takes it back, a
revision takes the old count back and adds the new one. Totals by source, language and tokenizer
version are sums of signed entries, so a batch costs what it changes and totals are never recomputed
from texts.

A log orders all commits. A batch writes its entries and sums aside, in a folder of its own, and is
committed by one small file that takes the log's next number; only one writer can take a number. Who
comes second reads the log again: a batch that is committed by now is left alone, one that takes
counts back is prepared anew from the state it now follows, any other takes the next number. So
replays, batches cut short by a lost driver, and writers at the same time never count twice. Taking a
number needs a file system that renames a file onto no other (HDFS) or links files (local and shared
POSIX ones).

After MAX_PENDING batches all entries so far are compacted into one snapshot, with a row for each id
and group that is left, so deletes and totals read what is left, not the history. A snapshot takes a
number of the log like a batch. Folders that it replaces are removed with the next one.

Entries are pre-summed in the tasks by group, so a source with a third of all rows is no hot key.
Deletes and revisions find the old counts by a join on the changed ids only.

Defined cases: a null text has 0 tokens; very long texts are counted whole. Null sources and languages
are groups. Inserting an id again adds a row (rows are counted, not ids); a revision or deletion
concerns all rows of its id, a null id included; one of an unknown id only adds, or does nothing.
Groups without documents are left out. An empty change table is a batch like others. Columns of
changes beyond those named are left aside, whatever their names.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INSERT, DELETE, REVISE = "insert", "delete", "revise"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_PENDING = 4
KEY = ["doc_id", "source", "lang", "tokenizer"]


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ledger", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_bpe(path: str = RANKS, pattern: str = PATTERN) -> Callable[[str], int]:
    """A counter of byte-level tokens; the vocabulary is installed on every machine at the path."""

    def count(text: str) -> int:
        return len(_encoding(path, pattern).encode_ordinary(text))

    return count


def counted(rows: DataFrame, count: Callable[[str], int]) -> DataFrame:
    """The rows with their texts replaced by `tokens`."""
    others = [c for c in rows.columns if c != "text"]
    schema = rows.select(*others).schema.add("tokens", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [0 if t.as_py() is None else count(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(tokens, pa.int64())], names=names)

    return rows.select("text", *others).mapInArrow(run, schema)


class TokenLedger:
    """Signed token counts at a path of the shared folder.

    Changes have the columns op, doc_id, source, lang and text; counters is by tokenizer version.
    """

    def __init__(self, spark: SparkSession, path: str, counters: dict[str, Callable[[str], int]], max_pending: int = MAX_PENDING) -> None:
        self.spark, self.path, self.counters, self.max_pending = spark, path.rstrip("/"), counters, max_pending
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("log").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils
        self._entries: list[dict] = []
        for name in ("log", "staging"):
            self._fs.mkdirs(self._at(name))

    def _log(self) -> list[dict]:
        """The log's entries in order; those read before are kept, as they never change."""
        while self._fs.exists(path := self._at(f"log/{len(self._entries):012d}")):
            stream = self._fs.open(path)
            try:
                self._entries.append(json.loads(self._text.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return self._entries

    def _take(self, number: int, entry: dict) -> bool:
        """Make entry the log's entry of that number; False if there is one."""
        target, aside = self._at(f"log/{number:012d}"), self._at(f"staging/{uuid.uuid4().hex}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if self._fs.getUri().getScheme() != "file":
            return bool(self._fs.rename(aside, target))
        a, b = (unquote(urlparse(self._fs.makeQualified(x).toUri().toString()).path) for x in (aside, target))
        try:
            os.link(a, b)
        except FileExistsError:
            return False
        finally:
            self._fs.delete(aside, False)
        return True

    def batches(self) -> list[str]:
        """The committed batches' ids."""
        return sorted(e["batch"] for e in self._log() if "batch" in e)

    def _current(self) -> list[str]:
        """The folders that make up the state: the last snapshot and the batches since."""
        log = self._log()
        at = max((i for i, e in enumerate(log) if "batch" not in e), default=0)
        return [e["folder"] for e in log[at:]]

    def _read(self, table: str) -> DataFrame | None:
        folders = self._current()
        return self.spark.read.parquet(*[f"{self.path}/{f}/{table}" for f in folders]) if folders else None

    def _write(self, entries: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        entries.write.parquet(f"{self.path}/{folder}/entries")
        written = self.spark.read.schema(entries.schema).parquet(f"{self.path}/{folder}/entries")
        sums(written).write.parquet(f"{self.path}/{folder}/deltas")
        return folder

    def _prepare(self, changes: DataFrame) -> str:
        """Write the batch's entries and sums, from the state as it is."""
        added = changes.filter(F.col("op").isin(INSERT, REVISE)).select("doc_id", "source", "lang", "text")
        entries = None
        for version, count in self.counters.items():
            one = counted(added, count).select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), "tokens")
            entries = one if entries is None else entries.unionAll(one)
        old = self._read("entries")
        if old is not None:
            ids = changes.filter(F.col("op").isin(DELETE, REVISE)).select(F.col("doc_id").alias("changed")).distinct()
            held = net(old.join(ids, F.col("doc_id").eqNullSafe(F.col("changed")), "left_semi"))
            entries = entries.unionAll(held.select(*KEY, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        return self._write(entries)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit the batch; False if it was committed before."""
        if batch in self.batches():
            return False
        number = len(self._entries)
        folder = self._prepare(changes)
        while not self._take(number, {"batch": batch, "folder": folder}):
            done = batch in self.batches()
            takes_back = not done and not changes.filter(F.col("op").isin(DELETE, REVISE)).isEmpty()
            number = len(self._entries)
            if done or takes_back:
                self._fs.delete(self._at(folder), True)
            if done:
                return False
            if takes_back:
                folder = self._prepare(changes)
        if len(self._current()) > self.max_pending:
            self.compact()
        return True

    def compact(self) -> bool:
        """Put one snapshot in place of all entries so far; False if there is none or another writer came first."""
        old, number = self._read("entries"), len(self._entries)
        if old is None:
            return False
        replaced = self._current()
        folder = self._write(net(old))
        if not self._take(number, {"folder": folder, "replaces": replaced}):
            self._fs.delete(self._at(folder), True)
            return False
        for entry in [e for e in self._entries[:number] if "replaces" in e][-1:]:
            for gone in entry["replaces"]:
                self._fs.delete(self._at(gone), True)
        return True

    def totals(self) -> DataFrame:
        """docs and tokens by source, lang and tokenizer, from the snapshot's and the batches' sums."""
        deltas = self._read("deltas")
        if deltas is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        return sums(deltas).filter("docs != 0 or tokens != 0")


def net(entries: DataFrame) -> DataFrame:
    """One entry for each id and group that has rows left."""
    return entries.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs != 0 or tokens != 0")


def sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def as_changes(rows: DataFrame, op: str, text: Column | None = None) -> DataFrame:
    return rows.select(F.lit(op).alias("op"), "doc_id", "source", "lang", (F.col("text") if text is None else text).alias("text"))
