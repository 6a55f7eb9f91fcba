"""Operator 5, substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words. Windows are not indexed one by one: each has an anchor, the
ANCHOR-word run in it with the smallest hash (the leftmost of equals), which depends on the window's
words only. Adjacent windows mostly share their anchor; such a stretch of windows is a span, and the
hash of all its words is one fingerprint for all its windows (some 13 on average).

The index is a log of immutable runs, each of three tables in buckets by their keys, sorted within:
spans (fingerprint of 128 bits, anchor, first row that has it), anchors (number of their spans, place
of one) and windows of anchors with several spans (fingerprint of 128 bits, first id that has it). A
batch adds a run; when there are more than MAX_RUNS, they are compacted into one. A batch is sorted
into the same buckets once and merge-joined with the runs, which are neither moved nor dealt out anew,
so a batch costs what it holds and a pass over the runs:

1. A span that the index has, or an earlier row of the batch, is repeated with all its windows.
2. A span seen for the first time can still share windows with other spans, but only with those of the
   same anchor. Of anchors with several spans, the windows are hashed one by one from the texts that
   hold the spans first, and grouped; this settles where repeats begin and end. All places of a new
   span in its smallest id count, in one text or in several. An anchor's windows join the index when it
   gets its second span; the place of the first tells which older text to read for them.

So results are exact, window by window, while some 5 % of the windows are shuffled, and copies of a
passage cost a row a span each. Word hashes are XXH3-128; span and window hashes are two independent
64-bit polynomials of them, which is the verification: both must agree. Words are not compared: n
different windows have two that agree by chance with a probability of about n^2 / 2^129.

Texts are written once, in buckets by row, and never moved again: neither for older spans' windows nor
for the result. Batches must come in rising order of ids: `smaller id` then is `earlier`. All steps are
joins and sums on tables in the shared folder; groups are pre-summed, never gathered.

Defined cases: null texts have no words. A text shorter than a window loses none; very long texts are
hashed whole, a text at a time. Rows that share an id do not count as earlier than one another; repeated
rows lose the same words. Ids may be whole numbers or strings, or of any other ordered type, which then
go in one batch; a null id counts as larger than any other. Columns of docs may have any names. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_128_digest

from tidewright.llm.common import LAST, Workspace, id_order, ordered_id

WINDOW, ANCHOR, BATCHES, MAX_RUNS = 50, 16, 4, 2
#: Rows of windows in an Arrow batch, about.
ROWS = 20_000
BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in BASES], np.uint64)
SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of both bases and of their inverses, modulo 2^64."""
    if len(_powers.get("up", ())) <= n:
        size = max(1024, 2 * n)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASES), ("down", INVERSES)):
                _powers[name] = np.cumprod(np.r_[np.ones((1, 2), np.uint64), np.tile(base, (size, 1))], axis=0, dtype=np.uint64)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


class Hashed:
    """Hashes of any stretch of a text's words."""

    def __init__(self, words: list[bytes]) -> None:
        self.n = len(words)
        up, self.down = powers(self.n)
        each = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.zeros((1, 2), np.uint64), np.cumsum(each * up[: self.n], axis=0, dtype=np.uint64)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes (two columns) of the words from start up to end; their number counts."""
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64)[:, None]
            x ^= x >> np.uint64(32)
            x *= SPREAD
            return x ^ (x >> np.uint64(29))


def spans(hashed: Hashed, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, fingerprint, first and last window start of every span of a text."""
    n = hashed.n - window + 1
    at = np.arange(hashed.n - anchor + 1)
    grams = hashed.of(at, at + anchor)[:, 0]
    least = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:] - 1, n - 1]
    prints = hashed.of(first, last + window)
    new = np.flatnonzero(np.r_[True, (prints[1:] != prints[:-1]).any(axis=1)])
    return grams[least[first[new]]], prints[new], first[new], last[np.r_[new[1:] - 1, len(first) - 1]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def find_spans(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(id, row, a, s1, s2, first, last) of each span, from (id, row, text)."""
    inner = docs.select("id", "row", F.col("text").cast("binary").alias("text"))
    schema = inner.drop("text").schema.add("a", "long").add("s1", "long").add("s2", "long").add("first", "integer").add("last", "integer")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, text in enumerate(batch.column(2)):
                words = (text.as_py() or b"").split()
                if len(words) >= window:
                    found.append((i, *spans(Hashed(words), window, anchor)))
            if found:
                whose = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                a, s, first, last = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3, 4))
                places = [pa.array(x.astype(np.int32)) for x in (first, last)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(whose)) for k in (0, 1)), _signed(a), _signed(s[:, 0]), _signed(s[:, 1]), *places], names=names)

    return inner.mapInArrow(run, schema)


def find_windows(docs: DataFrame, window: int) -> DataFrame:
    """(id, row, fresh, w1, w2, first) of each window, from (id, row, text, parts of id, first, last, fresh); parts of other ids are passed over."""
    schema = docs.select("id", "row").schema.add("fresh", "boolean").add("w1", "long").add("w2", "long").add("first", "integer")
    names = schema.names

    def rows(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        whose = pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]))
        fresh, w, starts = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(whose) for k in (0, 1)), pa.array(fresh), _signed(w[:, 0]), _signed(w[:, 1]), pa.array(starts.astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], 0
            for i, (whose, text, parts) in enumerate(zip(batch.column(0), batch.column(2), batch.column(3), strict=True)):
                parts = [p for p in parts.as_py() if p["id"] == whose.as_py()]
                if not parts:
                    continue
                hashed = Hashed((text.as_py() or b"").split())
                starts = np.concatenate([np.arange(p["first"], p["last"] + 1) for p in parts])
                fresh = np.repeat([p["fresh"] for p in parts], [p["last"] + 1 - p["first"] for p in parts])
                found.append((i, fresh, hashed.of(starts, starts + window), starts))
                n += len(starts)
                if n >= ROWS:
                    yield rows(batch, found)
                    found, n = [], 0
            if found:
                yield rows(batch, found)

    return docs.select("id", "row", "text", "parts").mapInArrow(run, schema)


SPAN, WIN, PLACE = ["s1", "s2"], ["w1", "w2"], ["id", "row", "first", "last"]
KEYS = {"spans": SPAN, "anchors": ["a"], "windows": WIN}


class SubstringIndex:
    """Spans, anchors and windows of all batches added so far."""

    def __init__(self, spark: SparkSession, ws: Workspace, window: int = WINDOW, anchor: int = ANCHOR, max_runs: int = MAX_RUNS) -> None:
        self.spark, self.ws = spark, ws
        self.window, self.anchor, self.max_runs = window, anchor, max_runs
        #: By table, its runs.
        self.runs: dict[str, list[DataFrame]] = {table: [] for table in KEYS}
        #: Tables of the caller that are in use.
        self.kept: list[DataFrame] = []

    def _held(self, batch: DataFrame, table: str, by: list[str], **columns: Column) -> DataFrame:
        """The batch with the columns of the latest run that has its key, named held_; one merge join a run, in buckets."""
        for i, run in enumerate(self.runs[table]):
            there = run.select(*by, *[F.col(c).alias(f"{c}_{i}") for c in columns])
            batch = batch.join(there.hint("merge"), by, "left")
        n = range(len(self.runs[table]))
        for c, none in columns.items():
            values = [F.col(f"{c}_{i}") for i in reversed(n)]
            batch = batch.withColumn(f"held_{c}", F.coalesce(*values, none) if values else none)
        return batch.drop(*[f"{c}_{i}" for c in columns for i in n])

    def _append(self, table: str, written: DataFrame, run: DataFrame) -> None:
        run.work_table = written.work_table
        self.runs[table].append(run)

    def compact(self) -> None:
        """All runs become one. A span or an anchor counts once, a window's smallest id stays."""
        for table, runs in self.runs.items():
            every = runs[0]
            for run in runs[1:]:
                every = every.unionByName(run)
            if table == "anchors":
                # A later run's row has the number of all spans so far.
                every = every.groupBy("a").agg(F.max_by(F.struct("place", "n"), "n").alias("x")).select("a", "x.place", "x.n")
            elif table == "windows":
                every = every.groupBy(*WIN).agg(F.min("id").alias("id"))
            merged = self.ws.bucketed(every, KEYS[table], table, dealt=table != "spans")
            self.ws.drop(*runs)
            self.runs[table] = [merged]

    def add(self, batch: DataFrame, store: DataFrame) -> DataFrame:
        """(id, row, first, last): stretches of window starts of the batch that are repeated. Rows are (id, row, text).

        store has the texts of this batch and all before; in buckets by row, it is not moved.
        """
        ws, none = self.ws, F.lit(None)
        found = ws.save(find_spans(batch, self.window, self.anchor), "found")
        kind = found.schema["id"].dataType
        new = found.groupBy(*SPAN).agg(F.first("a").alias("a"), F.min(F.struct(*PLACE)).alias("place"), F.max("id").alias("most"), F.count("*").alias("n"))
        new = self._held(new.withColumn("first_id", F.col("place.id")), "spans", SPAN, first_id=none.cast(kind))
        new = ws.bucketed(new, SPAN, "spans", dealt=True)
        repeated = new.filter(F.col("held_first_id").isNotNull() | (F.col("most") > F.col("first_id"))).select(*SPAN, F.coalesce("held_first_id", "first_id").alias("since"))
        fresh = new.filter("held_first_id is null").select(*SPAN, "a", "place", "first_id", (F.col("n") > 1).alias("several"))

        place = StructType(found.select(*PLACE).schema.fields)
        anchors = fresh.groupBy("a").agg(F.min("place").alias("place"), F.count("*").alias("added"))
        anchors = self._held(anchors, "anchors", ["a"], n=F.lit(0).cast("long"), place=none.cast(place))
        anchors = anchors.select("a", F.coalesce("held_place", "place").alias("place"), (F.col("added") + F.col("held_n")).alias("n"), "held_n")
        anchors = ws.bucketed(anchors, ["a"], "anchors", dealt=True)
        shared = anchors.filter("n > 1")
        # Windows of an anchor's first span join the index when there is a second one.
        older = shared.filter("held_n = 1").select("place.*", F.lit(False).alias("fresh"))
        chosen = ws.save(fresh.join(shared.select("a").hint("merge"), "a").select(*SPAN, "place", "several"), "chosen")

        again = chosen.filter("several").select(*SPAN, F.col("place.id").alias("since"), F.lit(True).alias("again"))
        marks = ws.save(repeated.withColumn("again", F.lit(False)).unionByName(again), "repeated")
        here = F.when(F.col("again"), F.col("id") == F.col("since")).otherwise(F.col("id") > F.col("since"))
        places = ws.save(found.join(marks.hint("merge"), SPAN).filter(here).select(*PLACE, "again"), "places")
        parts = chosen.select("place.*", F.lit(True).alias("fresh")).unionByName(older).unionByName(places.filter("again").withColumnRenamed("again", "fresh"))
        needed = parts.groupBy("row").agg(F.collect_set(F.struct("id", "first", "last", "fresh")).alias("parts"))
        texts = store.select("id", "row", F.col("text").cast("binary").alias("text")).join(needed.hint("merge"), "row")
        # Repeated rows stand side by side in their bucket; they have the same windows.
        windows = ws.save(find_windows(texts, self.window), "windows")
        since = windows.groupBy(*WIN).agg(F.min("id").alias("id"), F.max("id").alias("most"))
        since = self._held(since, "windows", WIN, id=none.cast(kind)).withColumn("since", F.coalesce("held_id", "id"))
        since = ws.bucketed(since, WIN, "windows", dealt=True)
        single = windows.filter("fresh").join(since.filter("most > since").select(*WIN, "since").hint("merge"), WIN).filter(F.col("id") > F.col("since"))
        whole = places.filter("not again").drop("again")
        out = ws.save(whole.unionByName(single.select("id", "row", "first", F.col("first").alias("last"))), "repeats")

        self._append("spans", new, fresh)
        self._append("anchors", anchors, anchors.select("a", "place", "n"))
        self._append("windows", since, since.filter("held_id is null").select(*WIN, "id"))
        if len(self.runs["spans"]) > self.max_runs:
            self.compact()
        ws.close(out, *[run for runs in self.runs.values() for run in runs], *self.kept)
        return out


def _row(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(text), F.col(doc_id))


def repeats(store: DataFrame, ws: Workspace, batches: int = BATCHES, **options) -> DataFrame:
    """(row, parts of id, first, last): the repeated stretches of each row that has any, found by adding (id, at, row, text) in batches of rising `at`."""
    cuts = store.agg(F.percentile_approx("at", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else None
    cuts = [*sorted({int(c) for c in cuts or []} - {LAST}), LAST]
    index = SubstringIndex(store.sparkSession, ws, **options)
    index.kept.append(store)
    for i, high in enumerate(cuts):
        above = F.col("at") > cuts[i - 1] if i else F.lit(True)
        below = F.col("at") <= high
        index.kept.append(index.add(store.filter(above & below), store.filter(below)))
    every = index.kept[1]
    for part in index.kept[2:]:
        every = every.unionByName(part)
    out = ws.save(every.groupBy("row").agg(F.collect_list(F.struct("id", "first", "last")).alias("parts")), "parts")
    ws.close(out, store)
    return out


def deduplicated(docs: DataFrame, keep: dict[str, Column], doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """The columns named in keep, n_words, n_removed, and kept_sha256 and kept (the words left, joined by a space) of every row."""
    ws = Workspace(docs.sparkSession, "substrings")
    store = docs.select(
        ordered_id(docs, doc_id).alias("id"), id_order(docs, doc_id).alias("at"), _row(doc_id, text).alias("row"),
        F.col(text).alias("text"), F.struct(*[c.alias(n) for n, c in keep.items()], F.lit(0).alias("__none")).alias("keep"),
    )
    store = ws.bucketed(store, ["row"], "store")
    parts = repeats(store, ws, window=window, **options)
    joined = store.join(parts.withColumnRenamed("parts", "__parts").hint("merge"), "row", "left")
    inner = joined.select(F.col("text").cast("binary").alias("__text"), "__parts", F.col("id").alias("__id"), *[F.col("keep")[n].alias(n) for n in keep])
    schema = inner.drop("__text", "__parts", "__id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string")
    names = schema.names

    def left(data: bytes | None, spans: list[dict] | None, whose: object) -> tuple[int, int, str, bytes]:
        words = (data or b"").split()
        n = len(words)
        if spans := [s for s in spans or () if s["id"] == whose]:
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, [s["first"] for s in spans], 1)
            np.add.at(edge, [s["last"] + window for s in spans], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:n] == 0)]
        text = b" ".join(words)
        return n, n - len(words), hashlib.sha256(text).hexdigest(), text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 512):
                part = batch.slice(b, 512)
                found = [left(*(x.as_py() for x in row)) for row in zip(*part.columns[:3], strict=True)]
                n, removed, sha, text = zip(*found, strict=True)
                texts = pa.array(text, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[3:], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), texts], names=names)

    return inner.mapInArrow(run, schema)
