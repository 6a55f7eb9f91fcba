"""Operator 4, a quality classifier of supervised subword embeddings.

A text's features are its words, the pairs of adjacent words and the character n-grams within words
(word edges count as a character), hashed to `buckets` learned vectors. Their mean goes through a
softmax of two classes. Vectors and softmax are trained together by stochastic gradient descent in
numpy, on the driver, from a bounded sample: of each class the labelled rows with the smallest hash of
their id, at most PER_CLASS of them and at most TRAIN_BYTES of text (one row at least), as whole texts.
Their hashed features are made in the tasks; only these come to the driver, some 32 bytes for each byte
of text at worst.

Since the mean and the softmax's score are linear, scoring folds them into one number a bucket
(`buckets` floats, 1 MB, sent with the task). All rows are scored over their whole texts, in pieces of
about PIECE bytes that end with a word, so memory does not grow with a text's length; the features are
the same as those of the text in one piece.

Defined cases: null and empty texts have the end mark as their only feature, and get a score. Without
labelled rows, or documents of theirs, every score is 0.5. Several labels of one id count as their
largest; ids of equal hash go by the id. Very long texts are scored whole. A score of exactly 0.5 is
predicted 1. Repeated rows each get a row. An empty table gives an empty result. Columns of docs may
have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIMS, GRAMS, PER_CLASS, TRAIN_BYTES = 1 << 18, 10, (2, 3, 4), 1500, 6_000_000
EPOCHS, RATE, SEED, PIECE = 6, 0.5, 11, 1 << 20
PRIME, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _bucket(h: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    """Buckets 1 and up; 0 is the end mark's."""
    with np.errstate(over="ignore"):
        x = (h + np.uint64(salt)) * MIX
    return ((x >> np.uint64(33)) % np.uint64(buckets - 1)).astype(np.int64) + 1


def _features(data: bytes, buckets: int, before: np.uint64 | None = None) -> tuple[np.ndarray, np.uint64 | None]:
    """The buckets of a text's features, and its last word's hash; before is that of the word ahead of it."""
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    space = SPACE[raw]
    code = np.where(space, np.uint8(32), raw).astype(np.uint64)
    out = []
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.int64), before
    with np.errstate(over="ignore"):
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        place = np.arange(len(raw)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(raw)]))
        powers = np.cumprod(np.full(int((ends - starts).max()) + 1, PRIME, np.uint64))
        inside = ~space
        letters, group = code[inside] * powers[place[inside]], np.cumsum(ends - starts) - (ends - starts)
        word = np.add.reduceat(letters, group)
        ahead = word if before is None else np.r_[before, word]
        pair = ahead[:-1] * PRIME + ahead[1:]
        out += [_bucket(word, 1, buckets), _bucket(pair, 2, buckets)]
        for n in GRAMS:
            if len(raw) < n:
                continue
            h = code[: len(raw) - n + 1].copy()
            for k in range(1, n):
                h = h * PRIME + code[k : len(raw) - n + 1 + k]
            within = np.ones(len(h), bool)
            for k in range(1, n - 1):
                within &= inside[k : k + len(h)]
            if n == 2:
                within &= inside[: len(h)] | inside[1 : 1 + len(h)]
            out.append(_bucket(h[within], 3 + n, buckets))
    return np.concatenate(out), word[-1]


END = re.compile(rb"[ \t-\r]")


def pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end where a word does, the first such place from PIECE bytes on."""
    at = 0
    while at < len(data) or not at:
        end = END.search(data, at + PIECE)
        stop = end.start() if end else len(data)
        yield data[at:stop]
        at = max(stop, 1)


def featured(data: bytes | None, buckets: int) -> Iterator[np.ndarray]:
    """The buckets of a whole text's features, piece by piece."""
    last = None
    for piece in pieces(data or b""):
        ids, last = _features(piece, buckets, last)
        yield ids


def counted(data: bytes | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs."""
    total = np.zeros(buckets, np.int64)
    total[0] = 1
    for ids in featured(data, buckets):
        total += np.bincount(ids, minlength=buckets)
    there = np.flatnonzero(total)
    return there, total[there]


class Model:
    """Folded scores by bucket."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights.astype(np.float32)

    def score(self, data: bytes | None) -> float:
        total, n = float(self.weights[0]), 1
        for ids in featured(data, len(self.weights)):
            total += float(self.weights[ids].sum(dtype=np.float64))
            n += len(ids)
        return float(1 / (1 + np.exp(-total / n)))


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dims: int = DIMS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Softmax over mean vectors by gradient descent, a text a step; a text's step is shared by its features in proportion."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (buckets, dims)).astype(np.float32)
    softmax = rng.uniform(-0.1, 0.1, (2, dims)).astype(np.float32)
    if not samples:
        return Model(np.zeros(buckets))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(samples)):
            ids, counts, label = samples[i]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[ids]
            z = softmax @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ softmax
            softmax -= step * np.outer(p, mean)
            vectors[ids] -= step * np.outer(share / (share @ share), back)
    return Model(vectors @ (softmax[1] - softmax[0]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, train_bytes: int = TRAIN_BYTES, buckets: int = BUCKETS, **options) -> Model:
    """The model, from the labels given; hold rows out by leaving out their labels."""
    one = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("label"))
    first: dict = {}
    for value in (0, 1):
        rows = one.filter(F.col("label") == value).orderBy(F.xxhash64(F.col(doc_id)), doc_id).limit(per_class)
        first |= {r[0]: value for r in rows.select(doc_id).collect()}
    wanted = docs.filter(F.col(doc_id).isin(list(first))).select(F.col(doc_id).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n"))
    sizes = {r[0]: r[1] for r in wanted.groupBy("id").agg(F.sum("n")).collect()} if first else {}
    chosen, taken = {}, {0: 0, 1: 0}
    for i, value in first.items():
        if i in sizes and (not taken[value] or taken[value] + sizes[i] <= train_bytes):
            chosen[i] = value
            taken[value] += max(1, sizes[i])
    if not chosen:
        return fit([], buckets)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t.as_py(), buckets) for t in batch.column(1)]
            ids = pa.array([i.astype("<u4").tobytes() for i, _ in found], pa.binary())
            counts = pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, counts], names=["id", "ids", "counts"])

    rows = docs.filter(F.col(doc_id).isin(list(chosen))).select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(features, f"id {kind}, ids binary, counts binary").collect()
    got.sort(key=lambda r: (r["id"], r["ids"]))
    samples = [(np.frombuffer(r["ids"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.float64), chosen[r["id"]]) for r in got]
    return fit(samples, buckets, **options)


def score(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns named in keep, score and predicted of every row."""
    inner = docs.select(F.col(text).cast("binary").alias("__text"), *[c.alias(n) for n, c in keep.items()])
    schema = inner.drop("__text").schema.add("score", "double").add("predicted", "integer")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch.column(0)], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=names)

    return inner.mapInArrow(run, schema)
