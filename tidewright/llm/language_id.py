"""Operator 10, language ID by hyperdimensional profiles.

Every letter has a random +1/-1 vector. A trigram binds three of them, permuted (rolled) by their
place; a text bundles (adds) the vectors of all its trigrams; a language's prototype bundles all
training texts. A text gets the language whose prototype has the largest cosine with it.

All sums are of whole numbers, so results do not depend on partitioning or order. The prototypes
use all training rows, and only (language, dimension, sum) rows reach the driver: one vector a
language. Long texts are bundled in segments, so memory does not grow with a text's length.

Defined cases: text null or without a letter gives ("und", 0.0). Ties go to the smaller language
name. Without any training row all texts give "und". Repeated rows and other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS, SEED = 1024, 20240607
UNKNOWN = "und"
SEGMENT, BATCH_CHARS, BATCH_TEXTS, BLOCK = 400_000, 400_000, 128, 4096
#: Letters up to this code point have vectors of their own, others share as many by remainder.
PLAIN, SHARED = 0x250, 4096


@lru_cache(maxsize=1)
def letter_ids() -> np.ndarray:
    """By code point: 0 for no letter, else the number of the lower-case letter's vector."""
    ids = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            ids[c] = low if low < PLAIN else PLAIN + low % SHARED
    return ids


@lru_cache(maxsize=4)
def letter_vectors(dims: int, seed: int) -> np.ndarray:
    """0 stands for the edge of a word and has a vector, too."""
    bits = np.random.default_rng(seed).integers(0, 2, (PLAIN + SHARED, dims), np.int8)
    return bits * np.int8(2) - np.int8(1)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, str, int, int]]:
    """(text's number, piece, characters of context before and after) covering every character once."""
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), SEGMENT):
            end = min(len(text), at + SEGMENT)
            yield i, text[max(0, at - 1) : end + 1], int(at > 0), int(end < len(text))


def bundle(texts: list[str | None], dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vector and number of trigrams of each text."""
    out, n = np.zeros((len(texts), dims), np.float64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, str, int, int]] = []
    chars = 0
    for piece in pieces(texts):
        held.append(piece)
        chars += len(piece[1])
        if chars >= BATCH_CHARS or len(held) >= BATCH_TEXTS:
            _bundle(held, dims, seed, out, n)
            held, chars = [], 0
    if held:
        _bundle(held, dims, seed, out, n)
    return out, n


def _bundle(held: list[tuple[int, str, int, int]], dims: int, seed: int, out: np.ndarray, n: np.ndarray) -> None:
    lengths = np.array([len(p[1]) + 1 for p in held])
    code = np.frombuffer(("\0" + "".join(p[1] + "\0" for p in held)).encode("utf-32-le"), np.uint32)
    letters = letter_ids()[code]
    ends = np.cumsum(lengths)
    centre = letters != 0
    for (_, _, before, after), end, length in zip(held, ends, lengths, strict=True):
        if before:
            centre[end - length + 1] = False
        if after:
            centre[end - 1] = False
    at = np.flatnonzero(centre)
    if not len(at):
        return
    seen = np.zeros(PLAIN + SHARED, bool)
    seen[letters] = True
    alphabet = np.flatnonzero(seen)
    k = len(alphabet)
    dense = np.zeros(PLAIN + SHARED, np.int64)
    dense[alphabet] = np.arange(k)
    small = dense[letters]
    tri = (small[at - 1] * k + small[at]) * k + small[at + 1]
    if k**3 <= 4_000_000:
        there = np.zeros(k**3, bool)
        there[tri] = True
        distinct = np.flatnonzero(there)
        place = np.zeros(k**3, np.int32)
        place[distinct] = np.arange(len(distinct), dtype=np.int32)
        tri = place[tri]
    else:
        distinct, tri = np.unique(tri, return_inverse=True)
    row = np.searchsorted(ends, at, side="left")
    u = len(distinct)
    pair = row.astype(np.int64) * u + tri
    counts = np.bincount(pair, minlength=len(held) * u).reshape(len(held), u)
    vectors = letter_vectors(dims, seed)
    first, second, third = (alphabet[distinct // k**2], alphabet[distinct // k % k], alphabet[distinct % k])
    sums = np.zeros((len(held), dims), np.float32)
    for b in range(0, u, BLOCK):
        s = slice(b, b + BLOCK)
        bound = np.roll(vectors[first[s]], 2, axis=1) * np.roll(vectors[second[s]], 1, axis=1) * vectors[third[s]]
        sums += counts[:, s].astype(np.float32) @ bound.astype(np.float32)
    whose = np.array([p[0] for p in held])
    np.add.at(out, whose, sums)
    np.add.at(n, whose, counts.sum(axis=1))


class Profiles:
    """Language prototypes."""

    def __init__(self, names: list[str], vectors: np.ndarray, seed: int = SEED) -> None:
        self.names, self.seed = names, seed
        self.dims = vectors.shape[1]
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.unit = vectors / np.where(norm == 0, 1, norm)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for b in range(0, len(texts), 1024):
            vectors, n = bundle(texts[b : b + 1024], self.dims, self.seed)
            norm = np.linalg.norm(vectors, axis=1)
            for v, count, length in zip(vectors, n, norm, strict=True):
                if not count or not self.names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = np.round(self.unit @ v / (length or 1.0), 9)
                best = int(np.argmax(cosines))
                langs.append(self.names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
        return langs, scores


def train(rows: DataFrame, text: str, lang: str, dims: int = DIMS, seed: int = SEED) -> Profiles:
    """Prototypes from all rows with both columns. A task sums before it sends, one vector a language."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for b in range(0, len(texts), 1024):
                vectors, _ = bundle(texts[b : b + 1024], dims, seed)
                part = langs[b : b + 1024]
                for name in set(part):
                    totals[name] = totals.get(name, 0) + vectors[part == name].sum(axis=0)
        for name, v in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.rint(v).astype(np.int64))],
                names=["lang", "dim", "value"],
            )

    both = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    table = (
        both.mapInArrow(sums, "lang string, dim int, value long")
        .groupBy("lang", "dim").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v"))
        .select("lang", "v.value").collect()
    )
    table.sort(key=lambda r: r[0])
    vectors = np.array([r[1] for r in table], np.float64).reshape(len(table), dims)
    return Profiles([r[0] for r in table], vectors, seed)


def identify(docs: DataFrame, text: str, profiles: Profiles, keep: dict[str, Column], lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """The columns named in keep, and each row's language and cosine."""
    inner = docs.select(F.col(text).alias("__text"), *[c.alias(n) for n, c in keep.items()])
    schema = inner.drop("__text").schema.add(lang_as, "string").add(score_as, "double")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = profiles.score(batch.column(0).to_pylist())
            columns = [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return inner.mapInArrow(run, schema)
