"""Operator 2, quality rules: compression bands.

A text's zstandard ratio (bytes over compressed bytes) tells repetitive from incompressible text. It
grows with length, so texts are judged among those of their length: for every half octave of bytes,
the quartiles of the ratios of all texts that pass the base rule set a band, from BELOW quartile
ranges under the lower quartile to ABOVE over the upper one. Most of a corpus being text, these are the
band of its text, whatever its languages are, and they hold for a table of any size alike. The
same is done for chunks of CHUNK bytes: a text of which more than CHUNK_SHARE of its full chunks are
outside their band is rejected, too. Wherever fewer than ENOUGH ratios stand for a band, quartiles
tell little, and only the outer bands hold: those of natural prose with a wide margin, which hold for
all texts besides. Texts of under 50 words, and those of which over half the words lie in repeated
three-word windows, fail before.

One pass over the texts; their counts and ratios are written without the texts. Quartiles come from
a histogram of ratios of 1/STEPS, which is exact, summed in the tasks and of bounded size: only it
reaches the driver. A text is handled alone, so memory is bounded by the longest text.

Defined cases: a null text counts as empty: no words, base_failed, ratio 0. Very long texts are
compressed whole. A ratio on a band's edge is inside. Repeated rows each get a row, and count each for
the quartiles. An empty table gives an empty result. Columns of docs may have any names; kept ones
named like a result's column are an error of the caller.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tidewright.llm.common import Workspace

MIN_WORDS, MAX_REPEAT_PERCENT, LEVEL, CHUNK, CHUNK_SHARE = 50, 50, 3, 4096, 0.25
STEPS, MOST_STEPS, BELOW, ABOVE, ENOUGH = 200, 4000, 4.0, 2.5, 100
#: (bytes of text below which the band holds, least ratio, largest ratio) of natural prose, with a wide margin.
OUTER = ((512, 1.05, 2.6), (2048, 1.15, 3.2), (8192, 1.3, 3.6), (65536, 1.5, 4.2), (1 << 62, 1.5, 5.0))
SYMBOLS = re.compile(rb"[#*$%&|<>]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The chunks' number among the half octaves, beyond those of any text.
CHUNKS = 2 * 63


@dataclass(frozen=True)
class Bands:
    outer: tuple[tuple[int, float, float], ...] = OUTER
    chunk_size: int = CHUNK
    chunk_share: float = CHUNK_SHARE
    below: float = BELOW
    above: float = ABOVE
    enough: int = ENOUGH
    level: int = LEVEL


@lru_cache(maxsize=4)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)


def step(data: bytes, level: int = LEVEL) -> int:
    """The ratio in whole steps of 1/STEPS."""
    return STEPS * len(data) // len(_compressor(level).compress(data)) if data else 0


def octave(n: int) -> int:
    """The number of the half octave that a length is in."""
    return int(2 * math.log2(n)) if n else 0


def outer(n: int, bands: tuple[tuple[int, float, float], ...]) -> tuple[int, int]:
    least, most = next(b[1:] for b in bands if n < b[0])
    return math.ceil(least * STEPS), math.floor(most * STEPS)


def limits(histogram: dict[int, int], bands: Bands) -> tuple[int, int] | None:
    """Least and largest step of a band, from the number of ratios by step."""
    total = sum(histogram.values())
    if total < bands.enough:
        return None
    quartiles, seen = [], 0
    for at in sorted(histogram):
        seen += histogram[at]
        while len(quartiles) < 2 and seen >= (total + 3) // 4 * (1 + 2 * len(quartiles)):
            quartiles.append(at)
    low, high = quartiles[0], quartiles[-1]
    return math.ceil(low - bands.below * (high - low)), math.floor(high + bands.above * (high - low))


def counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. bytes.split() splits at ASCII white space only."""
    words = data.split()
    n = len(words)
    bare = b"".join(words)
    chars = len(bare) - (0 if bare.isascii() else len(bare) - len(bare.decode("utf-8", "replace")))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 3:
        first: dict[tuple[bytes, bytes, bytes], int] = {}
        hit = bytearray(n)
        for i, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
            j = first.setdefault(window, i)
            if j != i:
                hit[i : i + 3] = hit[j : j + 3] = b"\1\1\1"
        repeated = hit.count(1)
    return n, chars, len(SYMBOLS.findall(bare)), len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame, keep: dict[str, Column], text: str, bands: Bands) -> DataFrame:
    """The columns named in keep, the base counts, base_failed, octave, ratio, least and most (outer), and the full chunks' ratios; all ratios in steps."""
    inner = docs.select(F.col(text).cast("binary").alias("__text"), *[c.alias(n) for n, c in keep.items()])
    schema = inner.drop("__text").schema
    for name in BASE:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean")
    for name in ("__octave", "__ratio", "__least", "__most"):
        schema = schema.add(name, "integer")
    schema = schema.add("__chunks", ArrayType(LongType()))
    names, kinds = schema.names, [pa.int64()] * 5 + [pa.bool_()] + [pa.int32()] * 4 + [pa.list_(pa.int64())]

    def judged(data: bytes) -> tuple:
        base, n, size = counts(data), len(data), bands.chunk_size
        failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
        chunks = [min(step(data[i : i + size], bands.level), MOST_STEPS) for i in range(0, n - size + 1, size)] if n > size else []
        return *base, failed, octave(n), min(step(data, bands.level), MOST_STEPS), *outer(n, bands.outer), chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[judged(t.as_py() or b"") for t in batch.column(0)], strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return inner.mapInArrow(run, schema)


def rules(docs: DataFrame, keep: dict[str, Column], text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The columns named in keep, the base counts, ratio, chunks_outside (share of the full chunks), base_failed and kept of every row."""
    ws = Workspace(docs.sparkSession, "compression")
    rows = ws.save(measured(docs, keep, text, bands), "measured")
    good = rows.filter("not base_failed")
    each = good.select(F.col("__octave").alias("octave"), F.col("__ratio").cast("long").alias("at"))
    each = each.unionAll(good.select(F.lit(CHUNKS).alias("octave"), F.explode("__chunks").alias("at")))
    histograms: dict[int, dict[int, int]] = {}
    for r in each.groupBy("octave", "at").count().collect():
        histograms.setdefault(r["octave"], {})[r["at"]] = r["count"]
    known = {k: limits(h, bands) for k, h in histograms.items()}
    edges = [known.get(k) or (0, MOST_STEPS) for k in range(CHUNKS + 1)]
    low, high = (F.array(*[F.lit(e[i]) for e in edges]) for i in (0, 1))
    band = F.col("__ratio").between(F.greatest(low[F.col("__octave")], "__least"), F.least(high[F.col("__octave")], "__most"))
    least, most = edges[CHUNKS]
    beyond = F.array_size(F.filter("__chunks", lambda x: ~x.between(least, most)))
    share = F.when(F.array_size("__chunks") > 0, beyond / F.array_size("__chunks")).otherwise(0.0)
    return rows.select(
        *[F.col(f"`{n}`") for n in keep], *BASE, (F.col("__ratio") / STEPS).alias("ratio"), share.alias("chunks_outside"), "base_failed",
        (~F.col("base_failed") & band & (share <= bands.chunk_share)).alias("kept"),
    )
