"""Operator 6, SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits: bit i is 1 if it is set in over half of the hashes of the text's
word shingles. Texts link if their fingerprints differ in at most `distance` bits.

Cut into s segments with distance < 2 s, some segment of two linked fingerprints differs by at most
one bit. Each segment is therefore indexed under every variant that leaves one of its bits out: two
fingerprints link only if they share such a variant. An equality join on variants finds the pairs, a
bit count verifies them. Each pair is taken at its first common variant only. For 4 bits that is 3
segments of 21 or 22 bits, in place of the 5 segments of 12 or 13 that exact segments would need.

Equal fingerprints are joined before, so a group of copies costs one row. Components are found
among distinct fingerprints.

Defined cases: null and empty texts have fingerprint 0, linked like any other; a text of fewer words
than a shingle has one shingle, all its words. A component's id is the smallest id in it, null only
if all are null. Repeated rows are rows like others. Any table, empty ones too, gives a row a row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from xxhash import xxh64_intdigest

from tidewright.llm.common import Workspace
from tidewright.llm.components import connected_components

SHINGLE, SEED, BITS, DISTANCE = 4, 42, 64, 4
BLOCK = 1 << 16
#: For a pipeline's stage: five-word shingles, verified similarity, eight segments of 8 bits, each salted with two least hashes.
STAGE_SHINGLE, SIMILARITY, STAGE_PARTS, DEPTH, SALT_BLOCK = 5, 0.8, 8, 2, 1 << 14
#: Words of the wide fingerprint, and how many standard deviations beyond its expected distance a pair is still checked;
#: sets of under FEW shingles are always checked, as their fingerprints scatter more.
WIDE, SPREAD, FEW, WIDE_BLOCK = 32, 3, 8, 512


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned. bytes.lower and bytes.split know ASCII only, as the rule asks."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    width = min(shingle, len(words))
    counts = np.zeros(BITS, np.int64)
    n = len(words) - width + 1
    for b in range(0, n, BLOCK):
        stop = min(n, b + BLOCK)
        spans = zip(starts[b:stop].tolist(), ends[b + width - 1 : stop + width - 1].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(flat[i:j], seed) for i, j in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, keep: dict[str, Column], shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns named in keep and `fp`, the fingerprint as a signed long."""
    inner = docs.select(F.col(text).cast("binary").alias("__text"), *[c.alias(n) for n, c in keep.items()])
    schema = inner.drop("__text").schema.add("fp", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps)], names=names)

    return inner.mapInArrow(run, schema)


def segments(distance: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v), u < v: all pairs of distinct fingerprints (column fp) at most so many bits apart, each once."""
    parts = segments(distance)
    masks = [((1 << w) - 1) << a for a, w in parts]
    variants = F.array(*[
        F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(m & ~(1 << j)))).alias("rest"))
        for (a, w), m in zip(parts, masks, strict=True) for j in range(a, a + w)
    ])
    index = fps.select("fp", F.explode(variants).alias("x")).select(F.col("x.j").alias("j"), F.col("x.rest").alias("rest"), "fp")
    a, b = index.alias("a"), index.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # Equal on both sides; naming both keeps the optimizer from filtering one side only, so both share one exchange.
    bit = F.greatest("a.j", "b.j")
    first = F.lit(False)
    before = F.lit(True)
    for (at, w), m in zip(parts, masks, strict=True):
        here = bit.between(at, at + w - 1)
        differs = x.bitwiseAND(F.lit(_signed(m)))
        first = first | (here & before & ((bit == at) | (differs != 0)))
        before = before & (F.bit_count(differs) > 1)
    same = (F.col("a.j") == F.col("b.j")) & (F.col("a.rest") == F.col("b.rest"))
    # Spark's estimate leaves out that each fingerprint has as many rows as bits, and would broadcast them all.
    pair = a.join(b.hint("merge"), same & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= distance) & first)
    return pair.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def classes(rows: DataFrame, ws: Workspace, distance: int = DISTANCE) -> DataFrame:
    """(fp, component_id, component_fp) of each distinct fingerprint, from rows (doc_id, fp)."""
    fps = ws.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = connected_components(links(fps.select("fp"), distance), ws)
    placed = ws.save(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("component_fp")), "placed")
    ids = placed.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    out = ws.save(placed.join(ids, "component_fp").select("fp", "component_id", "component_fp"), "classes")
    ws.drop(fps, roots, placed)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    ws = Workspace(docs.sparkSession, "simhash")
    rows = ws.save(fingerprints(docs, text, {"doc_id": F.col(doc_id)}), "rows")
    found = classes(rows, ws, distance).select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(data: bytes | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the text's shingles, in order; none without a word."""
    words = (data or b"").lower().split()
    width = min(shingle, len(words))
    grams = (b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)) if words else ()
    return np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows' hashes, as words of 64 bits."""
    counts = np.zeros(BITS * hashes.shape[1], np.int64)
    for b in range(0, len(hashes), BLOCK // hashes.shape[1]):
        part = np.ascontiguousarray(hashes[b : b + BLOCK // hashes.shape[1]], "<u8")
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def salts(hashes: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """For each segment a hash of the least values of DEPTH hash functions over the shingles."""
    random = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, (3, parts * DEPTH, 1), np.uint64)
    times, plus, mix = 2 * random[0] + 1, random[1], 2 * random[2, :, 0] + 1
    least = np.full(parts * DEPTH, (1 << 64) - 1, np.uint64)
    for b in range(0, len(hashes), SALT_BLOCK):
        mixed = hashes[b : b + SALT_BLOCK] * times + plus
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    return (least * mix).reshape(parts, DEPTH).sum(axis=1, dtype=np.uint64)


def signatures(docs: DataFrame, text: str, keep: dict[str, Column], shingle: int, parts: int, seed: int = SEED) -> DataFrame:
    """The columns named in keep, `node` (a hash of the text's words), `fp` and `salts` (null without a word)."""
    inner = docs.select(F.col(text).cast("binary").alias("__text"), *[c.alias(n) for n, c in keep.items()])
    schema = inner.drop("__text").schema.add("node", "long").add("fp", "long").add("salts", ArrayType(LongType()))
    names = schema.names

    def signed(data: bytes | None) -> tuple[int, int, list[int] | None]:
        node = xxh64_intdigest(b" ".join((data or b"").lower().split()), seed)
        hashes = shingle_hashes(data, shingle, seed)
        if not len(hashes):
            return _signed(node), 0, None
        return _signed(node), int(majority(hashes[:, None]).view(np.int64)[0]), salts(hashes, parts, seed).view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(t.as_py()) for t in batch.column(0)]
            node, fp, salt = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(salt, pa.list_(pa.int64()))], names=names)

    return inner.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, text: str, node: Column, shingle: int, wide: int, seed: int = SEED) -> DataFrame:
    """node, `shingles` (the distinct hashes of the text's shingles), and w0, w1, ...: a fingerprint of `wide` words of 64 bits."""
    inner = docs.select(F.col(text).cast("binary").alias("__text"), node.alias("node"))
    schema = StructType([StructField("node", LongType()), StructField("shingles", ArrayType(LongType())), *[StructField(f"w{i}", LongType()) for i in range(wide)]])
    names = schema.names
    random = np.random.Generator(np.random.PCG64(seed + 1)).integers(0, 1 << 63, (2, 1, wide), np.uint64)
    times, more = 2 * random[0] + 1, 2 * random[1] + 1

    def widened(hashes: np.ndarray) -> np.ndarray:
        counts = np.zeros(BITS * wide, np.int64)
        for b in range(0, len(hashes), WIDE_BLOCK):
            mixed = (hashes[b : b + WIDE_BLOCK, None] ^ (hashes[b : b + WIDE_BLOCK, None] >> np.uint64(29))) * times
            mixed = (mixed ^ (mixed >> np.uint64(32))) * more
            mixed ^= mixed >> np.uint64(29)
            counts += np.unpackbits(np.ascontiguousarray(mixed, "<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8").view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 256):
                part = batch.slice(b, 256)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle, seed)) for t in part.column(0)]
                prints = np.array([widened(s) for s in sets]).reshape(len(sets), wide)
                shingles = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(1), shingles, *[pa.array(np.ascontiguousarray(prints[:, i])) for i in range(wide)]], names=names)

    return inner.mapInArrow(run, schema)


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets (node, shingles) have this Jaccard similarity or more."""
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    joined = pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v")
    both = F.size(F.array_intersect("a", "b"))
    return joined.filter(both >= F.lit(similarity) * (F.size("a") + F.size("b") - both)).select("u", "v")


def _salted(nodes: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(node, seg, lead, key): a node's one-wildcard variants of each segment, each with the segment's salt; lead marks its first."""
    variants = [
        F.struct(F.lit(i).alias("seg"), F.lit(j == a).alias("lead"), F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(_signed((((1 << w) - 1) << a) & ~(1 << j)))), F.col("salts")[i]).alias("key"))
        for i, (a, w) in enumerate(parts) for j in range(a, a + w)
    ]
    return nodes.filter("salts is not null").select("node", F.explode(F.array(*variants)).alias("x")).select("node", "x.seg", "x.lead", "x.key")


def _first_meeting(parts: list[tuple[int, int]]) -> Column:
    """Whether the key at hand (a's seg, mask, lead) is the first that rows a and b (fp, s0, s1, ...) have in common."""
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.lit(len(parts))
    for i, (at, w) in reversed(list(enumerate(parts))):
        meets = (F.col(f"a.s{i}") == F.col(f"b.s{i}")) & (F.bit_count(x.bitwiseAND(F.lit(_signed(((1 << w) - 1) << at)))) <= 1)
        first = F.when(meets, i).otherwise(first)
    return (F.col("a.lead") | (x.bitwiseAND(F.col("a.mask")) != 0)) & (first == F.col("a.seg"))


def similar_nodes(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], ws: Workspace, similarity: float = SIMILARITY, parts: int = STAGE_PARTS, wide: int = WIDE) -> DataFrame:
    """(node, root) of the nodes (node, fp, salts) that are linked to others; sets gives shingle_sets of some nodes.

    A group of n near copies has about n^2 links, so not all are made. First each node is held against
    the least node that it shares a variant with. Then, of variants that still hold nodes of different
    components, all pairs across components are held against each other: no link between components is
    left out, and within one none is needed. Pairs whose wide fingerprints are too far apart are dropped
    in the join itself; the others' sets are compared exactly.
    """
    cut = [(BITS * i // parts, BITS * (i + 1) // parts - BITS * i // parts) for i in range(parts)]
    index = _salted(nodes, cut)
    hubs = index.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter("hub < most").select("key", "hub")
    members = ws.save(index.join(hubs, "key"), "members")
    known = ws.save(sets(members.select("node").distinct()), "sets")
    prints = [f"w{i}" for i in range(wide)]
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most = int(BITS * wide * angle + SPREAD * (BITS * wide * angle * (1 - angle)) ** 0.5)

    def apart(a: str, b: str) -> Column:
        return functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in prints])

    spokes = members.filter("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    def close(a: str, b: str) -> Column:
        return (apart(a, b) <= most) | (F.col(f"{a}.n") < FEW) | (F.col(f"{b}.n") < FEW)

    sketch = known.select("node", F.size("shingles").alias("n"), *prints)
    a, b = sketch.alias("a"), sketch.alias("b")
    near = spokes.join(a.hint("merge"), F.col("u") == F.col("a.node")).join(b.hint("merge"), F.col("v") == F.col("b.node")).filter(close("a", "b")).select("u", "v")
    found = ws.save(similar(ws.save(near, "near"), known, similarity), "links")
    roots = connected_components(found, ws)

    rooted = members.join(roots.hint("merge"), "node", "left").select("key", "seg", "lead", "node", F.coalesce("root", "node").alias("root"))
    rooted = ws.save(rooted, "rooted")
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    masks = F.element_at(F.array(*[F.lit(_signed(((1 << w) - 1) << at)) for at, w in cut]), F.col("seg") + 1)
    signed = nodes.select("node", "fp", *[F.col("salts")[i].alias(f"s{i}") for i in range(parts)])
    contested = rooted.join(open_keys.hint("merge"), "key").withColumn("mask", masks).join(signed.hint("merge"), "node").join(sketch.hint("merge"), "node")
    contested = ws.save(contested, "contested")
    a, b = contested.alias("a"), contested.alias("b")
    across = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
    meet = across & _first_meeting(cut)
    pairs = a.join(b.hint("merge"), meet & (apart("a", "b") <= most))
    # A set of under FEW shingles is similar to none of 2 FEW or more.
    small, other = (contested.filter(F.col("n") < 2 * FEW).alias(x) for x in ("a", "b"))
    few = small.join(other.hint("merge"), meet & (F.least("a.n", "b.n") < FEW) & (apart("a", "b") > most))
    pairs = pairs.unionAll(few).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    more = ws.save(similar(ws.save(pairs, "pairs"), known, similarity), "more")
    # Components are joined by their roots.
    ends = more.join(roots.withColumnsRenamed({"node": "u", "root": "ru"}), "u", "left").join(roots.withColumnsRenamed({"node": "v", "root": "rv"}), "v", "left")
    tops = connected_components(ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).distinct(), ws)
    every = roots.unionAll(tops.select("node", F.col("node").alias("root"))).dropDuplicates(["node"])
    return ws.save(every.join(tops.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "similar")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component stays, whole: that with the smallest id (nulls last), and of that id the smallest hash.

    Texts of the same words (A-Z lower-cased) are one node. Others link if their shingles' Jaccard
    similarity is enough, which is checked exactly for every link. Candidates share a segment of the
    fingerprint but for one bit at most, and the segment's salt, a hash of DEPTH least values of hash
    functions over their shingles: texts without a shingle in common never meet, however many there are.
    Of two texts at similarity 0.8, a segment differs by at most one bit for 65 % and its salt agrees
    for 64 %, so that one of eight such keys agrees for 98.7 % or more, and all do nearly above.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    k = F.xxhash64(F.col(text), F.col(doc_id))
    rows = ws.save(signatures(docs, text, {"doc_id": F.col(doc_id), "k": k}, shingle, STAGE_PARTS), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("first")
    nodes = ws.save(rows.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("salts").alias("salts")), "nodes")
    repeated = not rows.groupBy("doc_id", "k").count().filter("count > 1").isEmpty()
    key = F.struct(F.col(doc_id).alias("doc_id"), k.alias("k"))

    def sets(wanted: DataFrame) -> DataFrame:
        places = ws.save(nodes.join(wanted, "node", "left_semi").select("node", F.struct("first.doc_id", "first.k").alias("__key")), "places")
        texts = docs.select(key.alias("__key"), F.col(text).alias("__t")).join(places.hint("merge"), "__key")
        return shingle_sets(texts.dropDuplicates(["node"]) if repeated else texts, "__t", F.col("node"), shingle, WIDE)

    found = similar_nodes(nodes, sets, ws, similarity)
    ahead = nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    winners = ws.save(ahead.select(F.struct("first.doc_id", "first.k").alias("__key")), "winners")
    ws.close(winners)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(whole.alias("__row"), key.alias("__key"))
    kept = keyed.join(winners.hint("merge"), "__key", "left_semi")
    return (kept.dropDuplicates(["__key"]) if repeated else kept).select("__row.*")
