"""Operator 1, mixing sources to target weights: prefix sums over hash-random keys, DataFrame functions only.

Sources share `share` of all words by weight. A source's target stops at `cap` times its size; the
excess is shared again by weight among the rest until no target is above its cap (the fixed point is
found in one pass over the sources, sorted by cap over weight).

Within a source, documents stand in the order of a hash-random key. Whole epochs are taken while they
fit the budget, then the documents whose prefix sum of words fits the rest; the document at the cut
gives its first words only, so a source's words meet its budget (the target's whole words) exactly.

Prefix sums are distributed: the key range is cut into buckets of about BUCKET rows of any source,
bucket sums are added up on two levels, and only a bucket's own rows are sorted together. So a source
with a third of all rows, or all, is no single task. Keys are md5 of seed and id: reruns agree.
Documents are read twice, for the sums and for the mix, which moves each once, to its bucket.

Defined cases: a null text has size 0, with ANSI mode or without; very long texts are counted whole. Sources go by code point, null last and a source of its own.
Rows that share an id are ordered by size; equal rows are interchangeable. Texts without words take
nothing. An empty table gives an empty result. Columns of docs may have any names; where the mix would
add one that docs has, `_` is appended to the added one's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import WORD, Workspace, free_name

WEIGHTS, SHARE, CAP, SEED, BUCKET = (5, 2, 1), 1.5, 2, "mix-1", 256


def words(text: Column) -> Column:
    return F.coalesce(F.array_size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source_size and target of each source, from (source, sk, source_size). One row a source goes to one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumns({"nth": F.row_number().over(by_name), "weight": weight, "most": F.col("source_size") * cap})
    level = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    before, every = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0))
    among = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = ranked.withColumn("level", left / among).withColumn("open", F.col("most") / F.col("weight") > F.col("level"))
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(every)
    target = F.least(F.col("most").cast("double"), F.coalesce(final * F.col("weight"), F.col("most").cast("double")))
    return shared.select("sk", "source_size", target.alias("target"))


def mixture(docs: DataFrame, keep: dict[str, Column], doc_id: str = "doc_id", text: str = "text", source: str = "source", bucket: int = BUCKET, seed: str = SEED, **options) -> DataFrame:
    """The columns named in keep, size, source_size, target and taken of every row."""
    ws = Workspace(docs.sparkSession, "mixing")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    sk = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    rows = docs.select(
        *[c.alias(n) for n, c in keep.items()], F.struct(F.col(doc_id).alias("id")).alias("__id"),
        F.col(source).alias("__source"), sk.alias("__sk"), key.alias("__key"), words(F.col(text)).alias("size"),
    )
    n_buckets = max(1, -(-docs.count() // bucket))
    wide, many = -(-(1 << 60) // n_buckets), max(1, round(n_buckets**0.5))
    at = F.expr(f"cast(conv(substr(__key, 1, 15), 16, 10) as bigint) div {wide}")
    rows = rows.withColumn("__b", at)

    sums = ws.save(rows.groupBy("__sk", "__b").agg(F.sum("size").alias("sum"), F.first("__source").alias("source")), "sums")
    sums = sums.withColumn("coarse", F.expr(f"__b div {many}"))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    coarse = sums.groupBy("__sk", "coarse").agg(F.sum("sum").alias("sum"))
    coarse = coarse.select("__sk", "coarse", F.sum("sum").over(upto("__sk").orderBy("coarse")).alias("far"))
    fine = sums.select("__sk", "__b", "coarse", F.sum("sum").over(upto("__sk", "coarse").orderBy("__b")).alias("near"))
    sizes = sums.groupBy(F.col("__sk").alias("sk")).agg(F.first("source").alias("source"), F.sum("sum").alias("source_size"))
    goals = targets(sizes, **options).withColumnRenamed("sk", "__sk")
    begins = F.coalesce("far", F.lit(0)) + F.coalesce("near", F.lit(0))
    starts = ws.save(fine.join(coarse, ["__sk", "coarse"]).join(goals, "__sk").select("__sk", "__b", begins.alias("__begins"), "source_size", "target"), "starts")

    order = Window.partitionBy("__sk", "__b").orderBy("__key", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__begins") + F.coalesce(F.sum("size").over(order), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - before))
    placed = rows.join(starts, ["__sk", "__b"]).withColumn("taken", (epochs * F.col("size") + part).cast("long"))
    return placed.select(*[F.col(n) for n in keep], "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with its epoch (from 1) and the words taken.

    The document at a source's cut has only its first words as text, joined by a space.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = mixture(docs, {"__row": whole}, text=text, **options).filter("taken > 0")
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    each = rows.select("__row", "size", "taken", F.explode(copies).alias("__epoch"))
    each = each.withColumn("__words", F.least(F.col("size"), F.col("taken") - (F.col("__epoch") - 1) * F.col("size")))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("__row")[text], F.lit(WORD), F.lit(0)), F.lit(1), F.col("__words").cast("int")), " ")
    kept = F.when(F.col("__words") < F.col("size"), cut).otherwise(F.col("__row")[text])
    columns = [(kept if c == text else F.col("__row")[c]).alias(c) for c in docs.columns]
    return each.select(*columns, F.col("__epoch").alias(free_name("epoch", docs.columns)), F.col("__words").alias(free_name("words", docs.columns)))
