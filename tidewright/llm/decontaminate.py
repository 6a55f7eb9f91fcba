"""Operator 8, benchmark decontamination: a prefix-filtered join of shingle sets, DataFrame functions only.

An item's windows (ten consecutive terms; all of a shorter item) are looked for in every text. A
window is the set of its five-term shingles. For exact containment the necessary prefix is a single
shingle: the rarest one over all texts, found by counting every item shingle in all documents. A
window with a shingle that no text has is dropped at once. Occurrences of the prefix shingle are
joined with the windows, cut by position (the window must not start before the text) and length (it
must end within it), and verified term by term.

Documents are read once. Each text's shingle hashes are tested against the item shingles where they
are made, and only hits are kept, with the terms around them. Up to MAX_LITERAL item shingles are
sent along as a hash set in the plan; beyond that the hits come from a shuffled join with the same
result (a choice of plan by the benchmark's size, not by the documents'; tests run both). Counting, ranking, verification and summing-up are joins and sums of hits only.

Defined cases: null or empty texts and items have no terms and no windows; very long texts are read whole.
Of shingles equally rare, the first in the window is its prefix. Columns of docs may have any names. Repeated rows each get
their own row; repeated items count once an id. An item's null id is left out of n_items. Without
items nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import TERM, Workspace, ascii_lower, row_key

WINDOW, SHINGLE = 10, 5
#: Item shingles sent with the plan: 8 bytes each, under 1 MB.
MAX_LITERAL = 100_000


def terms(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item_id, win): every window of every item."""
    words = items.select(F.col(item_id).cast("string").alias("item_id"), terms(F.col(text)).alias("w")).filter(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(window))
    return words.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.slice("w", i, width))).alias("win"))


def _hashes(terms: Column, k: int) -> Column:
    """(pos, h) of every shingle of k terms, from the terms' hashes: each term is hashed once, not k times."""
    n = F.size(terms)
    every = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(terms, i + j) for j in range(k)]).alias("h")))
    return F.when(n >= k, every).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def _term_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _window_hash(words: Column, most: int) -> Column:
    """The hash that _hashes gives a shingle of all these terms, at most so many."""
    out = F.lit(None).cast("long")
    for k in range(most, 0, -1):
        out = F.when(F.size(words) == k, F.xxhash64(*[F.xxhash64(F.get(words, F.lit(j))) for j in range(k)])).otherwise(out)
    return out


def _around(words: Column, hit: Column, k: Column, window: int) -> Column:
    """A hit with the terms that a window around it may hold."""
    at = F.greatest(hit["pos"] - (F.lit(window) - k), F.lit(0))
    return F.struct(hit["pos"].alias("pos"), hit["h"].alias("h"), at.alias("at"), F.slice(words, at + 1, F.lit(2 * window) - k).alias("around"))


def _hits(words: Column, hashes: Column, k: int, wanted: list[int], window: int) -> Column:
    hits = F.filter(_hashes(hashes, k), lambda x: x["h"].isin(wanted))
    return F.transform(hits, lambda x: _around(words, x, F.lit(k), window))


def _scan(docs: DataFrame, keep: dict[str, Column], text: str, shingles: DataFrame, ws: Workspace, window: int, max_literal: int) -> tuple[DataFrame, DataFrame]:
    """All rows (rid, n_words, keep) and the hits of item shingles in them (rid, n_words, pos, h, at, around)."""
    per_k = {r["k"]: r["n"] for r in shingles.groupBy("k").agg(F.count("*").alias("n")).collect()}
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], terms(F.col(text)).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    rows = rows.withColumn("hashes", _term_hashes(F.col("words")))
    words, hashes = F.col("words"), F.col("hashes")
    if sum(per_k.values()) <= max_literal:
        found = []
        for k in sorted(per_k):
            wanted = [r["h"] for r in shingles.filter(F.col("k") == k).select("h").collect()]
            found.append(_hits(words, hashes, k, wanted, window))
        empty = F.array().cast("array<struct<pos:int,h:bigint,at:int,around:array<string>>>")
        saved = ws.save(rows.withColumn("hits", F.flatten(F.array(*found)) if found else empty).drop("words", "hashes").withColumn("rid", F.monotonically_increasing_id()), "scan")
        hits = saved.select("rid", "n_words", F.explode("hits").alias("x")).select("rid", "n_words", "x.*")
        return saved.drop("hits"), hits
    saved = ws.save(rows.drop("hashes").withColumn("rid", F.monotonically_increasing_id()), "scan")
    ours = F.flatten(F.array(*[_hashes(hashes, k) for k in sorted(per_k)]))
    placed = saved.withColumn("hashes", _term_hashes(words)).select("rid", F.explode(ours).alias("x")).select("rid", "x.pos", "x.h")
    found = placed.join(shingles, "h").select("rid", F.struct("pos", "h", "k").alias("hit"))
    lists = ws.save(found.groupBy("rid").agg(F.collect_list("hit").alias("hits")), "found")
    back = saved.select("rid", "n_words", "words").join(lists, "rid")
    hits = back.select("rid", "n_words", "words", F.explode("hits").alias("x")).select("rid", "n_words", _around(words, F.col("x"), F.col("x")["k"], window).alias("y"))
    return saved.drop("words"), hits.select("rid", "n_words", "y.*")


def contamination(docs: DataFrame, items: DataFrame, keep: dict[str, Column], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, max_literal: int = MAX_LITERAL) -> DataFrame:
    """The columns named in keep, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    owners = item_windows(items, item_id, item_text, window).distinct()
    owners = ws.save(owners.withColumn("win_id", F.sha2(F.to_json(F.col("win")), 256)), "owners")
    windows = owners.select("win_id", "win").dropDuplicates(["win_id"])
    k = F.least(F.size("win"), F.lit(shingle))
    parts = windows.select("win_id", "win", k.alias("k")).select(
        "win_id", "win", "k", F.explode(F.transform(F.sequence(F.lit(0), F.size("win") - F.col("k")), lambda i: F.struct(i.alias("off"), _window_hash(F.slice("win", i + 1, F.col("k")), shingle).alias("h")))).alias("x")
    )
    parts = ws.save(parts.select("win_id", "win", "k", "x.off", "x.h"), "parts")
    shingles = ws.save(parts.select("h", "k").distinct(), "shingles")
    rows, hits = _scan(docs, keep, text, shingles, ws, window, max_literal)

    seen = hits.groupBy("h").agg(F.count("*").alias("seen"))
    ranked = parts.join(ws.save(seen, "seen"), "h", "left")
    order = F.struct(F.col("seen"), F.col("off"))
    prefix = ranked.groupBy("win_id").agg(F.min_by(F.struct("off", "h", "win"), order).alias("p"), F.count_if(F.col("seen").isNull()).alias("absent"))
    prefix = ws.save(prefix.filter("absent = 0").select("win_id", "p.*"), "prefix")

    joined = hits.join(prefix, "h").withColumn("start", F.col("pos") - F.col("off"))
    inside = (F.col("start") >= 0) & (F.col("start") + F.size("win") <= F.col("n_words"))
    same = F.slice("around", F.greatest(F.col("start") - F.col("at") + 1, F.lit(1)), F.size("win")) == F.col("win")
    spans = ws.save(joined.filter(inside & (F.col("start") >= F.col("at")) & same).select("rid", "win_id", "start", F.size("win").alias("n")), "spans")

    covered = spans.select("rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    named = spans.select("rid", "win_id").distinct().join(owners.filter("item_id is not null").select("win_id", "item_id"), "win_id").select("rid", "item_id").distinct()
    listed = named.groupBy("rid").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item_id"))).alias("ids"))
    zero = F.lit(0).cast("long")
    out = rows.join(covered, "rid", "left").join(listed, "rid", "left").select(
        *[F.col(n) for n in keep], "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
    return out


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, whole, in which no window of an item occurs."""
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    found = contamination(docs, items, {"k1": k1, "k2": k2}, text, **options).filter("contaminated").select("k1", "k2").distinct()
    found = Workspace(docs.sparkSession, "decontaminated").save(found, "found")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("row"), k1, k2).join(found, ["k1", "k2"], "left_anti").select("row.*")
