"""Operator 9, line dedup by a log-template tree.

A line is parsed along a tree of fixed depth: its number of tokens, then its first LEADING tokens.
Tokens with a digit are variable fields from the start. Below a leaf, a token is fixed at its place if
MIN_DOCS of the leaf's lines, and one in RARE of them, have it there, each line counted once for every
document that has it; other tokens are variable fields. The share keeps this rule the same at every
size: the values of a field get more frequent as a table grows, but not their shares.

A line's shape is its fixed tokens. It stands for a template as it is, and with any one token beyond
the leading ones made a field, so that a field with one frequent value among rare ones is found, too.
A template counts if CONSTANT of its tokens or more are fixed. One that is found in MIN_DOCS documents
or more recurs, and so does any line, however short, that is. Lines of recurring templates are dropped
from all documents but that with the smallest id, so no content is lost altogether.

The tree lives in tables keyed by hashes of leaves, lines and places; all steps are sums and joins on
these, so a leaf or a line that most documents have is never gathered in one task. Lines that more than
one in HOT of all entries have are at most HOT, so these are joined by broadcast, and all others by
their hashes, none of which is hot.

Defined cases: null texts have no line and stay null. Lines without a token always stay; lines of under
MIN_TOKENS recur as they stand only. Very long texts and lines are parsed whole. Rows with equal id and
text are decided alike, and of equal smallest ids all keep the line. Ids may be of any ordered type; a
null id counts as larger than any other. Columns of docs may have any names. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import WORD, Workspace, ordered_id

MIN_DOCS, LEADING, CONSTANT, MIN_TOKENS, RARE, HOT = 5, 3, 0.6, 3, 50, 10_000
FIELD = "<*>"


def _masked(line: Column) -> Column:
    """The line's tokens, joined by a space, with variable fields replaced."""
    tokens = F.regexp_extract_all(line, F.lit(WORD), F.lit(0))
    fields = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    return F.array_join(F.when(line.rlike("[0-9]"), fields).otherwise(tokens), " ")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """A row's id, and a hash of id and text that tells rows of one id apart."""
    return [ordered_id(docs, doc_id).alias("id"), F.xxhash64(F.col(text), F.col(doc_id)).alias("k")]


def _entries(docs: DataFrame, doc_id: str, text: str, leading: int) -> DataFrame:
    """(id, k, leaf, size, h1, h2, line) for each distinct masked line of each row."""
    lines = F.array_distinct(F.transform(_lines(F.col(text)), _masked))
    out = docs.select(*_keys(docs, doc_id, text), F.explode(lines).alias("line")).filter("line <> ''")
    tokens = F.split("line", " ", -1)
    leaf = F.xxhash64(F.size(tokens), F.slice(tokens, 1, leading)).alias("leaf")
    return out.select("id", "k", leaf, F.size(tokens).alias("size"), F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"), "line")


def recurring(docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, leading: int = LEADING, constant: float = CONSTANT, min_tokens: int = MIN_TOKENS, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """(rows with their lines' hashes; hashes of the lines of recurring templates, the id that keeps them, and in how many rows they are)."""
    seen = ws.save(_entries(docs, doc_id, text, leading), "lines")
    line = ["h1", "h2"]
    per_line = [F.count("*").alias("n"), F.min("id").alias("first")]
    counts = ws.save(seen.groupBy(*line).agg(F.first("leaf").alias("leaf"), F.first("size").alias("size"), *per_line), "counts")
    exact = counts.filter(F.col("n") >= min_docs).select(*line, "first", "n")
    leaves = counts.filter(F.col("size") >= min_tokens).groupBy("leaf").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    leaves = ws.save(leaves.filter((F.col("all") >= min_docs) & (F.col("kinds") > 1)).select("leaf", "all"), "leaves")

    parsed = seen.join(leaves, "leaf").groupBy(*line).agg(*[F.first(c).alias(c) for c in ("line", "leaf", "size", "all")], *per_line)
    # A place is null where the line has a field.
    place = F.transform(F.split("line", " ", -1), lambda t, i: F.when(t != FIELD, F.xxhash64(F.col("leaf"), i, t)))
    parsed = parsed.select(F.monotonically_increasing_id().alias("line"), place.alias("places"), "size", "all", "n", "first", *line)
    parsed = ws.save(parsed, "parsed")
    places = parsed.select("line", "n", "all", F.posexplode("places").alias("at", "place")).filter("place is not null")
    support = places.groupBy("place").agg(F.sum("n").alias("held"), F.first("all").alias("all"))
    fixed = ws.save(support.filter((F.col("held") >= min_docs) & (F.col("held") * rare >= F.col("all"))).select("place"), "fixed")
    standing = places.select("line", "at", "place").join(fixed, "place")
    free = F.when(F.col("at") >= leading, F.col("place"))
    shapes = standing.groupBy("line").agg(F.bit_xor("place").alias("t1"), F.bit_xor(F.xxhash64("place")).alias("t2"), F.count("*").alias("fixed"), F.collect_list(free).alias("free"))
    shapes = parsed.select("line", "size", "n", "first", *line).join(shapes, "line")
    # A shape is a sum of its places' hashes; taking one away makes it a field.
    every = F.concat(F.array(F.lit(None).cast("long")), "free")
    loose = shapes.select(*line, "n", "first", "size", "fixed", "t1", "t2", F.explode(every).alias("p")).select(
        *line, "n", "first", "size", (F.col("fixed") - F.col("p").isNotNull().cast("int")).alias("fixed"),
        F.when(F.col("p").isNull(), F.col("t1")).otherwise(F.col("t1").bitwiseXOR(F.col("p"))).alias("t1"),
        F.when(F.col("p").isNull(), F.col("t2")).otherwise(F.col("t2").bitwiseXOR(F.xxhash64("p"))).alias("t2"),
    )
    loose = ws.save(loose.filter(F.col("fixed") >= F.ceil(F.col("size") * F.lit(constant) - 1e-9)), "loose")
    kinds = loose.groupBy("t1", "t2").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.sum("n").alias("all"), F.min("first").alias("first"))
    kinds = ws.save(kinds.filter((F.col("kinds") > 1) & (F.col("all") >= min_docs)), "kinds")
    # With a frequent line a template recurs anyway; the rows of others, few a line, are counted.
    sure = kinds.filter(F.col("most") >= min_docs).select("t1", "t2", "first")
    unsure = loose.select(*line, "t1", "t2").join(kinds.filter(F.col("most") < min_docs).select("t1", "t2"), ["t1", "t2"])
    held = seen.join(unsure, line).select("t1", "t2", "id", "k").distinct()
    counted = held.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter(F.col("n") >= min_docs).select("t1", "t2", "first")
    groups = ws.save(sure.unionAll(counted), "groups")
    generalised = loose.select(*line, "t1", "t2", "n").join(groups, ["t1", "t2"]).select(*line, "first", "n")
    found = ws.save(exact.unionAll(generalised).groupBy(*line).agg(F.min("first").alias("first"), F.max("n").alias("n")), "recurring")
    ws.close(seen, found)
    return seen, found


def deduplicated(docs: DataFrame, keep: dict[str, Column], doc_id: str = "doc_id", text: str = "text", hot: int = HOT, **options) -> DataFrame:
    """The columns named in keep, n_lines, n_dropped and kept (the text without the dropped lines) of every row."""
    ws = Workspace(docs.sparkSession, "lines")
    seen, found = recurring(docs, ws, doc_id, text, **options)
    often = F.col("n") * hot > seen.count()
    entries = seen.select("id", "k", "h1", "h2")
    drops = entries.join(F.broadcast(found.filter(often)), ["h1", "h2"]).unionByName(entries.join(found.filter(~often).hint("merge"), ["h1", "h2"]))
    drops = drops.filter(F.col("id") > F.col("first")).groupBy(F.struct("id", "k").alias("__key")).agg(F.collect_set("h1").alias("drops"))
    drops = ws.save(drops, "drops")
    ws.close(drops)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"), F.struct(*_keys(docs, doc_id, text)).alias("__key"))
    rows = rows.join(drops.withColumnRenamed("drops", "__drops"), "__key", "left")
    lines = _lines(F.col("__text"))
    stays = F.filter(lines, lambda x: ~F.array_contains("__drops", F.xxhash64(F.lit(1), _masked(x))))
    rows = rows.withColumn("__kept", F.when(F.col("__drops").isNull(), lines).otherwise(stays))
    n, left = (F.coalesce(F.array_size(x), F.lit(0)).cast("long") for x in (lines, F.col("__kept")))
    return rows.select(*[F.col(f"`{c}`") for c in keep], n.alias("n_lines"), (n - left).alias("n_dropped"), F.array_join("__kept", "\n").alias("kept"))
