"""Connected components of a distributed edge list; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Workspace


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) for every node of an edge list (u, v); root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, shortens the resulting chains by pointer
    jumping, and contracts the edges to the roots, until none is left. Edges shrink by half a round
    at least. Tables are written each step, which cuts lineage and gives joins plain exchanges that
    adaptive execution can split where a node has very many edges.
    """
    edges = ws.save(edges.select("u", "v").filter("u != v").distinct(), "edges")
    roots: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = ws.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = ws.save(hooks.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jumped")
            done = jumped.filter("moved").isEmpty()
            ws.drop(hooks)
            table = jumped.work_table
            hooks = jumped.drop("moved")
            hooks.work_table = table
            if done:
                break
        a, b = hooks.toDF("u", "ru"), hooks.toDF("v", "rv")
        contracted = edges.join(a, "u").join(b, "v").filter("ru != rv")
        lesser = ws.save(contracted.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        ws.drop(edges)
        edges = lesser
        if roots is None:
            roots = hooks
        else:
            moved = hooks.toDF("root", "above")
            merged = ws.save(roots.join(moved, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
            ws.drop(roots, hooks)
            roots = merged
    if roots is None:
        kind = edges.schema["u"].dataType
        roots = ws.save(edges.select(F.col("u").cast(kind).alias("node"), F.col("v").alias("root")), "roots")
    ws.drop(edges)
    return roots
