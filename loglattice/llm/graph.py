"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm import storage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges ``(u, v)`` with u > v.

    The large star ties each node's larger neighbours to its smallest
    neighbour; the small star does so with its smaller neighbours and itself.
    The smallest neighbour comes from a combined aggregate, so a hub's
    neighbours are never gathered in one place.
    """
    if larger:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = around.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: root is the smallest node of its component, itself included.

    Each round is written to the shared folder; rounds grow with the logarithm
    of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = storage.settle(edges, "edges")
    mark = _mark(edges)
    while True:
        before, edges = edges, storage.settle(_star(_star(edges, True), False), "edges")
        storage.forget(before)
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
