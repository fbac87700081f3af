"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replenish.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge in ``edges`` (a, b); root is its component's smallest node.

    Each round first ties the larger neighbours of every node to its smallest one, then the smaller
    neighbours; the edges become stars in a number of rounds that grows with the logarithm of the
    graph. A round reads and writes edges in the shared folder; the driver sees one count and one
    checksum. Hubs are joined to their one minimum, which Spark may split.
    """
    now = stored(_downward(edges.select("a", "b")), "component-edges")
    seen = None
    while True:
        now = stored(_star(_star(now, True), False), "component-edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _downward(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, each once, without loops."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = around.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low"))
    near = around.join(least, F.col("a") == F.col("hub")).withColumn("low", F.least("low", "hub"))
    moved = near.filter(F.col("b") > F.col("a")) if larger else near
    tied = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not larger:
        tied = tied.union(near.select(F.col("hub").alias("a"), F.col("low").alias("b")))
    return _downward(tied)
