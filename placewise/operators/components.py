"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.durable import cut

MAX_ROUNDS = 40


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of the neighbourhood: the larger ones, or the smaller ones and itself."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # the least is found with map-side combining and joined back, so that no neighbourhood is gathered in one place
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Self-loops, repeated edges and either direction are allowed; an empty table gives an empty one."""
    edges = edges.select("a", "b")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = cut(_star(_star(now, large=True), large=False))
        # stable once every edge is the same as after the round before
        was, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if was == mark:
            return nodes.join(now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node"), "node", "left").select(
                "node", F.coalesce("component", "node").alias("component")
            )
    raise RuntimeError(f"no end after {max_rounds} rounds")
