"""Connected components by alternating stars, as joins and partial aggregates over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflux.llm import common


def _stars(edges: DataFrame) -> bool:
    """Every u has one edge, and no v is a u: each edge leads to the least node of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("down")).where("ups > 1 or (ups = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node of an edge; label is the least node of its component.

    Each step points larger neighbours at a node's least neighbour, then smaller
    ones; the number of steps is logarithmic in the longest path. A node with
    very many edges only sends its least neighbour to them (an equi-join, split
    when skewed); no neighbour list is collected. Loops and nulls are ignored.
    """
    edge = common.stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _stars(edge):
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = common.stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edge = common.stored(small, "small-star")
    return edge.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edge.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
