"""Connected components by alternating star steps, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.session import BROADCAST_ROWS, write_stage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that occurs in ``links`` (a, b); the component is its smallest node.

    Links may repeat and go either way; loops and null ends are left out. A hub is never gathered: stars
    take the minimum of a node's neighbours, and the joins have stored sides, so that a hot node is split. Only while
    there are so few edges that one task could hold them all, the minima are not stored apart.
    """
    start = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = write_stage(start.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    apart = write_stage if edges.count() > BROADCAST_ROWS else lambda minima, _: minima
    while not _are_stars(edges):
        # Large star: larger neighbours move to the smallest node around.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = apart(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_stage(large, "large-star")
        # Small star: smaller neighbours and the node itself move to the smallest one.
        least = apart(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = write_stage(small.distinct(), "small-star")
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either points to one smaller node or is pointed to."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("n_out"), F.min("out").alias("least"))
    return nodes.where("n_out > 1 OR (n_out = 1 AND least = 0)").isEmpty()
