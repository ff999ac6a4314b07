"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _nearest(edges: DataFrame) -> DataFrame:
    """``u, m``: the smallest of a node and its neighbours ``v``."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component_id`` (smallest reachable id) of every node that has a link.

    Large-star and small-star steps in turn: every node hands its larger neighbours, then
    its smaller ones, to the smallest node it sees.  The number of edges never grows and
    the number of rounds is logarithmic.  Minima are stored before they are joined, so
    that Spark can split the rows of a node with very many links over several tasks.
    """
    edges = stored(links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(_nearest(both), "star")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "edges")
        low = stored(_nearest(large), "star")
        down = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("h"), F.sum(F.xxhash64("v", "u") % 999983).alias("k")).first()
        if (sums["n"], sums["h"], sums["k"]) == mark:
            break
        mark = (sums["n"], sums["h"], sums["k"])
    root = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(root)
