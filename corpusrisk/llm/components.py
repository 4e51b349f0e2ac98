"""Connected components of a link table by alternating large-star and small-star steps.

Each step is one aggregation (smallest neighbour of every node) and one join of the links with it,
so a node with very many links is never gathered; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.llm.common import stage


def _with_smallest(links: DataFrame) -> DataFrame:
    """Links (u, v) with ``m``, the smallest of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    return links.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: (a, b), any order, repeats and loops allowed.  Returns (node, root) for every node
    of a link between two nodes; ``root`` is the smallest node reachable."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stage(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(_with_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        down = _with_smallest(large)  # u > v in every link: the smallest neighbour is the new centre
        small = down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = stage(small.distinct(), "small-star")
        after = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
