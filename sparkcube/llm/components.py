"""Connected components of a link table, without collecting links: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcube.llm._shared import join_skewed, written


def _signature(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return row[0], row[1] or 0, row[2] or 0


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label): for every node of links (u, v), the smallest node that it reaches. Repeated, reversed and self links are harmless.

    Each step shrinks the links to stars around smaller nodes; minima are aggregated before the shuffle, links of hubs stay where they
    are (the minima of hubs are broadcast, see join_skewed), each step's result is a table in the shared folder, and the steps end when
    the links no longer change.
    """
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = _signature(edges)
    count = F.count(F.lit(1)).alias("n")
    while before[0]:
        # large star: each neighbour that is larger than the node is tied to the node's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), count)
        large = join_skewed(both.where("v > u"), least, ["u"], "n", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "links")
        # small star: a node and its smaller neighbours are tied to the smallest of them; all links point to smaller nodes here
        low = large.groupBy("u").agg(F.min("v").alias("m"), count)
        small = join_skewed(large, low, ["u"], "n", before[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
