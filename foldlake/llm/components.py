"""Connected components of a graph given as a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node that ``links`` (a, b: bigint) names.

    Each round links the larger neighbours of a node, then its smaller ones, to the smallest neighbour. Rounds grow
    with the logarithm of the longest path. Neighbours are never listed in one place: minima are pre-aggregated, and
    the joins that follow are plain sort-merge joins, whose large keys adaptive execution splits.
    """
    oriented = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = stored(oriented)
    before = _signature(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = edges.join(least, edges["lo"] == least["u"]).select("hi", F.col("m").alias("lo")).distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(smallest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = stored(moved.union(smallest).distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
