"""Residue graphs: nearest neighbours, edge features, batch-wide numbering."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EPSILON
from ..functions import vectors as V
from ..functions.scalars import rbf
from ..session import stored
from .pairs import mirror, pair_distances

# Ranks of pairs without coordinates, and where they begin.
UNRESOLVED, PER_POSITION, RESOLVED_BELOW = 1e8, 1e6, 5e7


def _ring(open_nodes: DataFrame, residues: DataFrame, radius: float) -> DataFrame:
    """chain_key, src, dst, rank: residues less than ``radius`` away from open nodes, by cubes of edge ``radius``."""
    def cell(axis: str) -> Column:
        return F.floor(F.col(axis) / radius)

    places = residues.filter("has_ca").select("chain_key", F.col("pos").alias("dst"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w"),
                                              cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    steps = [F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias(f"s{c}") for c in "xyz"]
    around = open_nodes
    for step in steps:
        around = around.select("*", step)
    around = around.select("chain_key", "src", "x", "y", "z", *[(cell(c) + F.col(f"s{c}")).alias(f"c{c}") for c in "xyz"])
    dx, dy, dz = F.col("x") - F.col("u"), F.col("y") - F.col("v"), F.col("z") - F.col("w")
    squared = dx * dx + dy * dy + dz * dz
    return around.join(places, ["chain_key", "cx", "cy", "cz"]).filter(squared < radius * radius).select(
        "chain_key", "src", "dst", F.sqrt(squared + EPSILON).alias("rank"))


def nearest_rings(residues: DataFrame, k: int, radius: float) -> DataFrame:
    """chain_key, src, dst, rank: at least the ``k`` nearest residues of each one with coordinates, itself included.

    Rounds of doubling radius: a residue is settled once ``k`` lie within the ring, for then the k-th nearest does, or all
    its chain has. Only the others go on, so the work of a round follows what is still open, and a residue is compared with
    about as many others as the last ring holds. Where a chain has fewer than ``k``, all of them are listed.
    """
    nodes = residues.filter("has_ca").select("chain_key", F.col("pos").alias("src"), "x", "y", "z")
    sizes = nodes.groupBy("chain_key").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("wanted"))
    close = mirror(pair_distances(residues, radius)).select(
        "chain_key", F.col("i").alias("src"), F.col("j").alias("dst"),
        F.sqrt(F.col("dist") * F.col("dist") + EPSILON).alias("rank"))
    itself = nodes.select("chain_key", "src", F.col("src").alias("dst"), F.lit(math.sqrt(EPSILON)).alias("rank"))
    found, todo, settled = stored(close.unionByName(itself)), nodes.join(sizes, "chain_key"), []
    while True:
        counts = found.groupBy("chain_key", "src").agg(F.count(F.lit(1)).alias("found"))
        met = todo.join(counts, ["chain_key", "src"], "left")
        enough = F.coalesce("found", F.lit(0)) >= F.col("wanted")
        left = stored(met.filter(~enough).drop("found"))
        if left.isEmpty():
            settled.append(found)
            return reduce(DataFrame.unionByName, settled)
        settled.append(found.join(left.select("chain_key", "src"), ["chain_key", "src"], "left_anti"))
        radius, todo = radius * 2, left
        found = stored(_ring(todo, residues, radius))


def knn_edges(residues: DataFrame, k: int, radius: float = 16.0) -> DataFrame:
    """The ``k`` nearest residues of each residue, itself included, ties by position.

    Pairs with coordinates rank by distance, all others after them by distance along the chain. Residues with coordinates
    find theirs in rings that grow from ``radius``. Others need only the positions around them: of 4 k positions around a
    residue of a chain that has fewer than ``k`` with coordinates, at least ``k`` are without, and any ``k`` positions do for
    a residue that has none itself. All ways are exact; the radius changes cost, not results.
    """
    if k < 1:
        raise ValueError(f"a graph needs at least one neighbour, not {k}")
    chain = Window.partitionBy("chain_key", "src").orderBy("rank", "dst")
    placed = F.col("has_ca")
    for axis in "xyz":  # coordinates that are no numbers are none
        placed = placed & (F.abs(axis) < float("inf"))
    residues = residues.withColumn("has_ca", F.coalesce(placed, F.lit(False)))
    sizes = residues.groupBy("chain_key").agg(F.count(F.lit(1)).cast("int").alias("L"), F.count_if("has_ca").alias("placed"))
    nodes = residues.select("chain_key", F.col("pos").alias("src"), "has_ca").join(sizes, "chain_key")
    reach = F.when(F.col("has_ca"), 2 * k).otherwise(k)
    around = F.explode(F.sequence(F.greatest(F.lit(0), F.col("src") - reach), F.least(F.col("L") - 1, F.col("src") + reach)))
    loose = nodes.filter(~F.col("has_ca") | (F.col("placed") < k)).select("chain_key", "src", "has_ca", around.alias("dst"))
    bare = residues.filter(~F.col("has_ca")).select("chain_key", F.col("pos").alias("dst"))
    loose = loose.filter(~F.col("has_ca")).unionByName(loose.filter("has_ca").join(bare, ["chain_key", "dst"], "left_semi")).select(
        "chain_key", "src", "dst", (UNRESOLVED + PER_POSITION * F.abs(F.col("src") - F.col("dst"))).alias("rank"))

    candidates = nearest_rings(residues, k, radius).unionByName(loose)
    return candidates.withColumn("place", F.row_number().over(chain)).filter(F.col("place") <= k).select(
        "chain_key", "src", "dst", F.col("rank").alias("dist"), (F.col("rank") < RESOLVED_BELOW).alias("resolved"))


def edge_features(edges: DataFrame, residues: DataFrame, drop_unresolved: bool = True, bins: int = 16,
                  embeddings: int = 16) -> DataFrame:
    """Distance bumps, sinusoidal offset, unit direction and missing flags per edge.

    An edge without coordinates takes the mean direction of its chain.
    """
    def end(position: str, name: str) -> DataFrame:
        return residues.select("chain_key", F.col("pos").alias(position), F.col("has_ca").alias(f"has_{position}"),
                               *[F.col(k).alias(f"{name}_{k}") for k in "xyz"])

    placed = edges.join(end("src", "a"), ["chain_key", "src"]).join(end("dst", "b"), ["chain_key", "dst"]).select(
        *edges.columns, "has_src", "has_dst", *V.fields("v", V.sub(V.named("a"), V.named("b"))))
    if drop_unresolved:
        filled = placed.filter("resolved")
    else:
        mean = placed.filter("resolved").groupBy("chain_key").agg(*[F.avg(f"v_{k}").alias(f"mean_{k}") for k in "xyz"])
        own = [F.when(F.col("resolved"), F.col(f"v_{k}")).otherwise(F.col(f"mean_{k}")).alias(f"v_{k}") for k in "xyz"]
        filled = placed.join(mean, "chain_key", "left").select(*edges.columns, "has_src", "has_dst", *own)
    offset = (F.col("src") - F.col("dst")).cast("double")
    rates = [math.exp(-t * math.log(10000.0) / embeddings) for t in range(0, embeddings, 2)]
    position = F.array(*[F.cos(offset * r) for r in rates], *[F.sin(offset * r) for r in rates])
    return filled.select(
        "chain_key", "src", "dst", "dist", rbf(F.col("dist"), 0.0, 20.0, bins).alias("rbf"), position.alias("posemb"),
        V.as_struct(V.unit(V.named("v"))).alias("u"), (~F.col("has_src")).cast("int").alias("src_missing"),
        (~F.col("has_dst")).cast("int").alias("dst_missing"))


def flatten_graph(edges: DataFrame, batches: DataFrame) -> DataFrame:
    """Edges of a batch numbered in one node range: place in batch * longest chain + position.

    ``batches`` is (batch_id, chain_key, L) with a bounded number of chains per
    batch. Edges marked -1 are dropped.
    """
    in_batch = Window.partitionBy("batch_id")
    slots = batches.select(
        "batch_id", "chain_key",
        (F.row_number().over(in_batch.orderBy("chain_key")) - 1).alias("slot"), F.max("L").over(in_batch).alias("N"))
    kept = edges.filter((F.col("src") != -1) & (F.col("dst") != -1)).join(slots, "chain_key")
    return kept.select("batch_id", "chain_key", "N", (F.col("slot") * F.col("N") + F.col("src")).alias("node_src"),
                       (F.col("slot") * F.col("N") + F.col("dst")).alias("node_dst"))


def unflatten_graph(flat: DataFrame) -> DataFrame:
    """Add the place in the batch and the positions behind the common numbering."""
    return flat.select("batch_id", "chain_key", "node_src", "node_dst", F.floor(F.col("node_src") / F.col("N")).alias("slot"),
                       (F.col("node_src") % F.col("N")).alias("src"), (F.col("node_dst") % F.col("N")).alias("dst"))
