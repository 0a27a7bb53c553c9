"""Length bins and batches of chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SEED
from ..functions.ordering import hash_pieces, ordinal, range_pieces
from ..functions.scalars import seeded


def length_edges(chains: DataFrame) -> list[int]:
    """Exact 20/40/60/80 percentiles of the lengths, cut to integers, without repeats.

    Equal lengths are counted first, so the percentile works on one row per
    distinct length. At most four numbers come back.
    """
    counts = chains.groupBy("L").agg(F.count(F.lit(1)).alias("n"))
    points = counts.agg(F.expr("percentile(L, array(0.2, 0.4, 0.6, 0.8), n)").alias("p")).first()["p"]
    return sorted({int(p + 1e-9) for p in points or []})


def length_bin(length: Column, edges: list[int]) -> Column:
    """Number of edges below the length: bins are open on the left."""
    return sum((F.when(length > e, 1).otherwise(0) for e in edges), F.lit(0))


def length_bins(chains: DataFrame, edges: list[int] | None = None) -> DataFrame:
    return chains.withColumn("bin", length_bin(F.col("L"), length_edges(chains) if edges is None else edges))


def bucket_batches(chains: DataFrame, size: int, seed: int | None = SEED, edges: list[int] | None = None, order: str | None = None) -> DataFrame:
    """Batches of ``size`` chains of one length bin, shuffled inside the bin, or by the numeric column ``order`` without a seed.

    A bin holds a fifth of everything, so places are found piece by piece.
    """
    hashed = length_bins(chains, edges).withColumn("__h", seeded(F.col("chain_key"), SEED if seed is None else seed))
    if seed is None and order is None:
        raise ValueError("without a seed, name the column that orders the chains")
    if seed is None:
        columns, pieces = [F.col(order), F.col("chain_key")], range_pieces(chains, order)
    else:
        columns, pieces = [F.col("__h"), F.col("chain_key")], hash_pieces(F.col("__h"))
    placed = ordinal(hashed, ["bin"], columns, pieces, "place")
    return placed.select(*chains.columns, "bin", F.floor(F.col("place") / size).alias("batch_no"))


def batch_count(chains: DataFrame, size: int, edges: list[int] | None = None) -> DataFrame:
    """Batches per bin, the short last one included."""
    sizes = length_bins(chains, edges).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("bin", "n", F.ceil(F.col("n") / size).alias("batches"))


def plain_batches(chains: DataFrame, size: int, order: str) -> DataFrame:
    """Batches in the order of a numeric column, then of the keys, lengths mixed."""
    placed = ordinal(chains, [], [F.col(order), F.col("chain_key")], range_pieces(chains, order), "place")
    return placed.select(*chains.columns, F.floor(F.col("place") / size).alias("batch_no"))


def limit_batches(batches: DataFrame, limit: int | float) -> DataFrame:
    """The first ``limit`` batches, or that fraction of them when it is a float."""
    if isinstance(limit, float):
        wanted = batches.agg(F.floor((F.max("batch_no") + 1) * limit)).scalar()
        return batches.filter(F.col("batch_no") < wanted)
    return batches.filter(F.col("batch_no") < limit)
