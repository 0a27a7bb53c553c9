"""Exact length histogram of a corpus, and what follows from it for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .encoding import encoder


def lengths(docs: DataFrame, path: str, by: str) -> DataFrame:
    """``by`` and n_tokens of every row of ``docs``; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = np.fromiter((len(enc.array(t)) if t else 0 for t in batch.column(1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=["part", "n_tokens"])

    return docs.select(F.col(by).cast("string").alias("part"), "text").mapInArrow(run, "part string, n_tokens bigint")


def histogram(docs: DataFrame, path: str, by: str) -> DataFrame:
    """part, n_tokens, docs: the number of rows of each encoded length, summed before the shuffle."""
    return lengths(docs, path, by).groupBy("part", "n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def limits(counts: DataFrame, width: int = 64) -> DataFrame:
    """Answers for the context limit of every length that occurs, from the histogram ``counts``.

    part, context_limit, docs (of exactly this length), docs_longer, tokens_total (of the part), tokens_kept (each
    document cut at the limit), tokens_lost, quantile (share of documents no longer than the limit). A limit L between
    two lengths follows from the next smaller length M: kept(L) = kept(M) + (L - M) * docs_longer(M). Parts may be
    null; an empty table gives no rows.

    Sums over longer documents are suffix sums. They are taken in two steps, over ranges of ``width`` lengths and
    inside a range, so no task needs all lengths of a part.
    """
    cut = counts.withColumn("piece", F.expr(f"n_tokens div {width}"))
    sizes = cut.groupBy("part", "piece").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    longer = Window.partitionBy("part").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("part")
    offsets = sizes.select(
        F.col("part").alias("o_part"), F.col("piece").alias("o_piece"),
        F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("n_after"), F.coalesce(F.sum("t").over(longer), F.lit(0)).alias("t_after"),
        F.sum("n").over(whole).alias("n_all"), F.sum("t").over(whole).alias("t_all"))
    inside = Window.partitionBy("part", "piece").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    n_longer = F.coalesce(F.sum("docs").over(inside), F.lit(0)) + F.col("n_after")
    t_longer = F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")).over(inside), F.lit(0)) + F.col("t_after")
    joined = cut.join(offsets, F.col("part").eqNullSafe(F.col("o_part")) & (F.col("piece") == F.col("o_piece")))
    rows = joined.select("part", F.col("n_tokens").alias("context_limit"), "docs", n_longer.alias("docs_longer"), t_longer.alias("t_longer"),
                         "n_all", "t_all")
    lost = F.col("t_longer") - F.col("context_limit") * F.col("docs_longer")
    return rows.select(
        "part", "context_limit", "docs", "docs_longer", F.col("t_all").alias("tokens_total"),
        (F.col("t_all") - lost).alias("tokens_kept"), lost.alias("tokens_lost"),
        ((F.col("n_all") - F.col("docs_longer")) / F.col("n_all")).alias("quantile"))


def token_counts(docs: DataFrame, path: str, by: str = "lang") -> DataFrame:
    """``limits`` of ``docs``; the histogram is stored once, as it is read twice."""
    return limits(stored(histogram(docs, path, by)))
