"""Transfer of template contacts onto query positions.

Everything is keyed by (query, template, position). Contacts are sparse, so the
vote never lists the pairs of a chain; the value of a pair without evidence is
asked for with ``project_onto``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import blosum62_pairs
from ..session import stored
from .align import align_positions
from .retrieve import hit_weights, topk_similar


def blosum62(spark: SparkSession) -> DataFrame:
    """Letter-pair scores, 400 rows."""
    return spark.createDataFrame(blosum62_pairs(), "a string, b string, score int")


def _strength(score: Column) -> Column:
    """BLOSUM score scaled to start at 0; unknown letters score 0."""
    return (F.coalesce(score, F.lit(0)) + 4) / F.lit(15.0)


def _scored(df: DataFrame, scores: DataFrame) -> DataFrame:
    table = F.broadcast(scores.select(F.col("a").alias("ai"), F.col("b").alias("aj"), "score"))  # one row per letter pair
    return df.join(table, ["ai", "aj"], "left")


def project(aligned: DataFrame, tpl_contacts: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Template contacts on query positions: query_key, tpl_key, i < j, value.

    The value is 1, or the scaled BLOSUM score of the two template letters.
    Contacts find their aligned positions through two equality joins.
    """
    left = aligned.select("query_key", "tpl_key", F.col("tpos").alias("ti"), F.col("qpos").alias("qi"), F.col("t_aa").alias("ai"))
    right = aligned.select("query_key", "tpl_key", F.col("tpos").alias("tj"), F.col("qpos").alias("qj"), F.col("t_aa").alias("aj"))
    known = tpl_contacts.select(F.col("chain_key").alias("tpl_key"), F.col("i").alias("ti"), F.col("j").alias("tj"))
    placed = known.join(left, ["tpl_key", "ti"]).join(right, ["query_key", "tpl_key", "tj"])
    if scores is not None:
        placed = _scored(placed, scores)
    value = F.lit(1.0) if scores is None else _strength(F.col("score"))
    return placed.select("query_key", "tpl_key", F.least("qi", "qj").alias("i"), F.greatest("qi", "qj").alias("j"), value.alias("value"))


def project_onto(pairs: DataFrame, aligned: DataFrame, tpl_contacts: DataFrame, scores: DataFrame | None = None,
                 min_sep: int = 0) -> DataFrame:
    """Projected value of the given (query_key, tpl_key, i, j) rows.

    Plain mode: 1 contact, 0 no contact, -1 a position without partner. With
    scores: plus or minus the scaled score, 0 without partner. Pairs closer
    than ``min_sep`` count as unknown; the diagonal is 0.
    """
    left = aligned.select("query_key", "tpl_key", F.col("qpos").alias("i"), F.col("tpos").alias("ti"), F.col("t_aa").alias("ai"))
    right = aligned.select("query_key", "tpl_key", F.col("qpos").alias("j"), F.col("tpos").alias("tj"), F.col("t_aa").alias("aj"))
    known = tpl_contacts.select(F.col("chain_key").alias("tpl_key"), F.col("i").alias("ta"), F.col("j").alias("tb"), F.lit(1).alias("hit"))
    placed = (pairs.join(left, ["query_key", "tpl_key", "i"], "left").join(right, ["query_key", "tpl_key", "j"], "left")
              .withColumn("ta", F.least("ti", "tj")).withColumn("tb", F.greatest("ti", "tj"))
              .join(known, ["tpl_key", "ta", "tb"], "left"))
    both = F.col("ti").isNotNull() & F.col("tj").isNotNull()
    if scores is None:
        unknown, value = F.lit(-1.0), F.when(F.col("hit") == 1, 1.0).otherwise(0.0)
    else:
        placed = _scored(placed, scores)
        unknown = F.lit(0.0)
        value = F.when(F.col("hit") == 1, _strength(F.col("score"))).otherwise(-_strength(F.col("score")))
    kept = F.when(F.abs(F.col("i") - F.col("j")) < min_sep, unknown).when(both, value).otherwise(unknown)
    return placed.select("query_key", "tpl_key", "i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(kept).alias("value"))


def evidence(projected: DataFrame, positive_only: bool, use_blosum: bool, min_sep: int = 0) -> DataFrame:
    """Evidence value and count flag of each projected pair.

    Positive-only keeps values of exactly 1 (with BLOSUM that is W against W
    only). Otherwise values are cut to [0, 1]; the flag marks known pairs, or
    non-zero ones with BLOSUM. Short-range pairs give nothing.
    """
    raw = F.col("value")
    if positive_only:
        value = F.when(raw == 1, 1.0).otherwise(0.0)
        flag = F.when(raw == 1, 1).otherwise(0)
    else:
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
        flag = F.when(value != 0, 1).otherwise(0) if use_blosum else F.when(raw != -1, 1).otherwise(0)
    close = F.abs(F.col("i") - F.col("j")) < min_sep
    return projected.select("query_key", "tpl_key", "i", "j", F.when(close, 0.0).otherwise(value).alias("value"),
                            F.when(close, 0).otherwise(flag).alias("flag"))


def vote(evidence_rows: DataFrame, weights: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Weighted evidence and count per query pair, cut to the query's window if one is given.

    Products are summed map-side before the shuffle; the key (query, i, j)
    cannot be hot, as each template adds one row to it.
    """
    weighted = evidence_rows.join(weights.select("query_key", "tpl_key", "weight"), ["query_key", "tpl_key"])
    voted = weighted.groupBy("query_key", "i", "j").agg(
        F.sum(F.col("weight") * F.col("value")).alias("prior"), F.sum("flag").cast("double").alias("cnt"))
    if windows is None:
        return voted
    bounds = windows.select(F.col("chain_key").alias("query_key"), "crop_start", "crop_end")
    inside = voted.join(bounds, "query_key").filter((F.col("i") >= F.col("crop_start")) & (F.col("j") < F.col("crop_end")))
    return inside.select("query_key", (F.col("i") - F.col("crop_start")).alias("i"), (F.col("j") - F.col("crop_start")).alias("j"),
                         "prior", "cnt")


def transfer(queries: DataFrame, index: DataFrame, chains: DataFrame, tpl_contacts: DataFrame, k: int = 4,
             min_sep: int = 0, positive_only: bool = True, scores: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Template prior of every query: hits, alignments, projection and vote in one plan.

    With ``positive_only`` false, known pairs without contact count too, so the pairs in question must be given:
    ``asked`` has query_key, i < j.
    """
    if not positive_only and asked is None:
        raise ValueError("counting known pairs needs the asked pairs (query_key, i, j)")
    weights = stored(hit_weights(topk_similar(queries, index, k)))
    aligned = stored(align_positions(weights, chains, chains))
    if asked is None:
        rows = evidence(project(aligned, tpl_contacts, scores), positive_only, scores is not None, min_sep)
        return vote(rows.filter("flag = 1"), weights)
    pairs = asked.select("query_key", "i", "j").join(weights.select("query_key", "tpl_key"), "query_key")
    return vote(evidence(project_onto(pairs, aligned, tpl_contacts, scores, min_sep), positive_only, scores is not None, min_sep), weights)
