"""Losses of pair scores, each from one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABEL_SMOOTHING, POS_WEIGHT_SCALE, TVERSKY_ALPHA, TVERSKY_BETA, TVERSKY_GAMMA, TVERSKY_WEIGHT


def logit(p: Column, clamp: float = 1e-7) -> Column:
    inside = F.greatest(F.lit(clamp), F.least(F.lit(1 - clamp), p))
    return F.log(inside / (1 - inside))


def _softplus_negative(x: Column) -> Column:
    """log(1 + exp(-x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))


def _bce_sums(smoothing: float) -> list[Column]:
    """The loss is linear in the class weight, so two sums replace a second pass over the pairs."""
    y = F.col("y") * (1 - smoothing) + 0.5 * smoothing
    x, soft = F.col("__x"), F.col("__soft")
    return [F.sum((1 - y) * x + soft).alias("__plain"), F.sum(y * soft).alias("__weighted"),
            F.greatest(F.lit(1), F.count_if(F.col("y") == 1)).alias("__pos"), F.greatest(F.lit(1), F.count_if(F.col("y") == 0)).alias("__neg"),
            F.greatest(F.lit(1), F.count(F.lit(1))).alias("__n")]


def _bce(scale: float) -> Column:
    weight = F.col("__neg") / F.col("__pos") * scale
    return (F.col("__plain") + (weight - 1) * F.col("__weighted")) / F.col("__n")


def _tversky_sums() -> list[Column]:
    p, y = F.col("p"), F.col("y")
    return [F.sum(p * y).alias("__tp"), F.sum(p * (1 - y)).alias("__fp"), F.sum((1 - p) * y).alias("__fn")]


def _tversky(alpha: float, beta: float, gamma: float, eps: float = 1e-6) -> Column:
    tp = F.col("__tp")
    return F.pow(1 - tp / (tp + alpha * F.col("__fp") + beta * F.col("__fn") + eps), F.lit(gamma))


def _with_logits(scores: DataFrame) -> DataFrame:
    staged = scores.filter("valid").withColumn("__x", logit(F.col("p")))
    return staged.withColumn("__soft", _softplus_negative(F.col("__x")))


def bce_balanced(scores: DataFrame, keys: tuple[str, ...] = (), smoothing: float = LABEL_SMOOTHING,
                 scale: float = POS_WEIGHT_SCALE) -> DataFrame:
    """Class-balanced cross-entropy of probabilities with smoothed targets, mean over valid pairs.

    A row i < j stands for both orders with equal scores; pass symmetrised scores.
    """
    return _with_logits(scores).groupBy(*keys).agg(*_bce_sums(smoothing)).select(*keys, _bce(scale).alias("bce"))


def tversky(scores: DataFrame, keys: tuple[str, ...] = (), alpha: float = TVERSKY_ALPHA, beta: float = TVERSKY_BETA,
            gamma: float = TVERSKY_GAMMA) -> DataFrame:
    """Focal Tversky loss over valid pairs."""
    return scores.filter("valid").groupBy(*keys).agg(*_tversky_sums()).select(*keys, _tversky(alpha, beta, gamma).alias("tversky"))


def total_loss(scores: DataFrame, keys: tuple[str, ...] = (), weight: float = TVERSKY_WEIGHT) -> DataFrame:
    """Cross-entropy plus weighted Tversky, in one pass."""
    sums = _with_logits(scores).groupBy(*keys).agg(*_bce_sums(LABEL_SMOOTHING), *_tversky_sums())
    parts = sums.select(*keys, _bce(POS_WEIGHT_SCALE).alias("bce"), _tversky(TVERSKY_ALPHA, TVERSKY_BETA, TVERSKY_GAMMA).alias("tversky"))
    return parts.withColumn("loss", F.col("bce") + weight * F.col("tversky"))
