"""Pair classifier on template evidence, relative position and a sequence score."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_SEPARATION, POS_WEIGHT_SCALE
from ..functions.scalars import relpos_one_hot
from .evaluate import best_threshold, threshold_curve


def pair_features(pairs: DataFrame, priors: DataFrame) -> DataFrame:
    """Pairs (chain_key, i, j, score, y) with prior, count and one-hot relative position; no evidence is 0."""
    known = priors.select(F.col("query_key").alias("chain_key"), "i", "j", "prior", "cnt")
    return pairs.join(known, ["chain_key", "i", "j"], "left").select(
        *pairs.columns, F.coalesce("prior", F.lit(0.0)).alias("prior"), F.coalesce("cnt", F.lit(0.0)).alias("cnt"),
        relpos_one_hot(F.col("i"), F.col("j")).alias("relpos"))


def class_weights(pairs: DataFrame, scale: float = POS_WEIGHT_SCALE) -> DataFrame:
    """Add ``weight``: (negatives / positives) * scale on positives, 1 on negatives."""
    ratio = pairs.agg((F.greatest(F.lit(1), F.count_if(F.col("y") == 0)) / F.greatest(F.lit(1), F.count_if(F.col("y") == 1)) * scale).alias("w"))
    return pairs.withColumn("weight", F.when(F.col("y") == 1, ratio.scalar()).otherwise(1.0))


def fit_pair_classifier(features: DataFrame, iterations: int = 200, tolerance: float = 1e-9):
    """Weighted logistic regression over the feature columns, without penalty, fitted until it no longer improves."""
    flat = _flatten(class_weights(features))
    stages = [VectorAssembler(inputCols=_inputs(flat), outputCol="features"),
              LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=iterations, tol=tolerance)]
    return Pipeline(stages=stages).fit(flat)


def _inputs(flat: DataFrame) -> list[str]:
    return ["prior", "cnt", "score", *[c for c in flat.columns if c.startswith("relpos_")]]


def _flatten(features: DataFrame, size: int = 14) -> DataFrame:
    return features.select("*", *[F.col("relpos")[k].cast("double").alias(f"relpos_{k}") for k in range(size)])


def score_pairs(model, features: DataFrame) -> DataFrame:
    """Contact probability per pair."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_flatten(features))
    return scored.select("chain_key", "i", "j", "y", vector_to_array("probability")[1].alias("p"))


def predict_pairs(features: DataFrame, min_sep: int = MIN_SEPARATION) -> DataFrame:
    """chain_key, i, j, y, p, tau and contact for the test pairs of ``features``, which has a ``split`` column.

    The classifier learns from the train pairs, the threshold with the best F1 comes from the val pairs, and test pairs
    at least ``min_sep`` apart that reach it are contacts. ``features`` is read several times: store it first.
    """
    model = fit_pair_classifier(features.filter("split = 'train'").drop("split"))
    apart = F.abs(F.col("i") - F.col("j")) >= min_sep
    judged = score_pairs(model, features.filter("split = 'val'")).withColumn("valid", apart)
    tau = best_threshold(threshold_curve(judged)).select("tau").scalar()
    scored = score_pairs(model, features.filter("split = 'test'")).withColumn("tau", tau)
    return scored.withColumn("contact", (apart & (F.col("p") >= F.col("tau"))).cast("int"))


def prediction_proof(features: DataFrame, min_sep: int = MIN_SEPARATION) -> DataFrame:
    """feature, residual, rows, positives of the train pairs, and predicted, apart and wrong of the test pairs.

    What makes ``predict_pairs`` right: its classifier is at its optimum where all residuals are 0, every test pair is
    predicted, and ``wrong`` counts those whose contact does not follow from p, tau and the separation (``apart``: pairs far
    enough from each other).
    """
    train = features.filter("split = 'train'").drop("split")
    found = residuals(fit_pair_classifier(train), train)
    far = F.abs(F.col("i") - F.col("j")) >= min_sep
    sums = predict_pairs(features, min_sep).agg(
        F.count(F.lit(1)).alias("predicted"), F.count_if(far).alias("apart"),
        F.count_if(F.col("contact") != (far & (F.col("p") >= F.col("tau"))).cast("int")).alias("wrong"))
    return found.select("*", *[sums.select(n).scalar().alias(n) for n in ("predicted", "apart", "wrong")])


def residuals(model, features: DataFrame) -> DataFrame:
    """feature, residual, rows and positives: the weighted mean of (y - p) * feature, which a fitted model has at 0.

    The constant stands for the intercept.
    """
    from pyspark.ml.functions import vector_to_array

    flat = _flatten(class_weights(features)).withColumn("constant", F.lit(1.0))
    names = [*_inputs(flat), "constant"]
    scored = model.transform(flat).withColumn("error", F.col("weight") * (F.col("y") - vector_to_array("probability")[1]))
    sums = scored.agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"), F.sum("weight").alias("w"),
                      *[F.sum(F.col("error") * F.col(n)).alias(n) for n in names])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), (F.col(n) / F.col("w")).alias("residual")) for n in names])).alias("r")
    return sums.select("rows", "positives", each).select("r.feature", "r.residual", "rows", "positives")
