"""Evaluation of pair scores (split, chain_key, i < j, p, y, valid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import ordinal, sums_of_best, with_score_pieces
from ..session import stored

THRESHOLDS = [(k + 1) / 20 for k in range(19)]


def precision_at_k(scores: DataFrame, limit: int = 1 << 16) -> DataFrame:
    """Precision among the L, L/2 and L/5 best entries of each chain.

    L counts residues with a valid pair. Entries are ordered pairs: each row
    i < j stands for two entries that rank together. The places are found by
    counts of score ranges; of a chain, only rows around them are sorted.
    """
    valid = stored(scores.filter("valid").select("chain_key", "i", "j", "p", "y"))
    ends = valid.select("chain_key", F.explode(F.array("i", "j")).alias("r")).groupBy("chain_key", "r").agg(F.count(F.lit(1)).alias("n"))
    # Each valid pair has two ends and stands for two entries.
    sizes = ends.groupBy("chain_key").agg(F.count(F.lit(1)).alias("Lb"), F.sum("n").alias("entries"))

    ks = {"p_at_l": F.col("Lb"), "p_at_l2": F.greatest(F.lit(1), F.floor(F.col("Lb") / 2)),
          "p_at_l5": F.greatest(F.lit(1), F.floor(F.col("Lb") / 5))}
    caps = {name: F.least(k, F.col("entries")) for name, k in ks.items()}
    # The best k entries are the best k / 2 rows, once rounded down and once up, with one entry of each.
    halves = {f"{name}_{side}": cut(cap / 2) for name, cap in caps.items() for side, cut in (("low", F.floor), ("high", F.ceil))}
    wanted = sizes.select("chain_key", "Lb", *[cap.alias(f"{name}_cap") for name, cap in caps.items()], *[n.alias(name) for name, n in halves.items()])
    best = sums_of_best(valid, "chain_key", wanted, list(halves), ["p", "i", "j"], "y", limit)
    return best.select("chain_key", "Lb", *[((F.col(f"{k}_low") + F.col(f"{k}_high")) / F.col(f"{k}_cap")).alias(k) for k in ks])


def mean_precision(per_chain: DataFrame) -> DataFrame:
    """Mean over chains; 0 when there is none."""
    return per_chain.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("p_at_l", "p_at_l2", "p_at_l5")])


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return 2 * tp / F.greatest(F.lit(1), 2 * tp + fp + fn)


def _f1_eps(tp: Column, fp: Column, fn: Column, eps: float = 1e-8) -> Column:
    precision, recall = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return 2 * precision * recall / (precision + recall + eps)


def threshold_curve(scores: DataFrame, keys: tuple[str, ...] = (), eps_form: bool = False) -> DataFrame:
    """tp, fp, fn and F1 of p >= tau for tau = 0.05, 0.10, ..., 0.95.

    Rows are counted once, by the number of thresholds they reach; the curve is
    made from at most twenty counts per group.
    """
    reached = sum((F.when(F.col("p") >= t, 1).otherwise(0) for t in THRESHOLDS), F.lit(0))
    counts = scores.filter("valid").groupBy(*keys, reached.alias("reached")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    # Every threshold gets a row of zeros, so that one nobody reaches is still reported.
    zeros = F.transform(F.sequence(F.lit(0), F.lit(len(THRESHOLDS) - 1)), lambda k: F.struct(
        k.alias("k"), F.when(k < F.col("reached"), F.col("n")).otherwise(0).alias("n"),
        F.when(k < F.col("reached"), F.col("pos")).otherwise(0).alias("tp"), F.col("pos").alias("pos")))
    curve = counts.select(*keys, F.explode(zeros).alias("c")).groupBy(*keys, F.col("c.k").alias("k")).agg(
        F.sum("c.n").alias("predicted"), F.sum("c.tp").alias("tp"), F.sum("c.pos").alias("pos"))
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("pos") - F.col("tp")
    f1 = _f1_eps(tp, fp, fn) if eps_form else _f1(tp, fp, fn)
    return curve.select(*keys, ((F.col("k") + 1) / F.lit(20.0)).alias("tau"), "tp", fp.alias("fp"), fn.alias("fn"), f1.alias("f1"))


def best_threshold(curve: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lowest threshold with the highest F1; 0.5 when F1 never rises above 0."""
    top = F.max_by("tau", F.struct("f1", -F.col("tau")))
    return curve.groupBy(*keys).agg(F.when(F.max("f1") > 0, top).otherwise(0.5).alias("tau"), F.max("f1").alias("f1"))


def _confusion(hit: Column) -> list[Column]:
    y = F.col("y") == 1
    return [F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"),
            F.count_if(~hit & ~y).alias("tn")]


def _rates(counts: DataFrame, keys: tuple[str, ...], *more: str) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rates = counts.select("*", (tp / (tp + fp + 1e-8)).alias("precision"), (tp / (tp + fn + 1e-8)).alias("recall"))
    both = F.col("precision") + F.col("recall") + 1e-8
    return rates.select(*keys, *more, "tp", "fp", "fn", "tn", "precision", "recall",
                        (2 * F.col("precision") * F.col("recall") / both).alias("f1"))


def metrics_at(scores: DataFrame, tau: float | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts, precision, recall and F1 of p >= tau."""
    counts = scores.filter("valid").withColumn("__hit", F.col("p") >= tau).groupBy(*keys).agg(*_confusion(F.col("__hit")))
    return _rates(counts, keys)


def val_to_test(scores: DataFrame) -> DataFrame:
    """Best threshold of the validation split applied to the test split."""
    chosen = best_threshold(threshold_curve(scores.filter("split = 'val'")))
    tau = chosen.select("tau").scalar()
    return metrics_at(scores.filter("split = 'test'"), tau).select(tau.alias("tau"), "*")


def pr_curve(scores: DataFrame, keys: tuple[str, ...] = ("chain_key",)) -> DataFrame:
    """Rank (from 1), precision and recall of every valid row, best score first, for chains with positives.

    Ranks and running counts are made piece by piece of the score range, also
    when most scores are equal. Pass both orders of each pair to rank entries
    of the full matrix.
    """
    valid, pieces = with_score_pieces(stored(scores.filter("valid").select(*keys, "i", "j", "p", "y")), "p", "i")
    order = [F.desc("p"), F.col("i"), F.col("j")]
    ranked = ordinal(valid, list(keys), order, pieces, "place", {"tp": F.col("y")})
    totals = valid.groupBy(*keys).agg(F.sum("y").alias("positives"), F.count(F.lit(1)).alias("n")).filter("positives > 0")
    rank = F.col("place") + 1
    return ranked.join(totals, list(keys)).select(
        *keys, "i", "j", rank.alias("rank"), (F.col("tp") / rank).alias("precision"),
        (F.col("tp") / F.col("positives")).alias("recall"), "n")


def without_positives(scores: DataFrame, keys: tuple[str, ...] = ("chain_key",)) -> DataFrame:
    """Chains whose curve is undefined."""
    return scores.filter("valid").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives")).filter("positives = 0")


def pr_markers(curve: DataFrame, keys: tuple[str, ...] = ("chain_key",)) -> DataFrame:
    """Curve rows at the 0-based places L, L/2 and L/5, with L = int(sqrt(2 n))."""
    length = F.floor(F.sqrt(2 * F.col("n")))
    marks = F.array(*[F.struct(F.lit(name).alias("mark"), F.floor(length / part).alias("k")) for name, part in (("L", 1), ("L/2", 2), ("L/5", 5))])
    return curve.select("*", F.explode(marks).alias("m")).filter(F.col("rank") == F.col("m.k") + 1).select(
        *keys, F.col("m.mark").alias("mark"), "rank", "precision", "recall")


def target_summary(scores: DataFrame, tau: float) -> DataFrame:
    """Per chain: true and predicted entries (both orders), P@L, L/2, L/5, precision, recall, F1; p > tau, strictly."""
    valid = scores.filter("valid").withColumn("__hit", F.col("p") > tau)
    counts = _rates(valid.groupBy("chain_key").agg(*_confusion(F.col("__hit"))), ("chain_key",))
    return counts.join(precision_at_k(scores), "chain_key").select(
        "chain_key", (2 * (F.col("tp") + F.col("fn"))).alias("n_true"), (2 * (F.col("tp") + F.col("fp"))).alias("n_pred"),
        "p_at_l", "p_at_l2", "p_at_l5", "precision", "recall", "f1")


def error_map(scores: DataFrame, tau: float) -> DataFrame:
    """Truth minus prediction and its class; NULL outside the mask."""
    hit = (F.col("p") > tau).cast("int")
    name = (F.when((F.col("y") == 1) & (hit == 1), "TP").when((F.col("y") == 0) & (hit == 1), "FP")
            .when((F.col("y") == 1) & (hit == 0), "FN").otherwise("TN"))
    return scores.select("chain_key", "i", "j", F.when(F.col("valid"), F.col("y") - hit).alias("diff"),
                         F.when(F.col("valid"), name).alias("outcome"))


def sequence_ll(losses: DataFrame, keys: tuple[str, ...] = ("group",)) -> DataFrame:
    """Mean log-likelihood over valid positions, and over those with coordinates."""
    return losses.groupBy(*keys).agg((-F.avg(F.when(F.col("valid"), F.col("loss")))).alias("ll_full"),
                                     (-F.avg(F.when(F.col("resolved"), F.col("loss")))).alias("ll_resolved"))


def mean_confidence(values: DataFrame, keys: tuple[str, ...] = ("group",)) -> DataFrame:
    """Mean weighted by atom presence."""
    return values.groupBy(*keys).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean_confidence"))


def minmax_uint8(df: DataFrame, value: str = "p", keys: tuple[str, ...] = ("chain_key",)) -> DataFrame:
    """Values scaled to 0..255 between the extremes of their group, cut to integers."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    unit = (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-8)
    return df.join(ends, list(keys)).withColumn("level", (unit * 255.0).cast("int")).drop("__lo", "__hi")


def predict_contacts(scores: DataFrame, tau: float, min_sep: int) -> DataFrame:
    """Predicted contacts: score at least tau, and whether the pair is long-range."""
    return scores.filter(F.col("p") >= tau).select(
        "chain_key", "i", "j", "p", (F.abs(F.col("i") - F.col("j")) >= min_sep).cast("int").alias("mask"))


def model_report(metrics: DataFrame, baseline: str, names: list[str]) -> DataFrame:
    """Mean metrics of each model side by side, with the ratio to the baseline model."""
    means = metrics.groupBy("model", "metric").agg(F.avg("value").alias("value"))
    reference = means.filter(F.col("model") == baseline).select("metric", F.col("value").alias("base"))
    ratios = means.join(reference, "metric", "left").withColumn("ratio", F.col("value") / F.col("base"))
    return ratios.groupBy("model").pivot("metric", names).agg(F.first("value").alias("value"), F.first("ratio").alias("ratio"))
