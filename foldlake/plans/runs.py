"""Queries on run metrics and the pair classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import RELPOS_CUTS
from ..functions.scalars import r6
from ..operators import model as M
from ..operators import pairs as B
from ..operators import retrieve as R
from ..operators import runs as H
from ..operators import transfer as T
from ..session import stored
from . import proxies as P
from .pairs import ALL_NEAR_SQL
from .registry import query
from .transfer import _PROJECTED_SQL, _WEIGHTS_SQL, _aligned, _candidates, chain_index, chain_seqs, contacts

_MEANS_SQL = f"{P.METRICS_SQL}, means AS (SELECT run_id, epoch, metric, avg(value) AS value FROM run_metrics GROUP BY ALL)"


def _means(spark, d):
    return H.epoch_metrics(P.run_metrics(spark, d))


@query("epoch_metrics", f"WITH {_MEANS_SQL} SELECT run_id, epoch, metric, round(value, 5) + 0.0 AS value FROM means")
def epoch_metrics(spark, d):
    return _means(spark, d).withColumn("value", F.round("value", 5) + 0.0)


@query("best_epoch", f"""WITH {_MEANS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, epoch) AS r,
    max(epoch) OVER (PARTITION BY run_id) AS last_epoch FROM means WHERE metric = 'val/click')
SELECT run_id, epoch AS best_epoch, round(value, 5) + 0.0 AS best_value, last_epoch FROM m WHERE r = 1""")
def best_epoch(spark, d):
    return H.best_epoch(_means(spark, d), "val/click").withColumn("best_value", F.round("best_value", 5) + 0.0)


@query("early_stop", f"""WITH {_MEANS_SQL}, o AS (SELECT *, row_number() OVER w AS n,
    max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM means WHERE metric = 'val/click'
    WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
g AS (SELECT *, n - max(CASE WHEN top IS NULL OR value > top THEN n END) OVER (PARTITION BY run_id ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wait FROM o)
SELECT run_id, min(epoch) FILTER (WHERE wait >= 5) AS stop_epoch, max(epoch) AS last_epoch FROM g GROUP BY run_id""")
def early_stop(spark, d):
    return H.early_stop(_means(spark, d), "val/click")


@query("best_trial", f"""WITH {P.METRICS_SQL} SELECT run_id, max(value) AS value FROM run_metrics WHERE metric = 'val/purchase'
GROUP BY run_id ORDER BY value DESC, run_id LIMIT 1""")
def best_trial(spark, d):
    return H.best_trial(P.run_metrics(spark, d), "val/purchase")


def _features(spark, d):
    """Close pairs of every chain with a contact label, a score that falls with separation and the template prior."""
    near = B.pair_distances(P.points(spark, d).withColumn("has_ca", F.lit(True)), 12.0)
    pairs = near.select("chain_key", "i", "j", (F.col("dist") < 8).cast("int").alias("y"), (1 / (1 + F.col("j") - F.col("i"))).alias("score"))
    rows = T.evidence(T.project(_aligned(spark, d), contacts(spark, d)), True, False)
    return M.pair_features(pairs, T.vote(rows, R.hit_weights(_candidates(spark, d))))


_BUCKET_SQL = " + ".join(f"((n.j - n.i) > {c})::INT" for c in RELPOS_CUTS)


@query("pair_features", f"""WITH {_PROJECTED_SQL}, {_WEIGHTS_SQL}, {ALL_NEAR_SQL[len(P.POINTS_SQL) + 2:]},
priors AS (SELECT query_key, i, j, sum(weight) AS prior, count(*)::DOUBLE AS cnt FROM projected JOIN weights USING (query_key, tpl_key) GROUP BY ALL)
SELECT n.chain_key, n.i, n.j, (dist < 8)::INT AS y, round(1 / (1 + n.j - n.i), 6) + 0.0 AS score, round(coalesce(prior, 0), 6) + 0.0 AS prior,
    coalesce(cnt, 0) AS cnt, {_BUCKET_SQL} AS bucket FROM near n LEFT JOIN priors q ON q.query_key = n.chain_key AND q.i = n.i AND q.j = n.j""")
def pair_features(spark, d):
    return _features(spark, d).select("chain_key", "i", "j", "y", r6(F.col("score")).alias("score"), r6(F.col("prior")).alias("prior"), "cnt",
                                      (F.array_position("relpos", 1) - 1).cast("int").alias("bucket"))


_FEATURE_NAMES = ["prior", "cnt", "score", *[f"relpos_{k}" for k in range(14)], "constant"]


@query("pair_classifier", f"""WITH {ALL_NEAR_SQL} SELECT feature, 0.0::DOUBLE AS residual, (SELECT count(*) FROM near) AS rows,
    (SELECT count(*) FROM near WHERE dist < 8)::BIGINT AS positives
FROM (VALUES {', '.join(f"('{n}')" for n in _FEATURE_NAMES)}) t(feature)""")
def pair_classifier(spark, d):
    """The fitted classifier by its residuals: at the optimum the weighted errors are orthogonal to every feature."""
    features = stored(_features(spark, d))  # read by the weights, the fit and the scoring
    found = M.residuals(M.fit_pair_classifier(features), features)
    return found.withColumn("residual", F.round("residual", 3) + 0.0)


def _predicted_features(spark, d):
    """Pairs of all chains with priors of real hits, each fifth chain for testing and the next for validation."""
    close = B.pair_distances(P.points(spark, d).withColumn("has_ca", F.lit(True)), 12.0)
    pairs = close.select("chain_key", "i", "j", (F.col("dist") < 8).cast("int").alias("y"), (1 / (1 + F.col("j") - F.col("i"))).alias("score"))
    index = chain_index(spark, d)
    priors = T.transfer(index, index, chain_seqs(spark, d), contacts(spark, d))
    number = F.substring_index(F.substring("chain_key", 2, 20), "_", 1).cast("int") * 2 + F.col("chain_key").endswith("B").cast("int")
    split = F.when(number % 5 == 0, "test").when(number % 5 == 1, "val").otherwise("train")
    return stored(M.pair_features(pairs, priors).withColumn("split", split))


@query("predict_pairs")
def predict_pairs(spark, d):
    """From templates to contacts: priors of real hits, features, fit, threshold from validation chains, long-range mask."""
    return M.predict_pairs(_predicted_features(spark, d)).withColumn("p", r6(F.col("p")))


@query("predict_proof", f"""WITH {ALL_NEAR_SQL}, parted AS (SELECT *, (regexp_extract(chain_key, '([0-9]+)', 1)::INT * 2 + chain_key.ends_with('B')::INT) % 5 AS part FROM near)
SELECT feature, 0.0::DOUBLE AS residual, (SELECT count(*) FROM parted WHERE part > 1) AS rows, (SELECT count(*) FROM parted WHERE part > 1 AND dist < 8)::BIGINT AS positives,
    (SELECT count(*) FROM parted WHERE part = 0) AS predicted, (SELECT count(*) FROM parted WHERE part = 0 AND j - i >= 6) AS apart, 0::BIGINT AS wrong
FROM (VALUES {', '.join(f"('{n}')" for n in _FEATURE_NAMES)}) t(feature)""")
def predict_proof(spark, d):
    """The end-to-end prediction by what must hold: the fit at its optimum, all test pairs predicted, contacts by threshold."""
    return M.prediction_proof(_predicted_features(spark, d)).withColumn("residual", F.round("residual", 3) + 0.0)
