"""Queries on pair scores: precision, thresholds, curves, losses, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import r6
from ..operators import evaluate as G
from ..operators import losses as L
from . import proxies as P
from .registry import query


def rounded(df, *columns):
    return df.select(*[r6(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


_P_AT_SQL = f"""{P.PAIRS_SQL}, entries AS (SELECT chain_key, i, j, i AS a, j AS b, p, y FROM pair_scores WHERE valid
    UNION ALL SELECT chain_key, i, j, j, i, p, y FROM pair_scores WHERE valid),
lens AS (SELECT chain_key, count(DISTINCT a) AS Lb, count(*) AS n FROM entries GROUP BY chain_key),
placed AS (SELECT *, row_number() OVER (PARTITION BY chain_key ORDER BY p DESC, i, j, a) AS r FROM entries JOIN lens USING (chain_key)),
p_at AS (SELECT chain_key, max(Lb) AS Lb, avg(y) FILTER (WHERE r <= Lb) AS p_at_l, avg(y) FILTER (WHERE r <= greatest(1, Lb // 2)) AS p_at_l2,
    avg(y) FILTER (WHERE r <= greatest(1, Lb // 5)) AS p_at_l5 FROM placed GROUP BY chain_key)"""
_P_AT_COLS = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("p_at_l", "p_at_l2", "p_at_l5"))


@query("precision_at_l", f"WITH {_P_AT_SQL} SELECT chain_key, Lb, {_P_AT_COLS} FROM p_at")
def precision_at_l(spark, d):
    return rounded(G.precision_at_k(P.pair_scores(spark, d)), "p_at_l", "p_at_l2", "p_at_l5")


@query("mean_precision", f"WITH {_P_AT_SQL} SELECT {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}' for c in ('p_at_l', 'p_at_l2', 'p_at_l5'))} FROM p_at")
def mean_precision(spark, d):
    return rounded(G.mean_precision(G.precision_at_k(P.pair_scores(spark, d))), "p_at_l", "p_at_l2", "p_at_l5")


_CURVE_SQL = f"""{P.PAIRS_SQL}, curve AS (SELECT split, tau, tp, fp, fn, 2 * tp / greatest(1, 2 * tp + fp + fn) AS f1 FROM (
    SELECT split, tau, count(*) FILTER (WHERE p >= tau AND y = 1) AS tp, count(*) FILTER (WHERE p >= tau AND y = 0) AS fp,
        count(*) FILTER (WHERE p < tau AND y = 1) AS fn
    FROM pair_scores, (SELECT (k + 1) / 20.0::DOUBLE AS tau FROM range(19) t(k)) WHERE valid GROUP BY split, tau)),
best AS (SELECT split, coalesce(arg_max(tau, f1 - tau * 1e-12) FILTER (WHERE f1 > 0), 0.5) AS tau, max(f1) AS f1 FROM curve GROUP BY split)"""


@query("threshold_curve", f"WITH {_CURVE_SQL} SELECT split, tau, tp, fp, fn, round(f1, 6) + 0.0 AS f1 FROM curve")
def threshold_curve(spark, d):
    return rounded(G.threshold_curve(P.pair_scores(spark, d), ("split",)), "f1")


@query("threshold_curve_eps", f"""WITH {_CURVE_SQL}, pr AS (SELECT *, tp / (tp + fp + 1e-8) AS pp, tp / (tp + fn + 1e-8) AS rr FROM curve)
SELECT split, tau, round(2 * pp * rr / (pp + rr + 1e-8), 6) + 0.0 AS f1 FROM pr""")
def threshold_curve_eps(spark, d):
    return rounded(G.threshold_curve(P.pair_scores(spark, d), ("split",), eps_form=True), "f1").select("split", "tau", "f1")


@query("best_threshold", f"WITH {_CURVE_SQL} SELECT split, tau, round(f1, 6) + 0.0 AS f1 FROM best")
def best_threshold(spark, d):
    return rounded(G.best_threshold(G.threshold_curve(P.pair_scores(spark, d), ("split",)), ("split",)), "f1")


def _metrics_sql(source: str, hit: str, keys: str) -> str:
    return f"""SELECT {keys}, tp, fp, fn, tn, round(tp / (tp + fp + 1e-8), 6) + 0.0 AS precision, round(tp / (tp + fn + 1e-8), 6) + 0.0 AS recall,
    round(2 * (tp / (tp + fp + 1e-8)) * (tp / (tp + fn + 1e-8)) / (tp / (tp + fp + 1e-8) + tp / (tp + fn + 1e-8) + 1e-8), 6) + 0.0 AS f1
    FROM (SELECT {keys}, count(*) FILTER (WHERE {hit} AND y = 1) AS tp, count(*) FILTER (WHERE {hit} AND y = 0) AS fp,
    count(*) FILTER (WHERE NOT {hit} AND y = 1) AS fn, count(*) FILTER (WHERE NOT {hit} AND y = 0) AS tn FROM {source} GROUP BY ALL)"""


@query("metrics_at", f"WITH {P.PAIRS_SQL} {_metrics_sql('pair_scores WHERE valid', '(p >= 0.5)', 'split')}")
def metrics_at(spark, d):
    return rounded(G.metrics_at(P.pair_scores(spark, d), 0.5, ("split",)), "precision", "recall", "f1")


@query("val_to_test", f"WITH {_CURVE_SQL} " + _metrics_sql(
    "(SELECT s.*, b.tau FROM pair_scores s JOIN best b ON b.split = 'val' WHERE s.split = 'test' AND valid)", "(p >= tau)", "tau"))
def val_to_test(spark, d):
    return rounded(G.val_to_test(P.pair_scores(spark, d)), "precision", "recall", "f1")


_PR_SQL = f"""{P.PAIRS_SQL}, curve AS (SELECT chain_key, i, j, row_number() OVER w AS rank, sum(y) OVER w AS tp, sum(y) OVER c AS positives,
    count(*) OVER c AS n FROM pair_scores WHERE valid WINDOW c AS (PARTITION BY chain_key),
    w AS (PARTITION BY chain_key ORDER BY p DESC, i, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("pr_curve", f"""WITH {_PR_SQL} SELECT chain_key, i, j, rank, round(tp / rank, 6) + 0.0 AS precision,
    round(tp / positives, 6) + 0.0 AS recall FROM curve WHERE positives > 0""")
def pr_curve(spark, d):
    return rounded(G.pr_curve(P.pair_scores(spark, d)), "precision", "recall").drop("n")


@query("pr_no_positives", f"""WITH {P.PAIRS_SQL} SELECT chain_key, count(*) AS n FROM pair_scores WHERE valid
GROUP BY chain_key HAVING sum(y * (chain_key[-1:] <> '7')::INT) = 0""")
def pr_no_positives(spark, d):
    """Chains whose number ends in 7 have no known contacts here; all pairs are kept."""
    unlabelled = F.col("chain_key").endswith("7")
    return G.without_positives(P.pair_scores(spark, d).withColumn("y", F.when(unlabelled, 0).otherwise(F.col("y")))).select("chain_key", "n")


@query("pr_markers", f"""WITH {_PR_SQL}, marks AS (SELECT *, floor(sqrt(2 * n))::BIGINT AS L FROM curve WHERE positives > 0)
SELECT chain_key, mark, rank, round(tp / rank, 6) + 0.0 AS precision, round(tp / positives, 6) + 0.0 AS recall
FROM marks, (VALUES ('L', 1), ('L/2', 2), ('L/5', 5)) t(mark, part) WHERE rank = L // part + 1""")
def pr_markers(spark, d):
    return rounded(G.pr_markers(G.pr_curve(P.pair_scores(spark, d))), "precision", "recall")


@query("target_summary", f"""WITH {_P_AT_SQL}, m AS ({_metrics_sql('pair_scores WHERE valid', '(p > 0.5)', 'chain_key')})
SELECT chain_key, 2 * (tp + fn) AS n_true, 2 * (tp + fp) AS n_pred, {_P_AT_COLS}, precision, recall, f1 FROM m JOIN p_at USING (chain_key)""")
def target_summary(spark, d):
    out = G.target_summary(P.pair_scores(spark, d), 0.5)
    return rounded(out, "p_at_l", "p_at_l2", "p_at_l5", "precision", "recall", "f1")


@query("error_map", f"""WITH {P.PAIRS_SQL} SELECT chain_key, i, j, CASE WHEN valid THEN y - (p > 0.5)::INT END AS diff,
    CASE WHEN valid THEN CASE WHEN y = 1 AND p > 0.5 THEN 'TP' WHEN y = 0 AND p > 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END END AS outcome
    FROM pair_scores""")
def error_map(spark, d):
    return G.error_map(P.pair_scores(spark, d), 0.5)


_LOSS_SQL = f"""{P.PAIRS_SQL}, x AS (SELECT chain_key, p, y, ln(greatest(1e-7, least(1 - 1e-7, p)) / (1 - greatest(1e-7, least(1 - 1e-7, p)))) AS x,
    y * 0.95::DOUBLE + 0.025::DOUBLE AS t FROM pair_scores WHERE valid),
w AS (SELECT chain_key, greatest(1, count(*) FILTER (WHERE y = 0)) / greatest(1, count(*) FILTER (WHERE y = 1)) * 0.8::DOUBLE AS w FROM x GROUP BY chain_key),
bce AS (SELECT chain_key, avg((1 - t) * x + (1 + (w - 1) * t) * (ln(1 + exp(-abs(x))) + greatest(-x, 0))) AS bce FROM x JOIN w USING (chain_key)
    GROUP BY chain_key),
tv AS (SELECT chain_key, 1 - sum(p * y) / (sum(p * y) + 0.7::DOUBLE * sum(p * (1 - y)) + 0.3::DOUBLE * sum((1 - p) * y) + 1e-6) AS tversky
    FROM x GROUP BY chain_key)"""


@query("bce_balanced", f"WITH {_LOSS_SQL} SELECT chain_key, round(bce, 6) + 0.0 AS bce FROM bce")
def bce_balanced(spark, d):
    return rounded(L.bce_balanced(P.pair_scores(spark, d), ("chain_key",)), "bce")


@query("tversky", f"WITH {_LOSS_SQL} SELECT chain_key, round(tversky, 6) + 0.0 AS tversky FROM tv")
def tversky(spark, d):
    return rounded(L.tversky(P.pair_scores(spark, d), ("chain_key",)), "tversky")


@query("total_loss", f"""WITH {_LOSS_SQL} SELECT chain_key, round(bce, 6) + 0.0 AS bce, round(tversky, 6) + 0.0 AS tversky,
    round(bce + 0.3::DOUBLE * tversky, 6) + 0.0 AS loss FROM bce JOIN tv USING (chain_key)""")
def total_loss(spark, d):
    return rounded(L.total_loss(P.pair_scores(spark, d), ("chain_key",)), "bce", "tversky", "loss")


def _losses(spark, d):
    return P.table(spark, d, "events").select(
        F.col("user_id").alias("group"), F.log1p("value").alias("loss"), (F.col("event_type") != "signup").alias("valid"),
        ((F.col("event_type") != "signup") & (F.col("event_type") != "error")).alias("resolved"), "value", F.col("event_type").alias("kind"))


@query("sequence_ll", """SELECT user_id AS "group", round(-avg(ln(1 + value)) FILTER (WHERE event_type <> 'signup'), 6) + 0.0 AS ll_full,
    round(-avg(ln(1 + value)) FILTER (WHERE event_type NOT IN ('signup', 'error')), 6) + 0.0 AS ll_resolved FROM events GROUP BY user_id""")
def sequence_ll(spark, d):
    return rounded(G.sequence_ll(_losses(spark, d)), "ll_full", "ll_resolved")


@query("mean_confidence", """SELECT user_id AS "group", round(sum(ln(1 + value) * (event_type <> 'error')::INT) / sum((event_type <> 'error')::INT), 6) + 0.0
    AS mean_confidence FROM events GROUP BY user_id""")
def mean_confidence(spark, d):
    weighted = _losses(spark, d).select("group", F.col("loss").alias("value"), (F.col("kind") != "error").cast("int").alias("weight"))
    return rounded(G.mean_confidence(weighted), "mean_confidence")


_CENTRES = ", ".join(repr(c) for c in S.bin_centres(0.0, 1.0, 64))
_BINNED_SQL = f"""logits AS (SELECT vec_id, embedding::DOUBLE[] AS l, (vec_id % 97) / 96.0::DOUBLE AS v FROM embeddings),
terms AS (SELECT *, list_transform(l, lambda z: exp(z - list_max(l))) AS e, [{_CENTRES}]::DOUBLE[] AS c FROM logits)"""


@query("binned_mean", f"WITH {_BINNED_SQL} SELECT vec_id, round(list_inner_product(e, c) / list_sum(e), 6) + 0.0 AS mean FROM terms")
def binned_mean(spark, d):
    logits = F.col("embedding").cast("array<double>")
    return P.table(spark, d, "embeddings").select("vec_id", r6(S.binned_mean(logits, 0.0, 1.0, 64)).alias("mean"))


@query("binned_logprob", f"""WITH {_BINNED_SQL}, gaps AS (SELECT *, list_transform(c, lambda z: abs(v - z)) AS g FROM terms)
SELECT vec_id, round(l[list_position(g, list_min(g))] - list_max(l) - ln(list_sum(e)), 6) + 0.0 AS logprob FROM gaps""")
def binned_logprob(spark, d):
    logits, value = F.col("embedding").cast("array<double>"), (F.col("vec_id") % 97) / F.lit(96.0)
    return P.table(spark, d, "embeddings").select("vec_id", r6(S.binned_logprob(logits, value, 0.0, 1.0, 64)).alias("logprob"))


@query("minmax_uint8", f"""WITH {P.PAIRS_SQL} SELECT chain_key, i, j, trunc((p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w + 1e-8) * 255.0::DOUBLE)::INT
    AS level FROM pair_scores WINDOW w AS (PARTITION BY chain_key)""")
def minmax_uint8(spark, d):
    return G.minmax_uint8(P.pair_scores(spark, d)).select("chain_key", "i", "j", "level")


@query("predict_contacts", f"WITH {P.PAIRS_SQL} SELECT chain_key, i, j, round(p, 6) + 0.0 AS p, (j - i >= 12)::INT AS mask FROM pair_scores WHERE p >= 0.65")
def predict_contacts(spark, d):
    return rounded(G.predict_contacts(P.pair_scores(spark, d), 0.65, 12), "p")


_NAMES = ["click", "purchase", "view"]


@query("model_report", "WITH means AS (SELECT 'm' || (user_id % 5) AS model, event_type AS metric, avg(ln(1 + value)) AS v FROM events GROUP BY ALL)"
       " SELECT a.model, " + ", ".join(f"round(max(a.v) FILTER (WHERE metric = '{m}'), 6) + 0.0 AS {m}_value, "
       f"round(max(a.v / b.v) FILTER (WHERE metric = '{m}'), 6) + 0.0 AS {m}_ratio" for m in _NAMES)
       + " FROM means a LEFT JOIN (SELECT metric, v FROM means WHERE model = 'm0') b USING (metric) GROUP BY a.model")
def model_report(spark, d):
    metrics = P.table(spark, d, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"), F.col("event_type").alias("metric"), F.log1p("value").alias("value"))
    out = G.model_report(metrics, "m0", _NAMES)
    return rounded(out, *out.columns[1:])
