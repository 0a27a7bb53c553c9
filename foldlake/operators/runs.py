"""Run metrics (run_id, epoch, metric, value): epoch means, best epoch, early stop, best trial."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PATIENCE


def epoch_metrics(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id", "epoch", "metric").agg(F.avg("value").alias("value"))


def require_metric(metrics: DataFrame, name: str) -> DataFrame:
    """Rows of one metric; an unknown name is an error."""
    rows = metrics.filter(F.col("metric") == name)
    if rows.isEmpty():
        raise ValueError(f"metric {name!r} was not logged")
    return rows


def best_epoch(metrics: DataFrame, name: str, mode: str = "max") -> DataFrame:
    """Per run: the earliest epoch with the best value, and the last epoch."""
    value = F.col("value") if mode == "max" else -F.col("value")
    best = F.max_by(F.struct("epoch", "value"), F.struct(value, -F.col("epoch")))
    return require_metric(metrics, name).groupBy("run_id").agg(best.alias("b"), F.max("epoch").alias("last_epoch")).select(
        "run_id", F.col("b.epoch").alias("best_epoch"), F.col("b.value").alias("best_value"), "last_epoch")


def early_stop(metrics: DataFrame, name: str, patience: int = PATIENCE) -> DataFrame:
    """Per run: the first epoch at which ``patience`` epochs passed without a strictly better value.

    Works on epoch means, a few rows per run.
    """
    order = Window.partitionBy("run_id").orderBy("epoch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = require_metric(metrics, name).withColumn("n", F.row_number().over(order)).withColumn("top", F.max("value").over(before))
    better = F.when(F.col("top").isNull() | (F.col("value") > F.col("top")), F.col("n"))
    waits = rows.withColumn("better", better).withColumn("wait", F.col("n") - F.max("better").over(upto))
    return waits.groupBy("run_id").agg(F.min(F.when(F.col("wait") >= patience, F.col("epoch"))).alias("stop_epoch"),
                                       F.max("epoch").alias("last_epoch"))


def best_trial(metrics: DataFrame, name: str) -> DataFrame:
    """The run with the highest value of a metric; ties go to the lower id."""
    per_run = require_metric(metrics, name).groupBy("run_id").agg(F.max("value").alias("value"))
    return per_run.orderBy(F.desc("value"), "run_id").limit(1)
