"""Id lists: one id per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed, non-blank ids."""
    value = F.regexp_replace(column, r"^\s+|\s+$", "")
    return lines.select(value.alias("pdb_id")).filter(F.length("pdb_id") > 0)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return clean_ids(spark.read.text(path))


def write_ids(ids: DataFrame, path: str) -> None:
    ids.select("pdb_id").write.mode("overwrite").text(path)
