"""Leakage checks between splits and the retrieval index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _count_and_sample(found: DataFrame, column: str, sample: int = 10) -> DataFrame:
    """How many rows, and the first few in order. Only ``sample`` rows are gathered."""
    first = found.orderBy(column).limit(sample).agg(F.array_sort(F.collect_list(column)).alias("first_ids"))
    return found.agg(F.count(F.lit(1)).alias("n")).select("n", first.scalar().alias("first_ids"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids two lists share: n and the first ten."""
    return _count_and_sample(a.select("pdb_id").intersect(b.select("pdb_id")), "pdb_id")


def overlap_all(splits: DataFrame) -> DataFrame:
    """Ids met in more than one split, and in every split."""
    kinds = splits.select("split").distinct().agg(F.count(F.lit(1))).scalar()
    per_id = splits.select("pdb_id", "split").distinct().groupBy("pdb_id").agg(F.count(F.lit(1)).alias("k"))
    return per_id.agg(F.count_if(F.col("k") > 1).alias("in_several"), F.count_if(F.col("k") == kinds).alias("in_all"))


def index_contamination(index: DataFrame, test_ids: DataFrame) -> DataFrame:
    """Indexed structures that are test structures: n and the first ten."""
    return _count_and_sample(index.select("pdb_id").distinct().join(test_ids.select("pdb_id"), "pdb_id", "left_semi"), "pdb_id")


def chains_per_group(index: DataFrame) -> DataFrame:
    return index.groupBy("pdb_id").agg(F.count(F.lit(1)).alias("n_chains"))


def chain_distribution(index: DataFrame, limit: int = 10) -> DataFrame:
    """How many structures have 1, 2, ... chains; the smallest ``limit`` chain counts."""
    return chains_per_group(index).groupBy("n_chains").agg(F.count(F.lit(1)).alias("n_groups")).orderBy("n_chains").limit(limit)


def top_multichain(index: DataFrame, limit: int = 10) -> DataFrame:
    """Members of the structures with most chains, one row per member (never one list per structure)."""
    top = chains_per_group(index).filter("n_chains > 1").orderBy(F.desc("n_chains"), "pdb_id").limit(limit)
    return index.join(F.broadcast(top), "pdb_id").select("pdb_id", "n_chains", "chain_key")  # at most ``limit`` rows broadcast


def audit_report(checks: dict[str, DataFrame | None]) -> DataFrame:
    """One row per check (passed when its n is 0) and a last one for all of them.

    A check that could not be made (None) has no n and counts as failed.
    """
    def row(name: str, df: DataFrame | None) -> DataFrame:
        if df is None:
            return made[0].limit(0).agg(F.lit(name).alias("check_name"), F.lit(None).cast("bigint").alias("n"), F.lit(False).alias("passed"))
        return df.select(F.lit(name).alias("check_name"), F.col("n"), (F.col("n") == 0).alias("passed"))

    made = [df for df in checks.values() if df is not None]
    if not made:
        raise ValueError("no check could be made")
    each = reduce(DataFrame.unionByName, [row(name, df) for name, df in checks.items()])
    overall = each.agg(F.sum("n").alias("n"), F.bool_and("passed").alias("passed")).select(F.lit("overall").alias("check_name"), "n", "passed")
    return each.unionByName(overall)


def attempt(check, *inputs) -> DataFrame | None:
    """The check's result, or None where an input cannot be read (a missing table or column): a failed check."""
    try:
        return check(*[make() for make in inputs])
    except AnalysisException:
        return None
