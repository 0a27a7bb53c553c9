"""Sinks and incremental builds of chain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chains import all_chains
from ..session import stored
from .structures import file_states, residues


#: Buckets of a chain sink.
BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def write_chains(chains: DataFrame, path: str, buckets: int = BUCKETS, rows_per_file: int = 100_000, mode: str = "overwrite") -> None:
    """Chains as Parquet below hash buckets of their key; files hold up to ``rows_per_file`` rows, however many there are.

    The chains are computed once and stored, then counted, so that tasks and files follow their number.
    """
    table = stored(chains)
    pieces = max(1, -(-table.count() // (buckets * rows_per_file)))
    piece = F.pmod(F.xxhash64("chain_key", F.lit(1)), F.lit(pieces))
    (table.withColumn("bucket", _bucket("chain_key", buckets)).repartition(buckets * pieces, "bucket", piece)
     .write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("bucket").parquet(path))


def fetch_stored(spark: SparkSession, keys: DataFrame, path: str, key: str = "chain_key", buckets: int = BUCKETS) -> DataFrame:
    """Rows of a chain sink for a table of keys, with the other columns of ``keys``.

    The buckets of the asked keys are found first, and only their folders are listed and read. ``buckets`` must be what the
    sink was written with. ``keys`` is computed twice: for its buckets and for the rows.
    """
    asked = keys.withColumn("bucket", _bucket(key, buckets).cast("int"))
    wanted = asked.agg(F.collect_set("bucket")).scalar()  # at most ``buckets`` numbers
    sink = spark.read.parquet(path).withColumnRenamed("chain_key", key)
    return asked.join(sink.filter(F.array_contains(wanted, F.col("bucket"))), ["bucket", key]).drop("bucket")


def write_build(atoms: DataFrame, path: str, min_len: int, mode: str = "overwrite") -> dict[str, int]:
    """Write the chains of a build below ``path`` and return its counts, as ``structures.ingest_summary`` gives them.

    Structure text is parsed once. Counts come from what was stored on the way, a row per file and a row per chain. They are
    not observed in the write: in Spark 4.1 a session that has made an ``Observation`` can no longer ship MLlib's tasks.
    """
    parsed = stored(atoms)
    states = stored(file_states(parsed))
    usable = parsed.join(states.filter("state = 'ok'").select("path"), "path", "left_semi")
    kept = F.coalesce((F.col("L") >= min_len) & (F.col("n_ca") > 0), F.lit(False))
    chains = stored(all_chains(residues(usable)))
    chains.filter(kept).write.mode(mode).parquet(path)
    files = states.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("state") == "broken").alias("failed"), F.count_if(F.col("state") == "repeated").alias("repeated"))
    made = chains.agg(F.count_if(kept).alias("saved"), F.count_if(~kept).alias("skipped"))
    return {**files.first().asDict(), **made.first().asDict()}


def ingest(new: DataFrame, existing: DataFrame, overwrite: bool = False, key: str = "chain_key") -> DataFrame:
    """Rows to write: those not stored yet, or all of them when overwriting."""
    return new if overwrite else new.join(existing.select(key).distinct(), key, "left_anti")


def ingest_counts(new: DataFrame, existing: DataFrame, key: str = "chain_key") -> DataFrame:
    """How many rows an incremental build saves and skips."""
    known = existing.select(key).distinct().withColumn("__known", F.lit(1))
    return new.join(known, key, "left").agg(
        F.count_if(F.col("__known").isNull()).alias("saved"), F.count_if(F.col("__known").isNotNull()).alias("skipped"))
