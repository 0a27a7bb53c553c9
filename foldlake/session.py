"""Spark session settings the library is written for."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "foldlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Joins whose partitions turn out small are hashed instead of sorted; decided on measured sizes.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Lists of the folders made inside the open ``temporary_tables``.
_watched: ContextVar[tuple[list[str], ...]] = ContextVar("watched", default=())


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Folders that the library makes inside are removed at the end; write or collect results before.

        with temporary_tables(spark):
            retrieve.topk_similar(queries, index).write.parquet(target)
    """
    made: list[str] = []
    token = _watched.set((*_watched.get(), made))
    try:
        yield made
    finally:
        _watched.reset(token)
        for folder in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors can read and write.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. A temporary one is made only where
    driver and executors are one process on one machine, as in tests; elsewhere the setting is required.
    """
    folder = _new_folder(spark)
    for names in _watched.get():
        names.append(folder)
    return folder


def _new_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="foldlake-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{base.rstrip('/')}/foldlake-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    Used where several later steps read the same rows: they are computed once, survive lost executors, and only the
    columns a step needs are read again.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/table"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def spread(df: DataFrame, *keys) -> DataFrame:
    """``df`` dealt out to as many partitions as ``spark.foldlake.text.partitions`` says; as it is where that is not set.

    For tables of one small file that feed CPU-heavy stages on many cores. Large tables come in many splits anyway.
    """
    partitions = int(df.sparkSession.conf.get("spark.foldlake.text.partitions", "0"))
    return df.repartition(partitions, *keys) if partitions else df


def tasks_for(table: DataFrame, rows: int = 500_000) -> int:
    """Tasks of about ``rows`` rows of ``table``, as many as run at once at least; only a Parquet table's footers are read."""
    spark = table.sparkSession
    at_once = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(at_once, -(-table.count() // rows))
