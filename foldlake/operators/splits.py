"""Reproducible train/validation splits and stored, named splits."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SEED, VAL_RATIO
from ..functions.ordering import hash_pieces, ordinal
from ..functions.scalars import seeded


def split_ids(ids: DataFrame, ratio: float = VAL_RATIO, seed: int = SEED) -> DataFrame:
    """Ids with ``split`` val or train.

    The ids in shuffled order are cut after round(ratio * N), half to even, at
    least 1 and at most N - 1. The shuffle is by seeded hash, and its places are
    found piece by piece, so no task sorts all ids.
    """
    hashed = ids.select("pdb_id", seeded(F.col("pdb_id"), seed).alias("__h"))
    placed = ordinal(hashed, [], [F.col("__h"), F.col("pdb_id")], hash_pieces(F.col("__h")), "place")
    total = ids.agg(F.count(F.lit(1)).alias("n"))
    n_val = total.select(F.greatest(F.lit(1), F.least(F.bround(F.col("n") * ratio).cast("bigint"), F.col("n") - 1)).alias("v")).scalar()
    return placed.select("pdb_id", F.when(F.col("place") < n_val, "val").otherwise("train").alias("split"))


def split_tag(ratio: float, seed: int, min_len: int) -> str:
    return f"val{int(ratio * 100)}_seed{seed}_min{min_len}"


class _Folder:
    """Folders of the store that holds ``path``, by their names in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        root = self._at("")
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri())
        self.no_options = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        return self.context.util().exists(self._at(name))

    def rename(self, old: str, new: str) -> bool:
        """Whether ``old`` was renamed; not where ``new`` is there, or ``old`` is not. Other errors pass through."""
        try:
            self.context.rename(self._at(old), self._at(new), self.no_options)
        except Py4JJavaError as error:
            kind = error.java_exception.getClass().getSimpleName()
            if kind in ("FileAlreadyExistsException", "FileNotFoundException"):
                return False
            raise
        return True


def publish(df: DataFrame, path: str, name: str) -> bool:
    """Write ``df`` as Parquet folder ``name`` below ``path``, seen whole or not at all; False where another writer was first.

    The rows are written beside it, below a hidden name, and the folder is renamed when it is complete. A folder without a
    mark of completion under that name is what is left of a broken write: it is renamed out of the way.
    """
    folder, beside = _Folder(df.sparkSession, path), f".{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder.path}/{beside}")
    if folder.has(name) and not folder.has(f"{name}/_SUCCESS"):
        folder.rename(name, f".{name}-broken-{uuid.uuid4().hex}")
    return folder.rename(beside, name)


def published(spark: SparkSession, path: str, name: str) -> bool:
    """Whether the folder is there and complete."""
    return _Folder(spark, path).has(f"{name}/_SUCCESS")


def named_split(spark: SparkSession, path: str, tag: str, ids: DataFrame, ratio: float = VAL_RATIO, seed: int = SEED,
                lists: DataFrame | None = None) -> DataFrame:
    """The stored split of this name; made and stored on first use.

    Only a complete folder counts as stored. Of several writers the first to finish wins, and all return its split. Errors
    in reading a stored split pass through. ``lists`` (pdb_id, split), when given, is returned instead, as it is.
    """
    if lists is not None:
        return lists
    name = f"tag={tag}"
    if not published(spark, path, name):
        publish(split_ids(ids, ratio, seed), path, name)
    return spark.read.schema("pdb_id string, split string").parquet(f"{path.rstrip('/')}/{name}")
