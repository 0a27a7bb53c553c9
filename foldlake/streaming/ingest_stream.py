"""Incremental ingest of structure files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import CONTACT_CUTOFF, MIN_CHAIN_LENGTH, MIN_SEPARATION
from ..operators.chains import all_chains, assemble_chains
from ..sources import structures

_FILE = "pdb_id string, path string, records bigint, broken bigint, state string, value string"


def stream_structures(spark: SparkSession, path: str, glob: str = "*.pdb", files_per_trigger: int = 1000) -> DataFrame:
    """New structure files as a stream: pdb_id, path, whole text."""
    files = (spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path))
    return files.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("pdb_id"),
        F.col("_metadata.file_path").alias("path"), "value",
    )


def ingest_available(spark: SparkSession, source: str, sink: str, checkpoint: str, glob: str = "*.pdb") -> StreamingQuery:
    """Parse the files that arrived since the last run and append their atoms, broken ones below ``broken=true``.

    The checkpoint remembers the files done, so a restart neither repeats nor loses one. There is no other state.
    Whether a broken record rejects its file is decided by those who read the sink (``structures.split_rejects``).
    """
    atoms = structures.parse_atoms(structures.structure_lines(stream_structures(spark, source, glob)))
    marked = atoms.withColumn("broken", structures.broken())
    return (marked.writeStream.format("parquet").partitionBy("broken").option("path", sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# ---------------------------------------------------------------- chains, each stem once

def _settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of every new file of one stem. The first unbroken path of the first batch that has one is taken and remembered.

    Only the file that is taken keeps its text.
    """
    taken = state.exists
    files = pd.concat(list(frames)).sort_values("path", kind="stable")
    states = []
    for broken in files["broken"]:
        states.append("broken" if broken else "repeated" if taken else "ok")
        taken = taken or not broken
    if taken and not state.exists:
        state.update((files["path"].iloc[states.index("ok")],))
    files["state"] = states
    files["value"] = files["value"].where(files["state"] == "ok", None)
    yield files[["pdb_id", "path", "records", "broken", "state", "value"]]


def file_states_of(files: DataFrame) -> DataFrame:
    """The stream of files (pdb_id, path, value) with records, broken and state, and the text of those to be built.

    What is known of a stem is keyed state of the query: one path per stem, in Spark's state store.
    """
    records, broken = structures.record_counts(F.col("value"))
    judged = files.select("pdb_id", "path", records.alias("records"), broken.alias("broken"), "value").filter("records > 0")
    return judged.groupBy("pdb_id").applyInPandasWithState(_settle, _FILE, "path string", "append", GroupStateTimeout.NoTimeout)


def build_chains(files: DataFrame, sink: str, checkpoint: str, min_len: int = MIN_CHAIN_LENGTH, cutoff: float = CONTACT_CUTOFF,
                 min_sep: int = MIN_SEPARATION, before_commit=None) -> StreamingQuery:
    """Chain records of the files that arrived since the last run, below ``sink``; a stem that is stored already is skipped.

    ``files`` is a stream of (pdb_id, path, value). Each batch writes folders of its own, named by its number: first its
    chains, then its files with their states and counts. The files are one small file, and a batch counts once that is
    there (``read_chains``, ``read_files``). A batch that is run again, after a stop at any point, has the same files and
    finds the state as it was before, and its folders replace those of the first try. ``before_commit`` (batch number) is
    called between both writes.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        atoms = structures.parse_atoms(structures.structure_lines(batch.filter("state = 'ok'")))
        residues = structures.residues(atoms)
        assemble_chains(residues, min_len, cutoff, min_sep).write.mode("overwrite").parquet(f"{sink}/chains/batch={number}")
        if before_commit:
            before_commit(number)
        kept = (F.col("L") >= min_len) & (F.col("n_ca") > 0)
        counts = all_chains(residues).groupBy("path").agg(F.count_if(kept).alias("saved"), F.count_if(~kept).alias("skipped"))
        listed = batch.drop("value").join(counts, "path", "left").select(
            "pdb_id", "path", "records", "broken", "state", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("saved", "skipped")])
        # Moved, not coalesced: the joins and sorts in front keep their tasks.
        listed.repartition(1).write.mode("overwrite").parquet(f"{sink}/files/batch={number}")  # as many rows as files in a batch
        batch.unpersist()

    return (file_states_of(files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_files(spark: SparkSession, sink: str) -> DataFrame:
    """Files of all complete batches: pdb_id, path, records, broken, state, saved, skipped (chains), batch."""
    schema = "pdb_id string, path string, records bigint, broken bigint, state string, saved bigint, skipped bigint, batch bigint"
    return spark.read.schema(schema).parquet(f"{sink}/files")


def read_chains(spark: SparkSession, sink: str) -> DataFrame:
    """Chain records of all complete batches."""
    complete = read_files(spark, sink).select("batch").distinct()
    return spark.read.parquet(f"{sink}/chains").join(complete, "batch", "left_semi").drop("batch")


def build_counts(files: DataFrame) -> DataFrame:
    """Files read, broken and repeated files, chains kept and skipped, of ``read_files``."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("state") == "broken").alias("failed"),
                     F.count_if(F.col("state") == "repeated").alias("repeated"),
                     F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
