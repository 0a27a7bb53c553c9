"""FASTA and aligned FASTA text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """FASTA files below ``path``, one row per file."""
    files = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(path))
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda s: F.trim(s)), "")


def fasta_records(files: DataFrame) -> DataFrame:
    """Records of each file: path, record_no, label, seq.

    A header without text is named after the number of its line, as
    ``seqnum`` and nine digits. Lines before the first header are not a record.
    """
    marked = F.concat(F.lit("\n"), F.regexp_replace("value", "\r\n?", "\n"))
    chunks = F.split(marked, "\n>")

    # The line of each header: one pass over the chunks that carries the lines so far.
    empty = F.struct(F.lit(-1).alias("next"), F.array().cast("array<int>").alias("done"))

    def count(acc, chunk):
        lines = F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"))) + 1
        return F.struct((acc["next"] + lines).alias("next"), F.concat(acc["done"], F.array(acc["next"])).alias("done"))

    starts = F.aggregate(chunks, empty, count, lambda acc: acc["done"])

    def parsed(chunk: Column, start: Column) -> Column:
        header = F.trim(F.substring_index(chunk, "\n", 1))
        named = F.when(F.length(header) > 0, header).otherwise(F.format_string("seqnum%09d", start))
        return F.struct(named.alias("label"), chunk.alias("chunk"))

    records = files.select("path", F.posexplode(F.zip_with(chunks, starts, parsed)).alias("record_no", "r"))
    lines = F.split(F.col("r.chunk"), "\n")
    return records.filter("record_no > 0").select(
        "path", (F.col("record_no") - 1).alias("record_no"), F.col("r.label").alias("label"),
        _joined(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("seq"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks between record marks with their place in the split and the lines of the split in front of them."""
    split, lines, place = None, 0, 0
    for batch in batches:
        out = []
        for path, block, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (path, block) != split:
                split, lines, place = (path, block), 0, 0
            for chunk in value.removesuffix("\r").replace("\r\n", "\n").replace("\r", "\n").split("\n>"):
                out.append((path, block, place, lines, chunk))
                lines, place = lines + chunk.count("\n") + 1, place + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _CHUNK.types)], schema=_CHUNK)


_CHUNK = pa.schema([("path", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("line", pa.int64()), ("chunk", pa.string())])


def read_fasta(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Records of FASTA files of any size: path, record_no, label, seq; see ``fasta_records``.

    Files are read in splits, cut at record marks, so a record is a row and no file has to fit in one. Each split counts its
    chunks and lines in one pass over its text; the sums of the splits in front of it, a row per split, are then added.
    Texts are not shuffled.
    """
    rows = (spark.read.format("text").option("lineSep", "\n>").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"))
    chunks = rows.mapInArrow(_numbered, "path string, block bigint, place bigint, line bigint, chunk string")
    lines = F.length("chunk") - F.length(F.replace("chunk", F.lit("\n"))) + 1
    splits = chunks.groupBy("path", "block").agg(F.count(F.lit(1)).alias("places"), F.sum(lines).alias("lines"),
                                                 F.max(F.when((F.col("block") == 0) & (F.col("place") == 0), F.col("chunk").startswith(">"))).alias("begins"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    sums = splits.select("path", "block", F.coalesce(F.sum("places").over(before), F.lit(0)).alias("places_before"),
                         F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"), F.max("begins").over(whole).alias("begins"))
    placed = chunks.join(sums, ["path", "block"]).select(
        "path", (F.col("places_before") + F.col("place")).alias("place"), (F.col("lines_before") + F.col("line")).alias("line"), "chunk", "begins")
    # What stands before the first mark of a file is no record, unless the file begins with one.
    records = placed.filter((F.col("place") > 0) | F.col("begins"))
    parts = F.split(F.when(F.col("place") == 0, F.substring("chunk", 2, 2**31 - 1)).otherwise(F.col("chunk")), "\n")
    header = F.trim(F.element_at(parts, 1))
    return records.select(
        "path", (F.col("place") - F.when(F.col("begins"), 0).otherwise(1)).cast("int").alias("record_no"),
        F.when(F.length(header) > 0, header).otherwise(F.format_string("seqnum%09d", "line")).alias("label"),
        _joined(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("seq"))


def duplicate_labels(records: DataFrame) -> DataFrame:
    return records.groupBy("path", "label").count().filter("count > 1")


def require_unique_labels(records: DataFrame) -> DataFrame:
    """The records, after a check that no file repeats a label."""
    repeated = duplicate_labels(records).limit(1).take(1)
    if repeated:
        raise ValueError(f"duplicate sequence label {repeated[0]['label']!r} in {repeated[0]['path']}")
    return records


def clean_alignment(df: DataFrame, column: str = "seq", keep_gaps: bool = True, keep_insertions: bool = True,
                    to_upper: bool = False) -> DataFrame:
    """Drop gaps ('-'), drop lower-case insertions, upper-case; in this order."""
    value = F.col(column)
    if not keep_gaps:
        value = F.regexp_replace(value, "-", "")
    if not keep_insertions:
        value = F.regexp_replace(value, "[a-z]", "")
    return df.withColumn(column, F.upper(value) if to_upper else value)


def check_msa(msa: DataFrame) -> DataFrame:
    """Rows, shortest, longest, and whether all rows of an alignment have one length."""
    width = F.length("seq")
    return msa.groupBy("msa_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(width).alias("min_len"), F.max(width).alias("max_len"),
    ).withColumn("aligned", F.col("min_len") == F.col("max_len"))
