"""Document fingerprints from content-defined chunks.

A gear hash runs over the UTF-8 bytes of a text; each step shifts it and adds a random number of the byte, so it depends
on the last 32 bytes only. A chunk ends where masked bits of the hash are zero. Chunk sizes are normalised: before the
normal size more bits must be zero, after it fewer, and there are a least and a greatest size. Boundaries follow the
content, so an edit changes the chunks around it and no others. The fingerprint is the set of chunk digests with their
lengths; likeness is the length two sets share over the length of the shorter set: containment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from math import inf, nextafter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes (at most 255), zero bits wanted before and after the normal size, and the seed of the gear table."""

    least: int = 8
    normal: int = 24
    most: int = 96
    bits_before: int = 6
    bits_after: int = 3
    seed: int = 17


@lru_cache(maxsize=4)
def _gear(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: bytes, seed: int) -> np.ndarray:
    """The rolling hash after each byte, as 32-bit numbers: sum of gear[b] << age over the last 32 bytes."""
    h = _gear(seed)[np.frombuffer(data, dtype=np.uint8)]
    for age in (1, 2, 4, 8, 16):  # each step doubles the number of bytes summed
        if age >= len(h):
            break
        older = h[:-age] << np.uint32(age)
        h[age:] += older
    return h


def cuts(data: bytes, how: Chunking) -> list[int]:
    """Ends of the chunks of ``data``, the last being its length."""
    size = len(data)
    if size <= how.least:
        return [size] if size else []
    h = gear_hashes(data, how.seed)
    loose = np.flatnonzero((h >> np.uint32(32 - how.bits_after)) == 0)
    strict = (loose[(h[loose] >> np.uint32(32 - how.bits_before)) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    ends, start = [], 0
    while size - start > how.least:
        top = min(start + how.most, size)
        k = bisect_left(strict, start + how.least)
        end = strict[k] if k < len(strict) and strict[k] <= start + how.normal else 0
        if not end:
            k = bisect_left(loose, start + how.normal)
            end = loose[k] if k < len(loose) and loose[k] < top else top
        ends.append(min(end, size))
        start = ends[-1]
    if start < size:
        ends.append(size)
    return ends


Chunks = dict[str, int]  # digest (8 hex digits) -> length


def chunks(data: bytes, how: Chunking = Chunking()) -> Chunks:
    """Distinct chunk digests of one text with their lengths."""
    digest = xxhash.xxh32_hexdigest
    start, found = 0, {}
    for end in cuts(data, how):
        found[digest(data[start:end])] = end - start
        start = end
    return found


def to_string(found: Chunks) -> str:
    """The set as text: 10 hex digits for each chunk, digest and length, in the order of the digests."""
    return "".join([f"{d}{n:02x}" for d, n in sorted(found.items())])


def from_string(fingerprint: str) -> Chunks:
    return {fingerprint[k:k + 8]: int(fingerprint[k + 8:k + 10], 16) for k in range(0, len(fingerprint), 10)}


def likeness(a: Chunks, b: Chunks) -> float:
    """Shared length over the length of the shorter set, 0 to 1; two empty sets are alike, an empty and another not."""
    if not a or not b:
        return float(not a and not b)
    shared = sum(a[d] for d in a.keys() & b.keys() if a[d] == b[d])
    return shared / min(sum(a.values()), sum(b.values()))


# ---------------------------------------------------------------- the next document

#: Rows that a range of ids holds on average.
ROWS = 100_000


def with_next(docs: DataFrame, ranges: int | None = None, rows_per_range: int = ROWS) -> DataFrame:
    """doc_id, text (null: empty), to (a range) and end, ready to be read range by range.

    Rows are dealt to ranges of doc_id, descending, and sorted inside; a range is followed by a copy of the first row
    of the next one that has rows (``end``), so that every row finds its successor behind it. Whole texts travel once,
    plus one text per range. The last range is followed by the first row of all. Null ids come last. Borders are
    quantiles of doc_id. There is a range for ``rows_per_range`` rows and four per shuffle partition at least; a range that
    holds one id only, or null ids, is cut by the hash of the text into as many pieces. The driver gets a border, a count
    and a first id of each. Rows are read one by one, so a range may be of any size.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.col("doc_id").cast("double").alias("at"))
    ranges = ranges or max(4 * partitions, -(-rows.count() // rows_per_range))
    quantiles = F.percentile_approx("at", F.lit([k / ranges for k in range(1, ranges)] or [0.5]), F.lit(max(10_000, 20 * ranges)))
    found = Counter(rows.agg(quantiles.alias("q")).first()["q"] or [0.0])
    borders = sorted({*found, *(nextafter(b, inf) for b, times in found.items() if times > 1)})  # a frequent id has a range of its own
    splits = [float("-inf"), *borders, float("inf")]
    placed = Bucketizer(splits=splits, inputCol="at", outputCol="bucket", handleInvalid="keep").transform(rows)
    part = F.when(F.col("at").isNull(), len(splits)).otherwise(len(splits) - 1 - F.col("bucket")).cast("bigint")
    keyed = placed.select("doc_id", "text", part.alias("part"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"))
    sizes = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    single = sizes.filter((F.col("low") == F.col("high")) & (F.col("n") > rows_per_range)).select("part", F.ceil(F.col("n") / rows_per_range).alias("pieces"))
    cut = {r["part"]: r["pieces"] for r in single.collect()}  # at most a row per range
    if cut:
        pieces = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in cut.items() for x in pair]), F.col("part")), F.lit(1))
        along = 0.5 - F.col("h") / F.lit(float(1 << 64))  # falls as the hash rises
        piece = F.least(pieces - 1, F.floor(along * pieces))
    else:
        piece = F.lit(0)
    keyed = keyed.withColumn("part", F.col("part") * (1 << 32) + piece)

    heads = keyed.groupBy("part").agg(F.max(F.struct("id", "h")).alias("m")).select("part", "m.id", "m.h").collect()  # a row per range
    order = sorted(r["part"] for r in heads)
    before = {p: order[k - 1] for k, p in enumerate(order)}  # the range in front, the last one for the first
    ahead = spark.createDataFrame([(r["part"], r["id"], r["h"], before[r["part"]]) for r in heads], "part bigint, id bigint, h bigint, ahead bigint")
    own = F.struct(F.col("part").alias("to"), F.lit(False).alias("end"))
    copy = F.struct(F.col("ahead").alias("to"), F.lit(True).alias("end"))
    marked = keyed.join(F.broadcast(ahead), ["part", "id", "h"], "left")  # a row per range
    sent = marked.select("doc_id", "text", "id", "h", F.explode(F.when(F.col("ahead").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("c"))
    dealt = sent.select("doc_id", "text", "id", "h", "c.to", "c.end").repartition(min(partitions, ranges), "to")
    return dealt.sortWithinPartitions("to", "end", F.desc("id"), F.desc("h")).select("doc_id", "text", "to", "end")


def compare_with_edited(docs: DataFrame, how: Chunking = Chunking(), ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the next document (or
    all, if it is shorter) in descending order of doc_id; the last row's next is the first. A single row is its own
    next. Rows with one doc_id follow each other by a hash of their texts, null ids come last. Null texts are empty: an
    empty fingerprint, like to another empty one. Equal texts have equal fingerprints. An empty table gives no rows;
    other columns are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor: doc_id, text, bytes, chunks, range
        for batch in batches:
            rows = []
            for doc_id, text, to, end in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "to", "end"))):
                data = text.encode()
                found = chunks(data, how)
                if held is not None and held[4] == to:
                    rows.append(finish(held, text, found))
                held = None if end else (doc_id, text, data, found, to)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    def finish(held: tuple, next_text: str, next_found: Chunks) -> tuple:
        doc_id, text, _, found, _ = held
        half = len(text) // 2
        edited = (text[:len(text) - half] + next_text[:half]).encode()
        changed = chunks(edited, how)
        return (doc_id, len(text), sha256(edited).hexdigest(), to_string(found), to_string(changed), likeness(found, changed), likeness(found, next_found))

    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return with_next(docs, ranges).mapInArrow(run, schema)
