"""Vector best-fit packing of token sequences.

Every piece has three demands: tokens, one document, and attention cost (its length squared). A bin has a capacity for
each. The next piece, longest first, goes to the open bin with the best score among those in which all three demands
fit; a new bin is opened when none does. Scores: ``residual`` takes the smallest weighted norm of what would be left,
``dot`` the largest weighted dot product of demands and room.

A piece's demands depend on its length alone, and lengths end at the token capacity. So the whole corpus is packed
exactly from its length histogram (at most ``capacity`` rows, which is all the driver gets): bins with equal room are
filled in runs, and each run is a range of places within one length. Every piece finds its run by its place among the
pieces of its length. Places are counted in hash buckets, so that a length which holds most pieces is many small keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .encoding import encoder

END_ID = 2


@dataclass(frozen=True)
class Limits:
    """Capacities of a bin and the weights (tokens, documents, attention cost) of the score.

    All three take part in the score. The default capacities for documents and cost can never bind before the tokens do, so
    that as few bins as possible are made.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    score: str = "residual"

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.float64)


@dataclass
class Runs:
    """Ranges of places within a length, with the bins they fill."""

    length: np.ndarray  # sorted, then by first
    first: np.ndarray  # first place of the range
    bin: np.ndarray  # bin of the first place
    each: np.ndarray  # pieces per bin
    offset: np.ndarray  # tokens before the range's first piece in every bin
    bins: int  # bins in all


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> Runs:
    """Pack ``histogram`` (length -> pieces) by vector best-fit, longest first."""
    cap = limits.capacity()
    weights = np.asarray(limits.weights, dtype=np.float64)
    if limits.score not in ("residual", "dot"):
        raise ValueError(f"unknown score {limits.score!r}")
    room = np.empty((256, 3), dtype=np.float64)  # room left in each bin of a group of equal bins
    start = np.empty(256, dtype=np.int64)
    count = np.zeros(256, dtype=np.int64)
    groups = bins = 0
    out: list[tuple[int, int, int, int, int]] = []

    def add(left: np.ndarray, first_bin: int, n: int) -> None:
        nonlocal room, start, count, groups
        if n <= 0 or left[0] < 1 or left[1] < 1 or left[2] < 1:
            return
        if groups == len(count):
            room, start, count = np.vstack([room, np.empty_like(room)]), np.append(start, start * 0), np.append(count, count * 0)
        room[groups], start[groups], count[groups] = left, first_bin, n
        groups += 1

    def score(left: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Lower is better."""
        if limits.score == "dot":
            return -((weights * (need / cap) * (left / cap)).sum(axis=-1))
        return np.sqrt((weights * ((left - need) / cap) ** 2).sum(axis=-1))

    def fill(left: np.ndarray, need: np.ndarray) -> int:
        """Pieces that go into one bin before another one of equal room becomes better."""
        best, each = score(left, need), 0
        while (left >= need).all() and (each == 0 or score(left, need) <= best):
            left, each = left - need, each + 1
        return each

    for length in sorted(histogram, reverse=True):
        waiting, place = int(histogram[length]), 0
        need = np.array([length, 1.0, float(length) * length])
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while waiting:
            fits = np.flatnonzero((count[:groups] > 0) & (room[:groups] >= need).all(axis=1))
            if len(fits):
                g = fits[np.argmin(score(room[fits], need))]
                left, at, there = room[g].copy(), int(start[g]), int(count[g])
                each = fill(left, need)
            else:
                left, at = cap, bins
                each = int(np.min(cap // need))
                there = -(-waiting // each)
                bins += there
            full = min(there, waiting // each)
            rest = waiting - full * each if full < there else 0
            offset = int(cap[0] - left[0])
            out.append((length, place, at, each, offset))
            add(left - each * need, at, full)
            add(left - rest * need, at + full, int(rest > 0))
            place, waiting = place + full * each + rest, waiting - full * each - rest
            if len(fits):
                used = full + (rest > 0)
                start[g], count[g] = at + used, there - used
    runs = np.array(sorted(out), dtype=np.int64).reshape(-1, 5)
    return Runs(runs[:, 0], runs[:, 1], runs[:, 2], runs[:, 3], runs[:, 4], bins)


def encode(docs: DataFrame, path: str, capacity: int, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_ids and ids_crc32 of every piece, the first (short) piece first. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], dtype="<u4")
        for batch in batches:
            ids, counts, crcs = batch.column(0), [], []
            for text in batch.column(1).to_pylist():
                tokens = np.concatenate([enc.array(text or "").astype("<u4", copy=False), end])
                raw, n = memoryview(tokens.tobytes()), len(tokens)
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                counts.append(n)
                crcs.append([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "n_ids", "crcs"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_ids bigint, crcs array<bigint>")


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = END_ID, rows_per_bucket: int = 20_000) -> DataFrame:
    """Pack ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; one with more than ``limits.tokens`` ids is cut into full pieces after a
    first piece that takes the rest. A null or empty text is the single id ``end_id``. Null and repeated doc_ids are
    packed row by row, like any other. An empty table gives no rows. Other columns are not read.
    """
    capacity = limits.tokens
    encoded = stored(encode(docs, path, capacity, end_id))
    rows = encoded.count()
    buckets = max(256, -(-rows // rows_per_bucket))
    head = ((F.col("n_ids") - 1) % capacity + 1).alias("head")
    bucket = F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(buckets)).alias("bucket")
    keyed = encoded.select("doc_id", "n_ids", "crcs", head, bucket, F.expr(f"(n_ids - 1) div {capacity}").alias("full"))
    cells = stored(keyed.groupBy("head", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")))

    histogram = {r["head"]: (r["n"], r["full"]) for r in cells.groupBy("head").agg(  # at most `capacity` rows
        F.sum("n").alias("n"), F.sum("full").alias("full")).collect()}
    runs = plan({h: n for h, (n, _) in histogram.items()}, limits)
    full_before, so_far = {}, runs.bins
    for h in sorted(histogram):
        full_before[h], so_far = so_far, so_far + histogram[h][1]
    firsts = F.create_map(*[F.lit(int(x)) for pair in full_before.items() for x in pair]) if full_before else F.create_map(F.lit(0), F.lit(0))

    before = Window.partitionBy("head").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        "head", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        (F.coalesce(F.sum("full").over(before), F.lit(0)) + F.element_at(firsts, F.col("head").cast("int"))).alias("full_before"))
    inside = Window.partitionBy("head", "bucket").orderBy("doc_id", "n_ids", "crcs")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(offsets, ["head", "bucket"]).select(
        "doc_id", "n_ids", "crcs", "head",
        (F.row_number().over(inside) - 1 + F.col("n_before")).alias("place"),
        (F.sum("full").over(upto) - F.col("full") + F.col("full_before")).alias("full_at"))

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(runs)  # a few runs per length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table.length << 44 | table.first
        for batch in batches:
            if batch.num_rows == 0:
                continue
            head, place, full_at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("head", "place", "full_at"))
            at = np.searchsorted(key, head << 44 | place, side="right") - 1
            inner = place - table.first[at]
            bin_of, turn = table.bin[at] + inner // table.each[at], inner % table.each[at]
            pieces = batch.column("crcs").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            is_head = piece == 0
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(np.where(is_head, 0, head[row] + (piece - 1) * capacity), pa.int64()),
                pa.array(np.where(is_head, head[row], capacity), pa.int64()),
                batch.column("crcs").flatten(),
                pa.array(np.where(is_head, bin_of[row], full_at[row] + piece - 1), pa.int64()),
                pa.array(np.where(is_head, (table.offset[at] + turn * head)[row], 0), pa.int64()),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return placed.mapInArrow(assign, schema)
