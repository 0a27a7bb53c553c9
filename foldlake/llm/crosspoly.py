"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform. Under it a unit vector falls to the
nearest signed axis, which is its cell in one table; there are several tables with rotations of their own. A query probes
the cells of its largest signed coordinates, in that order, in every table. What the probed cells hold is scored exactly.

* With many vectors a second rotation refines the cells: the nearest of its first ``fine`` axes is the second half of a
  cell's number, so that cells hold about ``CELL`` vectors however many there are. Probes go by the sum of both coordinates.
* The number of probes is fitted: for a bounded sample of queries (``SAMPLE``) the exact neighbours are found over all
  vectors, and the fewest probes are taken that reach ``TARGET`` of them. All vectors are indexed.
* Equal vectors are one class, of which only the first ``k + 1`` ids can be results. A cell with more than ``PIECE`` classes
  is cut into pieces, and a query visits each.
* Nearness is the inner product. Where lengths differ, an index vector gets one more coordinate that brings it to the
  length of the longest, which turns inner products into angles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

TABLES, CELL, PIECE = 8, 4096, 4096
#: Queries whose exact neighbours set the number of probes, and the share of these neighbours that the probes must reach.
SAMPLE, TARGET = 128, 0.96
SEED = 42
#: Room for the rounding of matrix products, relative to the lengths; what lies inside is summed again, row by row.
_SLACK = 1e-11


# ---------------------------------------------------------------- hashing

def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        pair = x.reshape(rows, width // (2 * half), 2, half)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(rows, width)
        half *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """Rows of ``x``, filled up to a power of two, after the pseudo-rotation of a table."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    signs = np.random.default_rng([SEED, x.shape[1], table, part]).choice([-1.0, 1.0], (3, width))
    out = np.zeros((len(x), width))
    out[:, :x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return out


def _signed(x: np.ndarray, table: int, part: int, axes: int) -> np.ndarray:
    y = rotated(x, table, part)[:, :axes]
    return np.concatenate([y, -y], axis=1)


def cells(x: np.ndarray, table: int, fine: int) -> np.ndarray:
    """The cell of each row: the nearest signed axis, refined by a second rotation's first ``fine`` axes."""
    cell = _signed(x, table, 0, _width(x)).argmax(axis=1)
    return cell * 2 * fine + _signed(x, table, 1, fine).argmax(axis=1) if fine else cell


def probed(x: np.ndarray, table: int, fine: int, probes: int) -> np.ndarray:
    """The first ``probes`` cells of each row, nearest first."""
    coarse = _signed(x, table, 0, _width(x))
    first = np.argsort(-coarse, axis=1, kind="stable")[:, :probes]
    if not fine:
        return first
    refined = _signed(x, table, 1, fine)
    second = np.argsort(-refined, axis=1, kind="stable")[:, :probes]
    both = np.take_along_axis(coarse, first, 1)[:, :, None] + np.take_along_axis(refined, second, 1)[:, None, :]
    names = first[:, :, None] * (2 * fine) + second[:, None, :]
    order = np.argsort(-both.reshape(len(x), -1), axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(names.reshape(len(x), -1), order, 1)


def _width(x: np.ndarray) -> int:
    return 1 << max(0, x.shape[1] - 1).bit_length()


def _cell_count(dims: int, fine: int) -> int:
    return 2 * (1 << max(0, dims - 1).bit_length()) * (2 * fine or 1)


def _lengths(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0)
    return top * np.sqrt(((x / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))


def _as_unit(x: np.ndarray, longest: float, lifted: bool, query: bool) -> np.ndarray:
    """Vectors as they are hashed: of unit length, lifted by one coordinate where lengths differ."""
    if not lifted:
        return x / _lengths(x)[:, None]
    if query:
        return np.column_stack([x / _lengths(x)[:, None], np.zeros(len(x))])
    short = x / longest
    return np.column_stack([short, np.sqrt(np.maximum(0, 1 - (short ** 2).sum(axis=1)))])


# ---------------------------------------------------------------- scores

def _matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    """Vectors stored as floats or doubles, as doubles."""
    flat = b"".join(vectors)
    kind = np.float32 if len(flat) == 4 * dims * len(vectors) else np.float64
    return np.frombuffer(flat, dtype=kind).astype(np.float64).reshape(len(vectors), dims)


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, row of ``x`` and score of the ``k`` largest inner products of each query; equal ones by rising ``ids``.

    Products shortlist the pairs, and the sums of the shortlist are made again row by row, so that a pair has the same
    score in whatever unit it is met.
    """
    found = q @ x.T
    width = min(k, len(x))
    least = np.partition(found, len(x) - width, axis=1)[:, len(x) - width] - _SLACK * (_lengths(q) * _lengths(x).max())
    i, j = np.nonzero(found >= least[:, None])
    score = np.concatenate([np.empty(0), *((q[i[a:a + 65536]] * x[j[a:a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536))])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    starts = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - starts[i] < k
    return i[keep], j[keep], score[keep]


# ---------------------------------------------------------------- index

def _vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, dims, v (bytes of floats where the column has floats, else of doubles), length: the rows that take part, equal rows once."""
    x = F.col(vector)
    single = table.schema[vector].dataType.elementType == T.FloatType()
    kind, arrow = (np.float32, pa.float32()) if single else (np.float64, pa.float64())
    numbers = x.cast("array<float>" if single else "array<double>")
    whole = F.col(key).isNotNull() & x.isNotNull() & F.forall(numbers, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(numbers, lambda c: c != 0)
    rows = table.filter(whole).select(F.col(key).cast("bigint").alias("vec_id"), numbers.alias("x")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().cast(arrow).to_numpy(zero_copy_only=False) + kind(0)  # no negative zeros
            sizes = np.diff(lists.offsets.to_numpy())
            found = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
            lengths = [float(_lengths(v[None, :].astype(np.float64))[0]) for v in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array([v.tobytes() for v in found], pa.binary()), pa.array(lengths, pa.float64())],
                names=["vec_id", "dims", "v", "length"])

    return rows.mapInArrow(run, "vec_id bigint, dims int, v binary, length double")


def _first_ids(rows: DataFrame, k: int) -> DataFrame:
    """class, vec_id: the ``k`` smallest ids of each class; over parts of a class first."""
    part = Window.partitionBy("class", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    cut = rows.select("class", "vec_id").distinct().withColumn("n", F.row_number().over(part)).filter(F.col("n") <= k)
    return cut.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))).filter(F.col("n") <= k).drop("n")


def fit_probes(classes: DataFrame, asked: DataFrame, dims: int, longest: float, lifted: bool, fine: int, k: int, tables: int, sample: int, target: float) -> int:
    """The fewest probes a table that reach ``target`` of the exact neighbours of ``sample`` queries."""
    picked = asked.orderBy(F.xxhash64("class", F.lit(SEED)), "class").limit(sample).select("class", "v").collect()
    if not picked:
        return 1
    numbers, q = np.array([r["class"] for r in picked]), _matrix([r["v"] for r in picked], dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number = batch.column(0).to_numpy()
                i, j, score = nearest(q, _matrix(batch.column(1).to_pylist(), dims), number, k + 1)
                other = numbers[i] != number[j]
                i, j, score = i[other], j[other], score[other]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(number[j]), pa.array(score), batch.column(1).take(pa.array(j))], names=["i", "class", "score", "v"])

    lists = classes.select("class", "v").mapInArrow(run, "i bigint, class bigint, score double, v binary")
    rank = lambda *by: F.row_number().over(Window.partitionBy("i", *by).orderBy(F.desc("score"), "class"))
    cut = lists.withColumn("n", rank(F.pmod(F.xxhash64("class"), F.lit(64)))).filter(F.col("n") <= k)
    known = cut.withColumn("n", rank()).filter(F.col("n") <= k).select("i", "v").collect()  # at most sample x k rows
    if not known:
        return 1
    who = np.array([r["i"] for r in known])
    units, asks = _as_unit(_matrix([r["v"] for r in known], dims), longest, lifted, False), _as_unit(q, longest, lifted, True)
    turns = np.full(len(who), np.iinfo(np.int64).max)
    for table in range(tables):
        own = cells(units, table, fine)
        for i in range(len(q)):
            mine = np.flatnonzero(who == i)
            if len(mine):
                order = probed(asks[i:i + 1], table, fine, _cell_count(units.shape[1], fine))[0]
                turn = np.empty(len(order), dtype=np.int64)
                turn[order] = np.arange(len(order))
                turns[mine] = np.minimum(turns[mine], turn[own[mine]])
    return int(np.sort(turns)[int(np.ceil(target * len(turns))) - 1]) + 1


def _hashed(classes: DataFrame, dims: int, longest: float, lifted: bool, fine: int, tables: int, probes: int | None) -> DataFrame:
    """class, first_id, v, cells: of the tables, in order; with ``probes``, the cells that a query visits."""
    count = _cell_count(dims + lifted, fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _as_unit(_matrix(batch.column(2).to_pylist(), dims), longest, lifted, probes is not None)
                if probes is None:
                    found = np.stack([cells(unit, t, fine) + t * count for t in range(tables)], axis=1)
                else:
                    found = np.concatenate([probed(unit, t, fine, probes) + t * count for t in range(tables)], axis=1)
                offsets = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(found.ravel(), pa.int64()))],
                                                 names=["class", "first_id", "v", "cells"])

    return classes.select("class", "first_id", "v").mapInArrow(run, "class bigint, first_id bigint, v binary, cells array<bigint>")


def _visited(index: DataFrame, queries: DataFrame, dims: int, k: int, piece: int) -> DataFrame:
    """query, class, first_id, score: the best ``k`` classes of each piece of a cell for each query that visits it."""
    sizes = stored(index.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / piece).alias("pieces")))
    dealt = F.pmod(F.xxhash64("class", F.lit(5)), F.col("pieces")).alias("piece")
    held = index.select("class", "first_id", "v", F.explode("cells").alias("cell")).join(sizes, "cell").select(
        "cell", dealt, F.lit(1).alias("kind"), "class", "first_id", "v")
    asks = queries.select("class", "first_id", "v", F.explode("cells").alias("cell")).join(sizes, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("kind"), "class", "first_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices():
            for batch in batches:
                keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in ("cell", "piece")])
                cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]]).tolist()
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        yield tuple(keys[:, a].tolist()), batch.slice(a, b - a)

        for _, unit in groupby(slices(), lambda s: s[0]):
            rows = pa.Table.from_batches([s for _, s in unit])
            kind, number, first = (rows[n].to_numpy() for n in ("kind", "class", "first_id"))
            if kind.min() == kind.max():
                continue
            matrix = _matrix(rows["v"].to_pylist(), dims)
            a, b = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            for begin in range(0, len(a), 1024):
                part = a[begin:begin + 1024]
                i, j, score = nearest(matrix[part], matrix[b], first[b], k)
                yield pa.RecordBatch.from_arrays([pa.array(number[part][i]), pa.array(number[b][j]), pa.array(first[b][j]), pa.array(score)],
                                                 names=["query", "class", "first_id", "score"])

    rows = held.unionByName(asks).repartition("cell", "piece").sortWithinPartitions("cell", "piece")
    return rows.mapInArrow(run, "query bigint, class bigint, first_id bigint, score double")


def search(table: DataFrame, is_query: str, k: int = 20, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int | None = None,
           fine: int | None = None, sample: int = SAMPLE, target: float = TARGET, piece: int = PIECE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows with the largest inner products found for every query row.

    ``is_query`` is the condition on ``vec_id`` that query rows meet. Candidates are all rows but those with the query's own
    id; equal scores go to the smaller id. Scores are inner products of the given vectors in doubles. ``probes`` (cells a
    table) and ``fine`` are set from the data unless given. A query whose probed cells hold fewer than ``k`` others gets fewer.

    Rows with a null id or vector, a zero vector, or a component that is null or not finite, take no part. Equal rows count
    once; different vectors of one id are one query, which takes the best score of a row, and whose own rows may take places
    of others. Vectors of different lengths (dimensions) are not compared. An empty
    table gives no rows. Other columns are not read.
    """
    rows = stored(_vectors(table, key, vector))
    of = rows.groupBy("dims", "v").agg(F.min("vec_id").alias("first_id"), F.first("length").alias("length"))
    classes = stored(of.withColumn("class", F.monotonically_increasing_id()))
    rows = stored(rows.join(classes.select("dims", "v", "class"), ["dims", "v"]).select("dims", "class", "vec_id"))
    asked = rows.filter(is_query)
    kinds = classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("least"), F.max("length").alias("most")).orderBy("dims").collect()

    found = None
    for kind in kinds:  # one for each width of vectors
        dims, longest = kind["dims"], kind["most"]
        lifted = kind["least"] < (1 - 1e-6) * longest
        width = _cell_count(dims + lifted, 0)
        axes = fine if fine is not None else min(width // 2, kind["n"] // (2 * CELL * width))
        mine = classes.filter(F.col("dims") == dims)
        queries = mine.join(asked.filter(F.col("dims") == dims).select("class").distinct(), "class", "left_semi")
        every = _cell_count(dims + lifted, axes) if kind["n"] <= k + 1 else None  # with no more vectors than are asked for, all are met
        visits = probes or every or fit_probes(mine, queries, dims, longest, lifted, axes, k, tables, sample, target)
        index = stored(_hashed(mine, dims, longest, lifted, axes, tables, None))
        lists = _visited(index, _hashed(queries, dims, longest, lifted, axes, tables, visits), dims, k + 1, piece)
        found = lists if found is None else found.unionByName(lists)
    if found is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))

    pairs = found.groupBy("query", "class", "first_id").agg(F.max("score").alias("score"))  # a pair may be met in several tables
    order = [F.desc("score"), "first_id"]
    part = F.row_number().over(Window.partitionBy("query", F.pmod(F.xxhash64("class"), F.lit(16))).orderBy(*order))
    cut = pairs.withColumn("n", part).filter(F.col("n") <= k + 1)
    best = cut.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("n") <= k + 1)
    listed = best.join(_first_ids(rows, k + 1), "class").select("query", "class", "vec_id", "score")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= k + 1)
    named = asked.select(F.col("class").alias("query"), F.col("vec_id").alias("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    met = listed.join(named, "query").filter("vec_id <> query_id").groupBy("query_id", "class", "vec_id").agg(F.max("score").alias("score"))
    return met.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
