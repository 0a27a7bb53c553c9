"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are cut into slices. A slice of all vectors, for one query, is a list of local scores, and the
score of a vector is the sum of its local scores. Vectors lie in blocks of rows, queries too, and every query block
meets every index block once a phase; between phases only a few numbers per query travel. Blocks meet in cells of a grid,
some query blocks by some index blocks, a task each: a block is sent once per cell, and none is broadcast.

1. Each block gives, for each slice, the entries with the highest local scores, and resolves these few exactly. The
   k-th best of them over all blocks is a score that the k-th result cannot fall below: the safe cutoff.
2. The cutoffs go back with the query blocks. An entry can reach a cutoff c only if one of its local scores is at least
   c / slices, so each block collects the entries that do in some slice. Slices are formed one by one, and entries whose
   later components (Cauchy-Schwarz) cannot make up what is missing are dropped on the way.
3. What is left is resolved exactly, its later slices alone. Each block keeps its best k per query among those at or above
   the cutoff, merged within a cell; the lists of the cells are merged in two steps, first over groups of entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

SCALE = 256
SLICES = 4
#: Vectors in a block of the index and of the queries.
BLOCK = 8192
#: Query blocks and index blocks that meet in one task; the first are held, the others come one by one.
HELD, PASSING = 8, 16
#: Share of a block's pairs from which the next slice is formed for the others no more.
SPARSE = 0.2
_HIT = "query_id bigint, vec_id bigint, score bigint"
_CUTOFFS = "array<struct<query_id:bigint,cutoff:bigint>>"


def scaled(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, for rows with an id and a vector of finite numbers only."""
    x = F.col(vector).cast("array<double>")
    whole = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(whole).select(F.col(key).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """dims, ``name`` (block number) and the block's ids and components, a row per block of about ``size`` vectors."""
    count = max(1, -(-rows.count() // size))
    number = F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")
    blocks = rows.groupBy(F.size("v").alias("dims"), number.alias(name)).agg(F.collect_list(F.struct("vec_id", "v")).alias(f"{name}_rows"))
    return stored(blocks), count


def _cells(queries: DataFrame, query_blocks: int, index: DataFrame, index_blocks: int) -> DataFrame:
    """cell, side (0 query, 1 index), dims, block, rows, cutoffs: each query block meets each index block in one cell.

    A cell is a partition, its query blocks first. Cells are smaller where blocks are few, so that all cores have some.
    """
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    across = max(1, -(-index_blocks // PASSING))
    down = min(query_blocks, max(-(-query_blocks // HELD), -(-tasks // across)))
    across = min(index_blocks, max(across, -(-tasks // down)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = queries.select("*", each(across).alias("at")).select(
        (F.col("q") % down * across + F.col("at")).alias("cell"), F.lit(0).alias("side"), "dims", F.col("q").alias("block"), F.col("q_rows").alias("rows"), "cutoffs")
    passing = index.select("*", each(down).alias("at")).select(
        (F.col("at") * across + F.col("x") % across).alias("cell"), F.lit(1).alias("side"), "dims", F.col("x").alias("block"), F.col("x_rows").alias("rows"),
        F.lit(None).cast(_CUTOFFS).alias("cutoffs"))
    return held.unionByName(passing).repartitionById(down * across, "cell").sortWithinPartitions("cell", "side", "dims", "block")


def _matrix(rows: pa.StructArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.field("vec_id").to_numpy(zero_copy_only=False)
    flat = rows.field("v").flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), dims)


class _Scores:
    """Local scores of a query block against an index block, exact, slice by slice.

    Products are summed in doubles while every sum stays below 2^53, else in 64-bit integers, else in Python's. Bounds are
    doubles with room for their rounding, whatever the scores are.
    """

    def __init__(self, queries: np.ndarray, index: np.ndarray, slices: int):
        most = (np.abs(queries.astype(float)).max(initial=0) + 1) * (np.abs(index.astype(float)).max(initial=0) + 1) * max(1, queries.shape[1])
        kind = np.float64 if most < 2 ** 53 else np.int64 if most < 2 ** 63 else object
        self.queries, self.index = queries.astype(kind), index.astype(kind)
        self.parts = [p for p in np.array_split(np.arange(queries.shape[1]), slices) if len(p)] or [np.arange(0)]
        self.q_rest, self.x_rest = self._rest(queries), self._rest(index)

    def _rest(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Lengths of what lies in the slices after each."""
        squares = [(vectors[:, p].astype(float) ** 2).sum(axis=1) for p in self.parts]
        return [np.sqrt(sum(squares[k + 1:], np.zeros(len(vectors)))) for k in range(len(squares))]

    def local(self, rows: slice, part: int) -> np.ndarray:
        """Local scores of all pairs in one slice."""
        p = self.parts[part]
        return self.queries[rows][:, p] @ self.index[:, p].T

    def local_of(self, rows: slice, part: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same for some pairs only."""
        p, q = self.parts[part], self.queries[rows]
        steps = range(0, len(i), 1 << 16)
        return np.concatenate([np.empty(0, q.dtype), *((q[i[a:a + (1 << 16)]][:, p] * self.index[j[a:a + (1 << 16)]][:, p]).sum(axis=1) for a in steps)])


def _collect(scores: _Scores, rows: slice, cut: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query, entry and exact score of the pairs that reach their cutoff, and how many local scores were formed.

    Slices are formed one by one. A pair goes on while its score so far and the lengths of what is left (Cauchy-Schwarz)
    can make up the cutoff; once few do, only theirs are formed. It counts if some local score reached the uniform threshold.
    """
    wanted = cut.astype(float)
    room = 1 + 1e-9 * np.abs(wanted)
    slices = len(scores.parts)
    alive, total, lists, formed = ~own, None, [], 0
    for part in range(slices):
        if part and np.count_nonzero(alive) < SPARSE * alive.size:
            break
        lists.append(scores.local(rows, part))
        formed += alive.size
        total = lists[0] if total is None else total + lists[-1]
        missing = (wanted - room)[:, None] - total.astype(float, copy=False)
        alive &= scores.q_rest[part][rows, None] * scores.x_rest[part] * (1 + 1e-9) >= missing
    i, j = np.nonzero(alive)
    whole, most = total[i, j], reduce(np.maximum, [local[i, j] for local in lists])
    for part in range(len(lists), slices):
        local = scores.local_of(rows, part, i, j)
        formed += len(local)
        whole, most = whole + local, np.maximum(most, local)
        keep = whole.astype(float) + scores.q_rest[part][rows][i] * scores.x_rest[part][j] * (1 + 1e-9) >= wanted[i] - room[i]
        i, j, whole, most = i[keep], j[keep], whole[keep], most[keep]
    met = most.astype(float) * slices >= wanted[i] - room[i] * slices
    whole = _clip(whole)
    keep = met & (whole >= cut[i])
    return i[keep], j[keep], whole[keep], formed


def _clip(score: np.ndarray) -> np.ndarray:
    """Scores as bigint; beyond its range they take its ends."""
    if score.dtype == object:
        return np.array([max(-2 ** 63, min(2 ** 63 - 1, int(s))) for s in score], dtype=np.int64)
    return score.astype(np.int64)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best entries of each query: score descending, then id."""
    order = np.lexsort((ids, ~score, q))
    start = np.concatenate([[True], q[order][1:] != q[order][:-1]])
    first = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


class _Asked:
    """A query block inside a task, with the best of the index blocks it has met."""

    def __init__(self, dims: int, ids: np.ndarray, vectors: np.ndarray, cut: np.ndarray | None, k: int, slices: int, step: int):
        self.dims, self.ids, self.vectors, self.cut, self.k, self.slices, self.step = dims, ids, vectors, cut, k, slices, step
        self.best = tuple(np.empty(0, np.int64) for _ in range(3))  # place of the query, vec_id, score

    def meet(self, x_ids: np.ndarray, vectors: np.ndarray) -> None:
        """Takes in the entries of an index block: of phase 1, or of phases 2 and 3 where there are cutoffs."""
        scores = _Scores(self.vectors, vectors, self.slices)
        lists = [self.best]
        for first in range(0, len(self.ids), self.step):
            rows = slice(first, first + self.step)
            own = self.ids[rows, None] == x_ids[None, :]
            if self.cut is not None:
                i, j, found, _ = _collect(scores, rows, self.cut[rows], own)
            else:
                i, j, found = _leading(scores, rows, own, self.k)
            keep = _best(i, x_ids[j], found, self.k) if len(i) else i
            lists.append((i[keep] + first, x_ids[j[keep]], found[keep]))
        q, ids, found = (np.concatenate(part) for part in zip(*lists))
        keep = _best(q, ids, found, self.k) if len(q) else q
        self.best = q[keep], ids[keep], found[keep]

    def hits(self) -> Iterator[pa.RecordBatch]:
        q, ids, found = self.best
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(ids), pa.array(found)], names=["query_id", "vec_id", "score"])


def _leading(scores: _Scores, rows: slice, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, entry and exact score of the pairs with the highest local scores of each slice."""
    asked, lists = np.zeros(own.shape, dtype=bool), [scores.local(rows, p) for p in range(len(scores.parts))]
    for part in lists:
        top = np.argpartition(-part, min(k, part.shape[1] - 1), axis=1)[:, :k + 1]  # one may be its own
        np.put_along_axis(asked, top, True, axis=1)
    i, j = np.nonzero(asked & ~own)
    return i, j, _clip(reduce(np.add, [part[i, j] for part in lists]))


def _meet(cells: DataFrame, k: int, slices: int, step: int, final: bool) -> DataFrame:
    """The best entries of each query block in each cell: of phase 1, or of phases 2 and 3 if ``final``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asked = None, []
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for r in range(batch.num_rows):
                cell, dims = columns["cell"][r].as_py(), columns["dims"][r].as_py()
                if cell != here:
                    for one in asked:
                        yield from one.hits()
                    here, asked = cell, []
                ids, vectors = _matrix(columns["rows"][r].values, dims)
                if columns["side"][r].as_py():
                    for one in asked:
                        if one.dims == dims:
                            one.meet(ids, vectors)
                    continue
                cut = None
                if final:
                    table = columns["cutoffs"][r].values
                    known = dict(zip(table.field("query_id").to_pylist(), table.field("cutoff").to_pylist())) if table is not None else {}
                    cut = np.array([known.get(i) if known.get(i) is not None else -2 ** 63 for i in ids.tolist()], dtype=np.int64)
                asked.append(_Asked(dims, ids, vectors, cut, k, slices, step))
        for one in asked:
            yield from one.hits()

    return cells.mapInArrow(run, _HIT)


def _merge(hits: DataFrame, k: int, groups: int = 64) -> DataFrame:
    """Ranks 1 to ``k`` per query. Lists are cut to ``k`` over groups of entries first."""
    order = [F.desc("score"), "vec_id"]
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    part = hits.withColumn("__g", group)
    first = Window.partitionBy("query_id", "__g").orderBy(*order)
    cut = part.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    last = Window.partitionBy("query_id").orderBy(*order)
    return cut.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: str, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
          slices: int = SLICES, block: int = BLOCK, step: int = 128) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest integer inner products of every query row.

    ``is_query`` is the condition on ``vec_id`` that query rows meet. Vectors with one id are one query, if they differ.
    Candidates are all rows but those with the query's own id; equal scores go to the smaller id, and all candidates
    are listed where there are fewer than ``k``. Rows with a null id or vector, or a component that is null or not
    finite, take no part. Vectors of different lengths are not compared. Equal rows of
    one id count once. An empty table gives no rows. Other columns are not read.
    """
    rows = stored(scaled(vectors, key, vector, scale).distinct())
    index, index_blocks = _blocks(rows, block, "x")
    queries, query_blocks = _blocks(rows.filter(is_query), block, "q")

    unbound = queries.withColumn("cutoffs", F.lit(None).cast(_CUTOFFS))
    first = _meet(_cells(unbound, query_blocks, index, index_blocks), k, slices, step, final=False)
    cutoffs = stored(_merge(first, k).groupBy("query_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).select(
        "query_id", F.when(F.col("n") >= k, F.col("score")).alias("cutoff")))

    # Merged by sorting: a broadcast would take what grows with the queries through the driver.
    ids = queries.select("dims", "q", F.explode("q_rows.vec_id").alias("query_id")).distinct()
    sent = ids.join(cutoffs.hint("merge"), "query_id").groupBy("dims", "q").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("cutoffs"))
    bounded = stored(queries.join(sent.hint("merge"), ["dims", "q"], "left"))
    hits = _meet(_cells(bounded, query_blocks, index, index_blocks), k, slices, step, final=True)
    return _merge(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
