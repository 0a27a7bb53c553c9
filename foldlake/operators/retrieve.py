"""Exact cosine top-k with a same-group filter.

Vectors of both tables are scaled once and cut into compact blocks of some thousand: each goes to the nearest of a few
centres, and what falls to one centre is dealt into pieces. A block is one row: keys, groups, one matrix, its centre and its
radius. A query block first meets the index block whose centre is nearest; the lowest k-th similarity found for its queries
is its cutoff. By the triangle inequality two blocks hold no similarity above

    centre . centre + |centre| * radius + |centre| * radius + radius * radius

so a pair of blocks below the cutoff is skipped, whole. The others meet leaf by leaf: a leaf is some index vectors of a block
that lie close together, in a box along the block's principal axes, and a query skips the leaves whose box is farther away than
its own k-th similarity found so far allows. What is left are matrix products, of which the best ``k`` per query leave the task,
to be merged in two steps. Results are exact; how much is skipped depends on how the vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TOP_K
from ..functions.vectors import array_dot
from ..session import stored

#: Vectors in a block, for queries and index alike, and centres they are dealt to.
BLOCK, CENTRES = 8192, 64
_HITS = "q bigint, query_key string, tpl_key string, sim double, same_group boolean"
_BLOCKS = "block bigint, n int, keys array<string>, groups array<string>, matrix binary, centre array<double>, radius double"
#: Room for rounding in bounds and cutoffs.
_SLACK = 1e-7


class Blocks(NamedTuple):
    table: DataFrame
    count: int


def _unit(lists: pa.Array) -> np.ndarray:
    """Rows of an array column, scaled to unit length."""
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-8)


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def scaled(vectors: DataFrame) -> DataFrame:
    """chain_key, pdb_id, unit (bytes of doubles), stored once; vectors of one table have one width, null ones take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = [row.tobytes() for row in _unit(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit, pa.binary())], names=["chain_key", "pdb_id", "unit"])

    return stored(vectors.filter(F.col("emb").isNotNull()).select("chain_key", "pdb_id", "emb").mapInArrow(run, "chain_key string, pdb_id string, unit binary"))


def blocks(units: DataFrame, size: int = BLOCK, centres: int = CENTRES) -> Blocks:
    """Compact blocks of the rows of ``units`` and how many there are, a row each; up to ``centres`` vectors reach the driver."""
    wanted = -(-units.count() // size)
    if wanted > 1:
        nearest = _matrix([r["unit"] for r in units.select("unit").orderBy(F.xxhash64("chain_key"), "chain_key").take(min(centres, wanted))])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    best = (_matrix(batch.column(2).to_pylist()) @ nearest.T).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int64())], names=[*batch.schema.names, "centre"])

        dealt = stored(units.mapInArrow(assign, "chain_key string, pdb_id string, unit binary, centre bigint"))
        pieces = dealt.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / size).alias("pieces"))
        piece = F.pmod(F.xxhash64("chain_key"), F.col("pieces"))
        placed = dealt.join(pieces, "centre").select("chain_key", "pdb_id", "unit", (F.col("centre") * (1 << 32) + piece).alias("block"))
    else:
        placed = units.withColumn("block", F.lit(0).cast("bigint"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces_of():
            for batch in batches:
                number = batch.column(3).to_numpy()
                cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        yield int(number[a]), batch.slice(a, b - a)

        for block, found in groupby(pieces_of(), lambda p: p[0]):
            rows = pa.Table.from_batches([piece for _, piece in found])
            matrix = _matrix(rows["unit"].to_pylist())
            centre = matrix.mean(axis=0)
            radius = float(np.linalg.norm(matrix - centre, axis=1).max())
            yield pa.RecordBatch.from_pylist([{
                "block": block, "n": len(matrix), "keys": rows["chain_key"].to_pylist(), "groups": rows["pdb_id"].to_pylist(),
                "matrix": matrix.tobytes(), "centre": centre.tolist(), "radius": radius}], schema=_ARROW)

    # By key inside a block, so that places stand for keys where similarities are equal.
    ordered = placed.repartition("block").sortWithinPartitions("block", "chain_key")
    made = stored(ordered.mapInArrow(gather, _BLOCKS))
    return Blocks(made, wanted if wanted <= 1 else made.count())


_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.string())), ("groups", pa.list_(pa.string())), ("matrix", pa.binary()),
                    ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])


def block_pairs(queries: Blocks, index: Blocks) -> DataFrame:
    """q, t, n (queries), near (similarity of the centres), bound (on all similarities): every pair of a query and an index block."""
    def side(of: Blocks, name: str) -> DataFrame:
        length = F.sqrt(array_dot(F.col("centre"), F.col("centre")))
        return of.table.select(F.col("block").alias(name), F.col("n").alias(f"n_{name}"), F.col("centre").alias(f"c_{name}"),
                               F.col("radius").alias(f"r_{name}"), length.alias(f"l_{name}"))

    known = index.table.agg(F.collect_list("block"))  # a number per block
    met = side(queries, "q").select("*", F.explode(known.scalar()).alias("t")).join(side(index, "t"), "t")
    near = array_dot(F.col("c_q"), F.col("c_t"))
    reach = near + F.col("l_q") * F.col("r_t") + F.col("l_t") * F.col("r_q") + F.col("r_q") * F.col("r_t")
    return met.select("q", "t", F.col("n_q").alias("n"), near.alias("near"), (reach + _SLACK).alias("bound"))


def _dense_best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best ``k`` of every row, columns in key order; looks at all of them."""
    score = np.round(sims, 9) - np.arange(sims.shape[1]) * (4e-10 / sims.shape[1])
    width = min(k, sims.shape[1])
    cols = np.argpartition(-score, width - 1, axis=1)[:, :width].ravel()
    return np.repeat(np.arange(len(sims)), width), cols


def _row_best(sims: np.ndarray, floor: np.ndarray, k: int, many: int = 32, peaks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and similarities (nine decimals) of the best ``k`` of every row that are not below its ``floor``.

    Of equal similarities the first columns, which are in key order. The ``k``-th largest of the maxima of some runs of
    columns is a lower bound of a row's ``k``-th similarity, so that only the few above it are ranked; without ``peaks`` the
    ``floor`` alone is. Where more than ``many`` per row reach it, as with copies, all are.
    """
    n, width = sims.shape
    runs = 16 * k
    if peaks and width >= 4 * runs:
        whole = width // runs * runs
        highest = sims[:, :whole].reshape(n, runs, -1).max(axis=2)
        floor = np.maximum(floor, np.partition(highest, runs - k, axis=1)[:, runs - k])
    reached = sims >= (floor - _SLACK)[:, None]
    if np.count_nonzero(reached) > many * n:
        rows, cols = _dense_best(sims, k)
        kept = reached[rows, cols]
        rows, cols = rows[kept], cols[kept]
    else:
        rows, cols = np.divmod(np.flatnonzero(reached), width)  # faster than nonzero on two axes
    found = np.round(sims[rows, cols], 9)
    kept = np.isfinite(found)
    rows, cols, found = rows[kept], cols[kept], found[kept]
    return _first(rows, cols, found, k)


def _first(rows: np.ndarray, cols: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of every row by similarity, then column."""
    order = np.lexsort((cols, -found, rows))
    rows, cols, found = rows[order], cols[order], found[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k], found[place < k]


#: Vectors in a leaf at most, and principal axes its box is measured on.
LEAF, AXES = 256, 8


class _Leaves:
    """An index block cut into leaves at medians along its principal axes, each with its box on them."""

    def __init__(self, matrix: np.ndarray, size: int = LEAF, axes: int = AXES):
        moved = matrix - matrix.mean(axis=0)
        self.axes = np.linalg.eigh(moved.T @ moved)[1][:, -axes:]
        near = matrix @ self.axes
        self.places, todo = [], [np.arange(len(matrix))]
        while todo:
            part = todo.pop()
            if len(part) <= size:
                self.places.append(np.sort(part))  # in key order
                continue
            inside, half = near[part], len(part) // 2
            order = part[np.argpartition(inside[:, inside.var(axis=0).argmax()], half)]
            todo += [order[:half], order[half:]]
        self.vectors = [matrix[places] for places in self.places]
        self.low = np.array([near[places].min(axis=0) for places in self.places])
        self.high = np.array([near[places].max(axis=0) for places in self.places])

    def reach(self, queries: np.ndarray, floor: np.ndarray, step: int = 1024) -> np.ndarray:
        """Leaves by queries: whether a vector of the leaf may have a similarity of ``floor`` to the query.

        Vectors are no longer than 1, so a similarity is at most 1 - distance^2 / 2, and the distance at least that to the box.
        """
        allowed = 2 - 2 * floor + 4 * _SLACK
        reached = np.empty((len(self.places), len(queries)), dtype=bool)
        for first in range(0, len(queries), step):
            part = slice(first, first + step)
            near = (queries[part] @ self.axes).T
            gap = np.zeros((len(self.places), near.shape[1]))
            for low, high, at in zip(self.low.T, self.high.T, near):
                off = np.maximum(low[:, None] - at, at - high[:, None])
                np.maximum(off, 0, out=off)
                off *= off
                gap += off
            reached[:, part] = gap <= allowed[part]
        return reached


class _Side:
    """A block inside a task: keys and group numbers, and the matrix."""

    def __init__(self, block: int, keys: pa.Array, groups: np.ndarray, matrix: np.ndarray):
        self.block, self.keys, self.groups, self.matrix = block, keys, groups, matrix
        self.whole = bool(np.isfinite(matrix).all())

    @cached_property
    def leaves(self) -> _Leaves:
        return _Leaves(self.matrix)


class _Asked:
    """A query block inside a task, with the best of the index blocks it has met."""

    def __init__(self, side: _Side, partners: list[int], floor: np.ndarray, k: int):
        self.side, self.partners, self.k = side, set(partners), k
        self.best = np.repeat(floor[:, None], k, axis=1)  # similarities so far, the lowest first
        self.found: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]] = []

    def meet(self, other: _Side, exclude: bool, cells: int = 1 << 19) -> None:
        exclude = exclude and bool(np.isin(self.side.groups, other.groups).any())
        if self.side.whole and other.whole and len(other.matrix) > LEAF and np.isfinite(self.best[:, 0]).mean() > 0.5:
            reached = other.leaves.reach(self.side.matrix, self.best[:, 0])
            if np.count_nonzero(reached) < 0.5 * reached.size:
                self._meet_leaves(other, reached, exclude)
                return
        step = max(64, cells // max(1, len(other.matrix)))
        for first in range(0, len(self.best), step):
            part = slice(first, first + step)
            sims = self._similar(self.side.matrix[part], self.side.groups[part], other.matrix, other.groups, exclude)
            if not (self.side.whole and other.whole):
                sims[np.isnan(sims)] = -np.inf
            rows, cols, found = _row_best(sims, self.best[part, 0], self.k)
            self._take(rows + first, cols, found, other)

    def _meet_leaves(self, other: _Side, reached: np.ndarray, exclude: bool) -> None:
        """Each leaf with the queries that may find something in it."""
        floor, lists = self.best[:, 0].copy(), []
        for places, vectors, some in zip(other.leaves.places, other.leaves.vectors, reached):
            asked = np.flatnonzero(some)
            if len(asked):
                sims = self._similar(self.side.matrix[asked], self.side.groups[asked], vectors, other.groups[places], exclude)
                rows, cols, found = _row_best(sims, floor[asked], self.k, peaks=False)
                lists.append((asked[rows], places[cols], found))
        if lists:
            self._take(*_first(*(np.concatenate(part) for part in zip(*lists)), self.k), other)

    @staticmethod
    def _similar(queries: np.ndarray, asked: np.ndarray, vectors: np.ndarray, groups: np.ndarray, exclude: bool) -> np.ndarray:
        sims = queries @ vectors.T
        for group in np.intersect1d(asked, groups) if exclude else ():
            sims[np.ix_(asked == group, groups == group)] = -np.inf
        return sims

    def _take(self, rows: np.ndarray, cols: np.ndarray, found: np.ndarray, other: _Side) -> None:
        """At most ``k`` of each query, by query and falling similarity."""
        if not len(rows):
            return
        here, place = np.unique(rows), np.arange(len(rows)) - np.searchsorted(rows, rows)
        new = np.full((len(here), self.k), -np.inf)
        new[np.searchsorted(here, rows), place] = found
        self.best[here] = np.sort(np.hstack([self.best[here], new]), axis=1)[:, -self.k:]
        self.found.append((rows, other.keys.take(pa.array(cols)), found, self.side.groups[rows] == other.groups[cols]))

    def hits(self) -> Iterator[pa.RecordBatch]:
        """What is not below the ``k``-th best of its query."""
        for rows, keys, found, same in self.found:
            kept = np.flatnonzero(found >= self.best[rows, 0])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(kept), self.side.block)), self.side.keys.take(pa.array(rows[kept])), keys.take(pa.array(kept)),
                pa.array(found[kept]), pa.array(same[kept])], names=["q", "query_key", "tpl_key", "sim", "same_group"])


#: Query blocks and index blocks that meet in one task; the first are held, the others come one by one.
HELD, PASSING = 8, 16


def _compare(pairs: DataFrame, queries: Blocks, index: Blocks, k: int, exclude: bool, floors: DataFrame | None = None) -> DataFrame:
    """Hits of the given pairs of blocks (q, t); only those that are not below the query's floor, where ``floors`` (see ``_floors``) has one.

    Pairs are dealt out in cells of a grid, some query blocks by some index blocks, a task each: a block is sent once per
    cell and not once per pair, and a query leaves a cell with its best ``k`` of all index blocks there.
    """
    tasks = 2 * pairs.sparkSession.sparkContext.defaultParallelism
    down = max(1, -(-queries.count // HELD))
    across = max(1, -(-index.count // PASSING))
    if down * across < tasks:  # few blocks: smaller cells, so that all cores have some
        down, across = min(max(1, queries.count), max(down, -(-tasks // across))), across
        across = min(max(1, index.count), max(across, -(-tasks // down)))

    def lot(of: Blocks, name: str, count: int) -> DataFrame:
        """Each block's row or column of the grid, as many blocks in each; a number per block is ordered."""
        place = F.row_number().over(Window.orderBy("block")) - 1
        return of.table.select("block").select(F.col("block").alias(name), (place % count).alias(f"{name}_lot"))

    cells = pairs.select("q", "t").join(lot(queries, "q", down), "q").join(lot(index, "t", across), "t").select(
        "q", "t", (F.col("q_lot") * across + F.col("t_lot")).cast("int").alias("cell"))
    names = ["keys", "groups", "matrix"]
    known = F.lit(None).cast(_FLOORS).alias("floors")
    source = queries.table.select("block", *names, *([known] if floors is None else []))
    if floors is not None:
        source = source.join(floors.withColumnRenamed("q", "block").hint("merge"), "block", "left")
    held = cells.groupBy("cell", "q").agg(F.collect_list("t").alias("partners")).withColumnRenamed("q", "block").join(source, "block").select(
        "cell", F.lit(0).alias("side"), "block", "partners", *names, "floors")
    passing = cells.select("cell", F.col("t").alias("block")).distinct().join(index.table.select("block", *names), "block").select(
        "cell", F.lit(1).alias("side"), "block", F.array().cast("array<bigint>").alias("partners"), *names, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str | None, int] = {}
        here, asked = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                cell, side, block = (batch.column(c)[r].as_py() for c in range(3))
                if cell != here:
                    for one in asked:
                        yield from one.hits()
                    here, asked = cell, []
                groups = batch.column(5)[r].values.dictionary_encode()
                own = np.array([numbers.setdefault(g, len(numbers)) for g in groups.dictionary.to_pylist()] + [numbers.setdefault(None, len(numbers))])
                matrix = np.frombuffer(batch.column(6)[r].as_buffer(), dtype=np.float64).reshape(len(groups), -1)
                met = _Side(block, batch.column(4)[r].values, own[groups.indices.fill_null(len(own) - 1).to_numpy()], matrix)
                if side == 0:
                    asked.append(_Asked(met, batch.column(3)[r].as_py(), _floor_of(met.keys, batch.column(7)[r].values), k))
                else:
                    for one in asked:
                        if block in one.partners:
                            one.meet(met, exclude)
        for one in asked:
            yield from one.hits()

    dealt = held.unionByName(passing).repartitionById(down * across, "cell").sortWithinPartitions("cell", "side", "block")
    return dealt.mapInArrow(run, _HITS)


def _cutoffs(pairs: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """q, cutoff: the lowest k-th similarity of the block's queries so far; -2 where a query has fewer than ``k`` hits."""
    each = hits.groupBy("q", "query_key").agg(F.count(F.lit(1)).alias("found"), F.min("sim").alias("least"))
    full = each.groupBy("q").agg(F.count_if(F.col("found") >= k).alias("full"), F.min("least").alias("least"))
    sizes = pairs.groupBy("q").agg(F.max("n").alias("n"))
    return sizes.join(full, "q", "left").select("q", F.when(F.col("full") == F.col("n"), F.col("least") - _SLACK).otherwise(F.lit(-2.0)).alias("cutoff"))


_FLOORS = "array<struct<key:string,floor:double>>"


def _floors(hits: DataFrame, k: int) -> DataFrame:
    """q, floors: the keys of a query block that have ``k`` hits, with the lowest similarity among them."""
    each = hits.groupBy("q", F.col("query_key").alias("key")).agg(F.count(F.lit(1)).alias("found"), F.min("sim").alias("floor"))
    return each.filter(F.col("found") >= k).groupBy("q").agg(F.collect_list(F.struct("key", "floor")).alias("floors"))


def _floor_of(keys: pa.Array, floors: pa.StructArray | None) -> np.ndarray:
    """The floor of each key, -infinity where it has none."""
    if floors is None:
        return np.full(len(keys), -np.inf)
    place = pc.index_in(keys, value_set=floors.field("key"))
    return floors.field("floor").take(place).fill_null(-np.inf).to_numpy(zero_copy_only=False)


def search_plan(queries: Blocks, index: Blocks, k: int, exclude: bool) -> tuple[DataFrame, DataFrame]:
    """(hits of the nearest blocks, all pairs of blocks with their bound, cutoff, and whether they are ``compared``)."""
    pairs = stored(block_pairs(queries, index))
    nearest = pairs.groupBy("q").agg(F.max_by("t", F.struct("near", F.col("t"))).alias("t"))
    hits = stored(_compare(nearest, queries, index, k, exclude))
    marked = pairs.join(nearest.withColumnRenamed("t", "first"), "q").join(_cutoffs(pairs, hits, k), "q")
    begun = F.col("t") == F.col("first")
    return hits, marked.select("q", "t", "bound", "cutoff", begun.alias("first"), (begun | (F.col("bound") >= F.col("cutoff"))).alias("compared"))


def _merge(partial: DataFrame, k: int, pieces: int = 64) -> DataFrame:
    """Best ``k`` of the lists: over pieces of the index first, so that no query's lists meet all at once."""
    order = [F.desc("sim"), F.col("tpl_key")]
    cut = partial.withColumn("__piece", F.pmod(F.xxhash64("tpl_key"), F.lit(pieces)))
    first = Window.partitionBy("query_key", "__piece").orderBy(*order)
    kept = cut.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).drop("rank", "__piece")
    best = Window.partitionBy("query_key").orderBy(*order)
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def topk_similar(queries: DataFrame, index: DataFrame, k: int = TOP_K, exclude_same_group: bool = True, block: int = BLOCK) -> DataFrame:
    """The ``k`` most similar index chains of each query: query_key, tpl_key, sim, rank, same_group.

    With the filter on, members of the query's own group are left out before ranking, so a query gets ``k`` hits
    whenever that many other chains exist. Both tables are computed once and stored before they are cut into blocks;
    one table given twice is stored once.
    """
    known = blocks(scaled(index), block)
    asked = known if queries is index else blocks(scaled(queries), block)
    if known.count <= 1:  # every query block has one partner
        found = _compare(asked.table.select(F.col("block").alias("q"), F.lit(0).cast("bigint").alias("t")), asked, known, k, exclude_same_group)
    else:
        hits, plan = search_plan(asked, known, k, exclude_same_group)
        found = hits.unionByName(_compare(plan.filter("compared and not first"), asked, known, k, exclude_same_group, _floors(hits, k)))
    return _merge(found, k).select("query_key", "tpl_key", "sim", "rank", "same_group")


def hit_weights(hits: DataFrame) -> DataFrame:
    """Softmax of the similarities of a query's hits (at most k rows per query)."""
    query = Window.partitionBy("query_key")
    raised = hits.withColumn("__e", F.exp(F.col("sim") - F.max("sim").over(query)))
    return raised.withColumn("weight", F.col("__e") / (F.sum("__e").over(query) + 1e-8)).drop("__e")
