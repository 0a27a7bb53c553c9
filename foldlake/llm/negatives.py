"""Hard negatives by recursive tile products and mergeable heaps.

Anchors and candidates lie in blocks. A pair of blocks is a tile of scores, made by Strassen's recursion: a tile is padded
with zeros to even sides, cut into quadrants, and seven products of sums of quadrants give all four of the result. All of
it is 64-bit integer arithmetic, which is exact wherever the scores fit: sums that wrap around on the way wrap back.

1. Blocks of one label meet. Each tile leaves the best candidates of each anchor; merged, these are its positives.
2. Anchors carry their positives to blocks of all labels. Each tile leaves, for each positive, the best candidates of other
   labels whose score lies in the positive's window. These lists are merged the same way.

A list of a tile holds at most as many entries as the result, and the best of two lists are the list of both, so lists are
merged in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

SCALE = 256
#: Rows in a block, anchors multiplied at a time, and the side from which a tile is cut further.
BLOCK, STEP, LEAF = 8192, 512, 32
#: Scores beyond a bigint take its ends; the lowest one marks entries that take no part.
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_LIST = "anchor bigint, slot int, id bigint, score bigint"


# ---------------------------------------------------------------- tiles

def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two integer matrices; a matrix with a side of at most ``leaf`` is multiplied directly."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    a, b = _even(a), _even(b)
    r, i, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :i], a[:r, i:], a[r:, :i], a[r:, i:]
    b11, b12, b21, b22 = b[:i, :c], b[:i, c:], b[i:, :c], b[i:, c:]
    out = np.empty((2 * r, 2 * c), dtype=a.dtype)
    top, right, left, bottom = out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    top[:], bottom[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    left[:] = p
    bottom -= p
    p = strassen(a11, b12 - b22, leaf)
    right[:] = p
    bottom += p
    p = strassen(a22, b21 - b11, leaf)
    top += p
    left += p
    p = strassen(a11 + a12, b22, leaf)
    top -= p
    right += p
    bottom += strassen(a21 - a11, b11 + b12, leaf)
    top += strassen(a12 - a22, b21 + b22, leaf)
    return out[:rows, :columns]


def _even(m: np.ndarray) -> np.ndarray:
    """``m`` with a row or column of zeros where their number is odd."""
    rows, columns = m.shape
    if rows % 2 == columns % 2 == 0:
        return m
    out = np.zeros((rows + rows % 2, columns + columns % 2), dtype=m.dtype)
    out[:rows, :columns] = m
    return out


def scores(anchors: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Inner products of int64 rows as int64. Products that may leave the range are made of Python's integers and clipped."""
    if (_top(anchors) + 1) * (_top(rows) + 1) * max(1, rows.shape[1]) < 1 << 63:
        return strassen(anchors, rows.T, leaf)
    whole = strassen(anchors.astype(object), rows.astype(object).T, leaf)
    return np.clip(whole, _LEAST, _MOST).astype(np.int64)


def _top(values: np.ndarray) -> int:
    """The largest absolute value, as a Python integer."""
    return max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))


class _Block:
    """Rows of a block by rising id: row numbers, ids, labels, vectors, and the windows of anchors that have some."""

    def __init__(self, rows: pa.StructArray, dims: int):
        order = np.lexsort((rows.field("row").to_numpy(), rows.field("vec_id").to_numpy()))
        self.row, self.ids, self.labels = (rows.field(n).to_numpy()[order] for n in ("row", "vec_id", "label"))
        self.v = rows.field("v").flatten().to_numpy().reshape(len(order), dims)[order]
        self.windows = rows.field("windows").take(pa.array(order)).to_pylist() if "windows" in rows.type.names else [None] * len(order)


# ---------------------------------------------------------------- blocks

def _blocks(rows: DataFrame, by: list[str], name: str, size: int) -> DataFrame:
    """``by``, ``name`` (number of the block), its rows, and how many blocks of ``by`` there are."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{name}_count"))
    number = F.pmod(F.xxhash64("row", F.lit(3)), F.col(f"{name}_count")).cast("int").alias(name)
    members = [c for c in rows.columns if c != "dims"]
    return rows.join(counts, by).groupBy(*by, f"{name}_count", number).agg(F.collect_list(F.struct(*members)).alias(f"{name}_rows"))


def _tiles(anchors: DataFrame, rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """A row for each pair of an anchor block and a block of rows that agree in ``by``, dealt out by pair."""
    asked, known = stored(_blocks(anchors, by, "q", size)), stored(_blocks(rows, by, "x", size))
    meet = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}_count") - 1)).alias(name)
    counts = lambda df, name: df.select(*by, f"{name}_count").distinct()
    left = asked.join(counts(known, "x"), by).select(*by, "q", "q_rows", meet("x"))
    right = known.join(counts(asked, "q"), by).select(*by, "x", "x_rows", meet("q"))
    return left.join(right, [*by, "q", "x"])


def _lists(tiles: DataFrame, pick, step: int, leaf: int) -> DataFrame:
    """anchor, slot, id, score: what ``pick`` takes from every tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dims = batch.column("dims")[r].as_py()
                asked, known = (_Block(batch.column(n)[r].values, dims) for n in ("q_rows", "x_rows"))
                for first in range(0, len(asked.row), step):
                    part = slice(first, first + step)
                    found = pick(scores(asked.v[part], known.v, leaf), asked.row[part], asked.labels[part], asked.windows[part], known)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                                         names=["anchor", "slot", "id", "score"])

    return tiles.mapInArrow(run, _LIST)


def _positives(k: int):
    """The ``k`` best other rows of a tile for each anchor."""

    def pick(score, anchor, label, windows, known):
        own = anchor[:, None] == known.row[None, :]
        order = np.argsort(np.where(own, _MOST, ~score), axis=1, kind="stable")[:, :k + 1]
        r = np.repeat(np.arange(len(anchor)), order.shape[1])
        c = order.ravel()
        keep = ~own[r, c]
        r, c = r[keep], c[keep]
        return anchor[r], np.zeros(len(r), np.int32), known.ids[c], score[r, c]

    return pick


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score s with low * positive <= high * s <= high * positive."""
    return -(-low * positive // high), positive


def _negatives(k: int, low: int, high: int):
    """For each positive of an anchor the ``k`` best rows of another label whose score lies in its window."""

    def pick(score, anchor, label, windows, known):
        key = np.where(label[:, None] == known.labels[None, :], _MOST, ~score)  # rows of the own label come last
        order = np.argsort(key, axis=1, kind="stable")
        out = [], [], [], []
        for r, positives in enumerate(windows):
            ranked = key[r, order[r]]
            for positive in positives:
                least, most = window(positive["score"], low, high)
                if least > most:
                    continue
                a = int(np.searchsorted(ranked, ~most, "left"))
                b = min(a + k, int(np.searchsorted(ranked, ~max(least, _LEAST + 1), "right")))
                if a < b:
                    taken = order[r, a:b]
                    out[0].append(np.full(b - a, anchor[r]))
                    out[1].append(np.full(b - a, positive["slot"], dtype=np.int32))
                    out[2].append(known.ids[taken])
                    out[3].append(score[r, taken])
        return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in out)

    return pick


def _merged(lists: DataFrame, by: list[str], k: int, groups: int = 64) -> DataFrame:
    """The best ``k`` of the lists ``by``, with their rank; over groups of entries first."""
    order = [F.desc("score"), "id"]
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    first = F.row_number().over(Window.partitionBy(*by, "__g").orderBy(*order))
    cut = lists.withColumn("__g", group).withColumn("rank", first).filter(F.col("rank") <= k).drop("__g")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- operator

def mine(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 5, shares: tuple[int, int] = (80, 100),
         label: Column | str = "label", key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block: int = BLOCK,
         step: int = STEP, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``is_anchor`` is the condition on ``vec_id`` that anchors meet. Scores are inner products of floor(scale * x). An
    anchor's positives are its best other rows of the same label, its negatives, for each positive, the best rows of other
    labels with shares[0] * positive_score <= shares[1] * negative_score <= shares[1] * positive_score. Equal scores go to
    the smaller id, and all are listed where there are fewer. Positives with an empty window give no row.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Equal rows count once;
    different rows of one id are rows of their own, as anchors and as partners. Vectors of different lengths are not
    compared. Scores beyond a bigint take its ends. An empty table gives no rows. Other columns are not read.
    """
    x = F.col(vector).cast("array<double>")
    labels = F.col(label) if isinstance(label, str) else label
    valid = F.col(key).isNotNull() & labels.isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(valid).select(F.col(key).cast("bigint").alias("vec_id"), labels.cast("bigint").alias("label"), F.size(vector).alias("dims"),
                                        F.transform(x, lambda c: F.floor(c * scale)).alias("v")).distinct()
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    anchors = rows.filter(is_anchor)
    low, high = shares

    near = _lists(_tiles(anchors, rows, ["dims", "label"], block), _positives(positives), step, leaf)
    chosen = stored(_merged(near, ["anchor"], positives).select("anchor", F.col("rank").cast("int").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = chosen.groupBy("anchor").agg(F.collect_list(F.struct("slot", F.col("positive_score").alias("score"))).alias("windows"))  # as many as positives
    armed = stored(anchors.join(windows, F.col("row") == F.col("anchor")).drop("anchor"))
    far = _lists(_tiles(armed, rows, ["dims"], block), _negatives(negatives, low, high), step, leaf)
    hard = _merged(far, ["anchor", "slot"], negatives)
    named = chosen.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return hard.join(named, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
