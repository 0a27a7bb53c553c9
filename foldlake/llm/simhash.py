"""SimHash near-duplicates through a self-join of binary tries.

Fingerprints are stored in binary tries, and pairs of trie nodes are followed down together. A pair carries the bits
in which its two paths differ and is dropped once they exceed the error budget. Fingerprints with at most ``errors``
different bits agree in one of ``errors + 1`` blocks of the path, so there is one trie per block, rotated to begin with
it. In each trie only pairs that start in one node at the depth of a block are followed. These nodes are the units that
Spark distributes. A node pair with too many members is followed a byte further as a join, its children becoming units
of their own, so no unit outgrows a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components

ERRORS = 3
#: Members of a node pair that one task may hold; larger ones are split.
UNIT = 4096
#: Sizes up to which two nodes are compared member by member.
LEAF = 32


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64 bits of one UTF-8 text."""
    found = text.lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found)] if len(found) < words else [b" ".join(s) for s in zip(*(found[k:] for k in range(words)))]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    votes = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first:first + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the bits as a signed bigint) of every row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            bits = np.fromiter((fingerprint(t) if t else 0 for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- tries

def follow(v: np.ndarray, first: np.ndarray, middle: np.ndarray, last: np.ndarray, depth: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all members of node pairs whose bits differ in at most ``errors`` places.

    ``v`` holds 64-bit paths, rising inside each pair. Pair p is the node v[first:middle] with v[middle:last], or, where
    ``middle`` equals ``last``, the node with itself. Its paths are settled down to ``depth``.
    """
    found_i, found_j = [], []
    self_pair = middle == last
    start_b = np.where(self_pair, first, middle)
    err = np.where(self_pair, 0, np.bitwise_count(_prefix(v[first], depth) ^ _prefix(v[np.minimum(start_b, len(v) - 1)], depth)))
    waiting = np.stack([first, middle, start_b, last, err.astype(np.int64)])
    waiting = waiting[:, (waiting[4] <= errors)]
    depth = depth[err <= errors]
    nodes = np.empty((5, 0), dtype=np.int64)
    for d in range(int(depth.min(initial=64)), 65):
        nodes = np.concatenate([nodes, waiting[:, depth == d]], axis=1)
        if nodes.shape[1] == 0:
            continue
        a0, a1, b0, b1, e = nodes
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (d == 64)
        if small.any():
            i, j = _members(a0[small], a1[small], b0[small], b1[small])
            near = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= errors)
            found_i.append(i[near])
            found_j.append(j[near])
        if d == 64:
            break
        a0, a1, b0, b1, e = nodes[:, ~small]
        ones = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - d)) & np.uint64(1))]).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        crossed = a0 != b0  # a node with itself has one mixed pair, not two
        nodes = np.concatenate([
            np.stack([a0, am, b0, bm, e]), np.stack([am, a1, bm, b1, e]), np.stack([a0, am, bm, b1, e + 1]),
            np.stack([am, a1, b0, bm, e + 1])[:, crossed]], axis=1)
        nodes = nodes[:, (nodes[0] < nodes[1]) & (nodes[2] < nodes[3]) & (nodes[4] <= errors)]
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _prefix(v: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first ``depth`` bits of each path, at least one."""
    return v >> (64 - depth).astype(np.uint64)


def _members(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
    """All positions (i, j) with a0 <= i < a1 and b0 <= j < b1, for arrays of small ranges."""
    width = b1 - b0
    sizes = (a1 - a0) * width
    which = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a0[which] + inner // width[which], b0[which] + inner % width[which]


def _forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``size`` members the smallest one it is linked with over any number of links."""
    label = np.arange(size)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _turned(fp: Column, bits: int) -> Column:
    """``fp`` rotated left."""
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def links(distinct: DataFrame, errors: int = ERRORS, unit: int = UNIT, tries: tuple[int, int] | None = None) -> DataFrame:
    """a, b: links that connect exactly the ``fp`` of ``distinct`` that differ in at most ``errors`` bits.

    Inside a unit the links are reduced to a forest with the same components. Where ``distinct`` has a column ``seed``
    (whole numbers from 0), only equal seeds are linked. Where it has a column ``label``, links are between labels: what
    has one label is connected already, and a unit gives fewer links than it has labels. ``tries`` limits the join to a
    range of tries, counted from 0 over the seeds, ``errors + 1`` to a seed.
    """
    if not 0 <= errors < 8:
        raise ValueError("the error budget must be 0 to 7 bits")
    blocks = errors + 1
    starts = [64 * k // blocks for k in range(blocks + 1)]
    seeded = "seed" in distinct.columns
    turned = F.array(*[
        F.struct((F.col("seed") * blocks + k if seeded else F.lit(k)).alias("trie"), F.lit(end - begin).alias("depth"), _turned(F.col("fp"), begin).alias("path"))
        for k, (begin, end) in enumerate(zip(starts, starts[1:]))])
    carried = ["path", "label"] if "label" in distinct.columns else ["path"]
    rows = distinct.select(F.explode(turned).alias("t"), *carried[1:]).select("t.*", *carried[1:])
    if tries:
        rows = rows.filter((F.col("trie") >= tries[0]) & (F.col("trie") < tries[1]))
    node = F.expr("shiftrightunsigned(path, 64 - depth)")
    rows = rows.select("trie", "depth", node.alias("a"), node.alias("b"), *carried)
    key = ["trie", "depth", "a", "b"]

    parts = []
    while True:
        rows = stored(rows)
        large = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > unit) & (F.col("depth") < 64)))
        if large.limit(1).count() == 0:
            parts.append(rows)
            break
        parts.append(rows.join(large.drop("n"), key, "left_anti"))
        crowded = rows.join(large.drop("n"), key, "left_semi").withColumn("deeper", F.least(F.col("depth") + 8, F.lit(64)))
        crowded = crowded.withColumn("child", F.expr("shiftrightunsigned(path, 64 - deeper)"))
        children = crowded.groupBy(*key).agg(F.collect_set("child").alias("children"))  # at most 2 x 256 a pair
        met = crowded.join(children, key)
        other = F.filter("children", lambda c: (F.bit_count(c.bitwiseXOR(F.col("child"))) <= errors) & (
            (F.col("a") == F.col("b")) | (_above(c) != _above(F.col("child")))))
        met = met.select("trie", "deeper", *carried, "child", F.explode(other).alias("other"))
        unsigned = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  orders paths of 64 bits as unsigned
        first = unsigned(F.col("child")) <= unsigned(F.col("other"))
        rows = met.select("trie", F.col("deeper").alias("depth"), F.when(first, F.col("child")).otherwise(F.col("other")).alias("a"),
                          F.when(first, F.col("other")).otherwise(F.col("child")).alias("b"), *carried)
    units = parts[0]
    for part in parts[1:]:
        units = units.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*key, *carried)]))
            table = np.concatenate(held, axis=1)
            ends = np.flatnonzero((table[:4, 1:] != table[:4, :-1]).any(axis=0)) + 1
            if len(ends):
                yield solve(table[:, :ends[-1]])
                held = [table[:, ends[-1]:]]
            else:
                held = [table]
        if held:
            yield solve(np.concatenate(held, axis=1))

    def solve(table: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((table[4].view(np.uint64), table[3], table[2], table[1], table[0]))
        trie, depth, a, b, path = table[:5, order]
        v = path.view(np.uint64)
        size = len(v)
        new = np.flatnonzero(np.concatenate([[True], (np.stack([trie, depth, a, b])[:, 1:] != np.stack([trie, depth, a, b])[:, :-1]).any(axis=0)]))
        last = np.append(new[1:], size)
        in_b = (a != b) & (_prefix(v, depth).view(np.int64) == b)
        sums = np.concatenate([[0], np.cumsum(in_b)])
        middle = last - (sums[last] - sums[new])
        only_b = (a[new] != b[new]) & (middle == new)
        only_a = (a[new] != b[new]) & (middle == last)
        use = ~(only_a | only_b)
        i, j = follow(v, new[use], middle[use], last[use], depth[new][use], errors)
        if len(carried) > 1:
            names, first, of = np.unique(table[5, order], return_index=True, return_inverse=True)
            root = _forest(size, np.concatenate([i, np.arange(size)]), np.concatenate([j, first[of]]))
            group = root[first]
            least = np.full(size, np.iinfo(np.int64).max)
            np.minimum.at(least, group, names)
            linked = names != least[group]
            return pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(least[group][linked])], names=["a", "b"])
        root = _forest(size, i, j)
        linked = np.flatnonzero(root != np.arange(size))
        turn = np.array(starts, dtype=np.uint64)[trie % blocks]
        back = np.where(turn == 0, v, v >> turn | v << (np.uint64(64) - turn) % np.uint64(64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back[linked]), pa.array(back[root[linked]])], names=["a", "b"])

    dealt = units.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _above(child: Column) -> Column:
    """The node from which a child was made."""
    return F.call_function("shiftrightunsigned", child, F.col("deeper") - F.col("depth"))


# ---------------------------------------------------------------- groups

def near_duplicates(docs: DataFrame, errors: int = ERRORS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, a row's own included. Null and empty texts, and those
    without a word, have fingerprint zero and are linked like any other. Repeated rows share their component. A null
    doc_id takes part but is never a component_id; component_id is null where no reachable row has an id. An empty
    table gives no rows. Other columns are not read.
    """
    return _grouped(stored(fingerprints(docs)), errors).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(rows: DataFrame, errors: int) -> DataFrame:
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = stored(components(links(classes.select("fp"), errors)))
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = joined.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp")
