"""Near-duplicate texts: exact Jaccard of word shingles on candidates from the trie join of ``simhash``.

Texts with the same shingles are one class. The signature of a class is one bit of each of 64 minima of its seeded shingle
hashes for every seed: two of them differ in (1 - Jaccard) / 2 of the bits on average. The tries link what differs in at
most ERRORS bits under some seed, and what hangs together is a candidate group. The first trie is joined by itself; of all
others only links between groups not yet connected leave a task, so that a large group gives about two links per member.

Inside a group, pairs whose whole signatures come near enough are compared exactly, pairs of one cluster no more:

* A group is dealt into blocks of up to BLOCK classes, and each block is compared in itself. Most groups are one block.
* In larger groups the classes with most links, up to PIVOTS of a group, are compared with all blocks.
* What then lies outside the largest cluster is compared with every block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .simhash import links

WORDS, SEEDS, ERRORS = 5, 12, 5
#: Least Jaccard similarity of near-duplicates, as a fraction of whole numbers.
SHARE = (4, 5)
#: Classes of a candidate group that are compared in one unit, the bytes of their hashes, and classes tried against all.
BLOCK, BYTES, PIVOTS = 2048, 1 << 26, 64
#: Signatures of a pair at SHARE differ in a tenth of the bits; beyond so many standard deviations a pair is not compared.
DEVIATIONS = 3.5

_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, 64 * SEEDS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, 64 * SEEDS, dtype=np.uint64)[:, None]


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of the runs of five words, rising; a shorter text is one run."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    runs = [b" ".join(found)] if len(found) < WORDS else [b" ".join(s) for s in zip(*(found[k:] for k in range(WORDS)))]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, len(runs)))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit value per seed: a bit of each minimum."""
    low = np.full(64 * SEEDS, np.iinfo(np.uint64).max)
    for first in range(0, len(hashes), 512):
        np.minimum(low, ((hashes[None, first:first + 512] ^ _PLUS) * _TIMES).min(axis=1), out=low)
    bits = (np.bitwise_count(low) & 1).reshape(SEEDS, 64)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets reaches SHARE."""
    least, of = SHARE
    if of * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return of * both >= least * (len(a) + len(b) - both)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), node (of the class), fps of every row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets), np.uint64, len(sets)).view(np.int64)
            fps = pa.array([fingerprints(s).tolist() for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), fps], names=["doc_id", "digest", "node", "fps"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("digest"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, digest bigint, node bigint, fps array<bigint>")


def candidates(marks: DataFrame) -> DataFrame:
    """node, root, fps: the classes that hang together with others by fingerprints with at most ERRORS different bits."""
    tries = ERRORS + 1
    of = stored(marks.groupBy("node").agg(F.first("fps").alias("fps")).withColumn("label", F.col("node")).withColumn("grouped", F.lit(False)))
    for first, last in ((0, 1), (1, tries * SEEDS)):
        seed, seeds = first // tries, -(-last // tries) - first // tries
        prints = of.select("label", F.posexplode(F.slice("fps", seed + 1, seeds)).alias("seed", "fp")).withColumn("seed", F.col("seed") + seed)
        heads = stored(prints.groupBy("seed", "fp").agg(F.min("label").alias("label")))
        equal = prints.join(heads.withColumnRenamed("label", "head"), ["seed", "fp"]).filter("label <> head").select(F.col("label").alias("a"), F.col("head").alias("b"))
        roots = components(links(heads, ERRORS, tries=(first, last)).unionByName(equal.distinct()))
        of = stored(of.join(roots, of["label"] == roots["node"], "left").select(
            of["node"], "fps", F.coalesce("root", "label").alias("label"), (F.col("grouped") | F.col("root").isNotNull()).alias("grouped")))
    return of.filter("grouped").select("node", F.col("label").alias("root"), "fps")


def near(signatures: np.ndarray) -> np.ndarray:
    """For every pair of signatures (rows of 64-bit words) whether they differ in few enough bits."""
    bits = 64 * signatures.shape[1]
    share = (1 - SHARE[0] / SHARE[1]) / 2
    most = share * bits + DEVIATIONS * np.sqrt(bits * share * (1 - share))
    out = np.empty((len(signatures), len(signatures)), dtype=bool)
    for first in range(0, len(signatures), 256):
        part = signatures[first:first + 256]
        apart = np.zeros((len(part), len(signatures)), dtype=np.int32)
        for word in range(signatures.shape[1]):
            apart += np.bitwise_count(part[:, word, None] ^ signatures[None, :, word])
        out[first:first + 256] = apart <= most
    return out


def _unit_links(nodes: list[int], clusters: list[int], sides: list[int], sets: list[np.ndarray], signatures: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the clusters of a unit by similar pairs of different sides, or any pairs where ``sides`` are null."""
    first, above, found = {}, list(range(len(nodes))), []

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    for k, cluster in enumerate(clusters):
        above[k] = first.setdefault(cluster, k)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    side = np.array([-1 if s is None else s for s in sides])
    group = np.array([top(k) for k in range(len(nodes))])
    open_ = near(signatures) & (SHARE[1] * sizes[:, None] >= SHARE[0] * sizes) & (SHARE[1] * sizes >= SHARE[0] * sizes[:, None])
    open_ &= (group[:, None] != group) & ((side < 0) | (side[:, None] != side))
    # Classes with most open pairs first: the one that all others were made from settles most of them.
    for k in np.argsort(-open_.sum(axis=1), kind="stable").tolist():
        for m in np.flatnonzero(open_[k]).tolist():
            p, q = top(k), top(m)
            if p != q and similar(sets[k], sets[m]):
                above[max(p, q)] = min(p, q)
                found.append((nodes[k], nodes[m]))
        open_[:, k] = False
    return found


def _compared(units: DataFrame) -> DataFrame:
    """a, b: links that connect the clusters of each unit (root, x, y) by similar pairs of its sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in groupby((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))), lambda r: r[:3]):
            _, _, _, nodes, clusters, sides, hashes, fps = zip(*unit)
            signatures = np.array(fps, dtype=np.int64).view(np.uint64).reshape(len(nodes), -1)
            found = _unit_links(nodes, clusters, sides, [np.frombuffer(h, np.uint64) for h in hashes], signatures)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    key = ["root", "x", "y"]
    rows = units.select(*key, "node", "cluster", "side", "hashes", "fps").repartition(*key).sortWithinPartitions(*key)
    return rows.mapInArrow(run, "a bigint, b bigint")


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with block x of each group ``by``, and the number of blocks; ``bytes`` is the size of a row's hashes."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BYTES)).alias("blocks")
    return rows.join(rows.groupBy(*by).agg(blocks), list(by)).withColumn("x", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))


def _clustered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the smallest node reachable over ``found`` as cluster."""
    tops = components(found).select("node", F.col("root").alias("top"))
    return rows.drop("cluster").join(tops, "node", "left").withColumn("cluster", F.coalesce("top", "node")).drop("top")


def _most_linked(places: DataFrame, found: DataFrame) -> DataFrame:
    """root, node: up to PIVOTS classes of each group with the most links; the best of each block first."""
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ranked = places.select("root", "x", "node").join(ends, "node")
    for by in (["root", "x"], ["root"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "node"))
        ranked = ranked.withColumn("place", place).filter(F.col("place") <= PIVOTS).drop("place")
    return ranked.select("root", "node")


def similar_classes(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """node, root: classes of ``marks`` connected by pairs with at least SHARE Jaccard inside the candidate groups."""
    picked = marks.groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("of")).join(candidates(marks), "node").select(
        "node", "root", "fps", F.col("of.doc_id").alias("id"), F.col("of.digest").alias("digest"))
    texts = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("d")).join(
        stored(picked), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("d") == F.col("digest"))).select("node", "root", "fps", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(t or b"").tobytes() for t in batch.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes, pa.binary())], names=["node", "root", "fps", "hashes"])

    rows = texts.mapInArrow(run, "node bigint, root bigint, fps array<bigint>, hashes binary").groupBy("node").agg(
        F.first("root").alias("root"), F.first("fps").alias("fps"), F.first("hashes").alias("hashes"))
    members = stored(_dealt(rows.withColumn("bytes", F.length("hashes")), "root"))
    whole = F.lit(None).cast("int").alias("side")
    found = stored(_compared(members.select("*", F.col("x").alias("y"), F.col("node").alias("cluster"), whole)))
    large = members.filter("blocks > 1")
    if large.limit(1).count() == 0:
        return components(found)

    held = ["node", "fps", "hashes"]
    places = stored(_clustered(large.select("node", "root", "x", "blocks", "bytes"), found))
    pivots = stored(_most_linked(places, found))
    counts = places.groupBy("root").agg(F.max("blocks").alias("blocks"))
    tried = pivots.join(counts, "root").join(places.select("node", "cluster"), "node").select(
        "root", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("x"), "node", "cluster", F.lit(1).alias("side"))
    rest = places.join(pivots, ["root", "node"], "left_anti").select("root", "x", "node", "cluster", F.lit(0).alias("side"))
    units = rest.unionByName(tried).withColumn("y", F.col("x")).join(large.select(*held), "node")
    found = stored(found.unionByName(_compared(units)))

    begun = stored(_clustered(places.drop("x", "blocks"), found))
    sizes = begun.groupBy("root", "cluster").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("root").agg(F.max(F.struct("n", "cluster")).alias("m")).select("root", F.col("m.cluster").alias("main"))
    parts = stored(_dealt(begun.join(largest, "root").withColumn("part", (F.col("cluster") == F.col("main")).cast("int")), "root", "part"))
    counts = parts.groupBy("root").agg(F.max(F.when(F.col("part") == 0, F.col("blocks"))).alias("others"), F.max(F.when(F.col("part") == 1, F.col("blocks"))).alias("mains"))
    # Blocks outside the main cluster have even numbers, those inside odd ones. A unit is a block outside (x) and any block (y).
    own = F.col("x") * 2 + F.col("part")
    to = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    asks = F.transform(F.concat(F.transform(to(F.col("others")), lambda k: k * 2), F.transform(to(F.col("mains")), lambda k: k * 2 + 1)),
                       lambda y: F.struct(own.alias("x"), y.alias("y"), F.when(y != own, F.lit(0)).alias("side")))
    asked = F.transform(F.filter(F.transform(to(F.col("others")), lambda k: k * 2), lambda k: k != own),
                        lambda k: F.struct(k.alias("x"), own.alias("y"), F.lit(1).alias("side")))
    meets = F.filter(F.when(F.col("part") == 0, F.concat(asks, asked)).otherwise(asked), lambda u: (u["y"] % 2 == 1) | (u["x"] <= u["y"]))
    met = parts.join(counts.filter("others is not null"), "root").select("root", "node", "cluster", F.explode(meets).alias("u")).select("root", "u.*", "node", "cluster")
    return components(found.unionByName(_compared(met.join(large.select(*held), "node"))))


def first_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The row of ``docs`` with the smallest (doc_id, digest of the text) of each group of ``grouped`` (doc_id, digest, part).

    All columns are kept. Of equal rows one stays. Rows with a null doc_id stay.
    """
    known = grouped.filter("doc_id is not null")
    kept = known.groupBy("part").agg(F.min(F.struct("doc_id", "digest")).alias("least")).select(F.col("least.doc_id").alias("__id"), F.col("least.digest").alias("__digest"))
    repeated = stored(known.groupBy("doc_id", "digest").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")))
    same = (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__digest"))
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    first = keyed.join(kept, same, "left_semi").unionByName(keyed.filter("doc_id is null"))
    if repeated.limit(1).count() == 0:
        return first.select(*docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    single = first.join(repeated, same, "left_semi").groupBy("doc_id", "__key").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("__row"))
    return first.join(repeated, same, "left_anti").select(*docs.columns).unionByName(single.select("__row.*"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) without near-duplicates; see ``first_rows`` for the one that stays of a group."""
    marks = stored(marked(docs))
    roots = stored(similar_classes(docs, marks))
    grouped = marks.select("doc_id", "digest", "node").join(roots, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("part"))
    return first_rows(docs, stored(grouped))
