"""Ranked lexical search with range-maximum tables over posting lists.

``build`` turns documents into an inverted index of shards: a shard holds some thousand documents in the order of their
ids, and a row for each of its terms lists the places of the documents that hold it and how often. ``search`` ranks the
documents for each item, shard by shard:

* A posting's impact is what it adds to a score. Over the impacts of each posting list lies a sparse table, which answers
  the maximum of any range at once.
* An interval of documents is bounded by the sum of the maxima of the item's terms in it. The intervals with the highest
  bounds are split first, each at the document that holds its greatest single impact: that document is scored exactly,
  what lies left and right of it become intervals with bounds of their own.
* An interval goes when its bound can no longer enter the best ``k`` found. Of equal scores the earlier place wins.

Items go in blocks, and a pair of item block and shard is a unit of work. The posting lists of a shard travel once per
item block; only the best ``k`` of a unit leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Tokens after which a shard is closed, and items in a block.
SHARD, ITEMS = 1 << 22, 256
#: Intervals of an item that are split together.
WAVE = 64
#: Parts over which the rows of one term, and the lists of one item, are dealt.
SALTS = 64
#: Bytes that belong to no term become blanks; only A-Z are lower-cased. Bytes above 0x7F are parts of letters.
_FOLD = bytes(c if c > 0x7F or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_ROW = "shard bigint, term binary, places array<int>, counts array<bigint>, ids array<bigint>"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_FOLD).split() if text else []


class Index(NamedTuple):
    """postings: shard, term, places, counts; shards: shard, ids (of the documents by place), counts (their terms)."""

    postings: DataFrame
    shards: DataFrame


def _shard(number: int, ids: list, owners: list[np.ndarray], found: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
    """Rows of one shard: its documents first, then a row for each term."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    owner, term = place[np.concatenate(owners)], np.concatenate(found)
    keys, counts = np.unique(term * len(ids) + owner, return_counts=True)
    term, owner = keys // len(ids), keys % len(ids)
    starts = np.searchsorted(term, np.arange(len(names) + 1))
    lengths = np.bincount(owner, weights=counts, minlength=len(ids)).astype(np.int64)
    none, some = np.zeros(1, np.int64), len(names)
    offsets = np.concatenate([none, starts])  # the first row has no places
    places = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(owner, pa.int32()))
    of = pa.ListArray.from_arrays(pa.array(np.concatenate([none, starts + len(ids)]), pa.int32()), pa.array(np.concatenate([lengths, counts])))
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([none, np.full(some + 1, len(ids))]), pa.int32()), pa.array([ids[k] for k in order], pa.int64()))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(some + 1, number)), pa.array([None, *names], pa.binary()), places, of, listed], names=["shard", "term", "places", "counts", "ids"])


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: int = SHARD) -> Index:
    """The index of all whole texts of ``docs``; it is stored once. A null text has no term. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, owners, found, known, size = [], [], [], {}, 0

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = terms(value)
                ids.append(doc)
                owners.append(np.full(len(words), len(ids) - 1))
                found.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                size += len(words) + 1
                if size >= tokens:
                    yield _shard(number, ids, owners, found, list(known))
                    number += 1
                    ids, owners, found, known, size = [], [], [], {}, 0
        if ids:
            yield _shard(number, ids, owners, found, list(known))

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    made = stored(rows.mapInArrow(run, _ROW))
    return Index(made.filter("term is not null").select("shard", "term", "places", "counts"), made.filter("term is null").select("shard", "ids", "counts"))


class _Lists:
    """Posting lists of one shard, one behind the other, with the range-maximum table over their impacts."""

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], docs: int):
        """``lists`` has the places, rising, and the impacts of each term."""
        self.docs = docs
        sizes = np.array([len(p) for p, _ in lists], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.place = np.concatenate([p for p, _ in lists]).astype(np.int64)
        self.impact = np.concatenate([i for _, i in lists])
        self.key = np.repeat(np.arange(len(lists)), sizes) * docs + self.place
        total, levels = len(self.place), int(sizes.max(initial=1)).bit_length()
        self.table = np.zeros((levels, total), dtype=np.int32)  # position of the maximum of the 2^level entries from here
        self.table[0] = np.arange(total)
        for level in range(1, levels):
            half = 1 << (level - 1)
            left, right = self.table[level - 1, :-half], self.table[level - 1, half:]
            self.table[level] = self.table[level - 1]
            self.table[level, :-half] = np.where(self.impact[left] >= self.impact[right], left, right)

    def maximum(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Impact and position of the maximum of each range, the first of equal ones; impact 0 for an empty range."""
        size = last - first
        level = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
        safe = np.minimum(first, len(self.impact) - 1)
        left = self.table[level, safe]
        right = self.table[level, np.maximum(np.minimum(last, len(self.impact)) - (1 << level), 0)]
        best = np.where(self.impact[left] >= self.impact[right], left, right)
        return np.where(size > 0, self.impact[best], 0), best

    def search(self, of: np.ndarray, k: int, wave: int = WAVE) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the best ``k`` documents for the terms ``of``, and how many documents were scored."""
        first, last = self.starts[of][None, :], self.ends[of][None, :]
        low = np.zeros(1, dtype=np.int64)
        impact, _ = self.maximum(first, last)
        bound = impact.sum(axis=1)
        places, scores, scored = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while True:
            least, worst = (scores[-1], places[-1]) if len(places) == k else (0, -1)
            open_ = (bound > least) | ((bound == least) & (low < worst))
            first, last, low, bound = first[open_], last[open_], low[open_], bound[open_]
            if len(bound) == 0:
                return places, scores, scored
            top = np.argpartition(-bound, wave)[:wave] if len(bound) > wave else np.arange(len(bound))
            a, b, begin = first[top], last[top], low[top]
            impact, at = self.maximum(a, b)
            split = self.place[at[np.arange(len(top)), impact.argmax(axis=1)]]
            middle = np.searchsorted(self.key, of[None, :] * self.docs + split[:, None])
            inside = np.minimum(middle, len(self.key) - 1)
            hit = (middle < b) & (self.place[inside] == split[:, None])
            exact = np.where(hit, self.impact[inside], 0).sum(axis=1)
            scored += len(split)
            places, scores = np.concatenate([places, split]), np.concatenate([scores, exact])
            order = np.lexsort((places, ~scores))[:k]
            places, scores = places[order], scores[order]
            rest = np.ones(len(bound), dtype=bool)
            rest[top] = False
            new_first, new_last = np.concatenate([a, middle + hit]), np.concatenate([middle, b])
            new_bound = self.maximum(new_first, new_last)[0].sum(axis=1)
            first, last = np.concatenate([first[rest], new_first]), np.concatenate([last[rest], new_last])
            low, bound = np.concatenate([low[rest], begin, split + 1]), np.concatenate([bound[rest], new_bound])


def weight(n: int):
    """A term's weight from its number of documents ``df`` among ``n``."""
    return F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("df") + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray, weight: int, n: int, total: int) -> np.ndarray:
    """What each posting adds to a score: ``counts`` of the term in documents of ``lengths`` terms."""
    m = 100 - 50 + (50 * lengths * n) // total
    return weight * ((1000000000 * counts) // (1000 * counts + 20 * m))


def _answer(unit: list[pa.RecordBatch], n: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
    """Best documents of the items of one unit: rows of kind 0 (documents), 1 (items), 2 (posting lists)."""
    ids = lengths = None
    items, names, lists = [], {}, []
    for batch in unit:
        kind = batch.column("kind").to_numpy()
        for r in np.flatnonzero(kind == 0):
            ids, lengths = batch.column("ids")[r].as_py(), np.asarray(batch.column("counts")[r].values)
        for r in np.flatnonzero(kind == 1):
            items.append((batch.column("item")[r].as_py(), batch.column("terms")[r].as_py(), batch.column("counts")[r].as_py()))
        for r in np.flatnonzero(kind == 2):
            names[batch.column("term")[r].as_py()] = len(lists)
            lists.append((np.asarray(batch.column("places")[r].values), np.asarray(batch.column("counts")[r].values)))
    if not lists or ids is None:
        return
    weights = {t: w for _, of, ws in items for t, w in zip(of, ws)}
    made = _Lists([(p, impacts(c, lengths[p], weights[t], n, total)) for (t, (p, c)) in zip(names, lists)], len(ids))
    for item, of, _ in items:
        asked = np.array(sorted(names[t] for t in of if t in names), dtype=np.int64)
        if len(asked) == 0:
            continue
        places, scores, scored = made.search(asked, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(places), item)), pa.array([ids[p] for p in places.tolist()], pa.int64()), pa.array(scores), pa.array(np.full(len(places), scored))],
            names=["item", "doc_id", "score", "scored"])


def best(index: Index, items: DataFrame, k: int = 50, item_key: str = "item_id", item_text: str = "text", block: int = ITEMS) -> DataFrame:
    """item, item_id, doc_id, score, scored: the best ``k`` documents of every shard for every row of ``items``.

    ``scored`` is how many documents of the shard were scored for the item.
    """
    split = F.udf(lambda t: sorted(set(terms(t.encode()))) if t else [], "array<binary>")
    blocks = max(1, -(-items.count() // block))
    asked = items.select(F.col(item_key).alias("item_id"), split(F.col(item_text).cast("string")).alias("terms")).withColumn("item", F.monotonically_increasing_id())
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")))

    # Posting lists of asked terms. The rows of a term are as many as there are shards, so they are dealt by salt.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    wanted = asked.select("block", F.explode("terms").alias("term")).groupBy("term").agg(F.collect_set("block").alias("blocks"))
    salted = index.postings.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int"))
    lists = stored(salted.join(wanted.select("*", salts), ["term", "salt"]).drop("salt"))

    sizes = index.shards.agg(F.sum(F.size(F.filter("counts", lambda c: c > 0))), F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c))).first()
    n, total = int(sizes[0] or 0), int(sizes[1] or 0)
    weights = lists.groupBy("term").agg(F.sum(F.size("places")).alias("df")).select("term", weight(n).cast("bigint").alias("w"))
    weighed = asked.select("item", "block", F.explode("terms").alias("term")).join(weights, "term").groupBy("item", "block").agg(
        F.collect_list(F.struct("term", "w")).alias("of")).select("item", "block", F.col("of.term").alias("terms"), F.col("of.w").alias("counts"))

    # Units: a shard's documents, the items of a block, and the posting lists they ask for.
    def rows(df: DataFrame, kind: int, *names: str) -> DataFrame:
        kinds = {"item": "bigint", "term": "binary", "terms": "array<binary>", "places": "array<int>", "counts": "array<bigint>", "ids": "array<bigint>"}
        return df.select("block", "shard", F.lit(kind).alias("kind"), *[(F.col(c) if c in names else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    by_block = weighed.groupBy("block").agg(F.collect_list(F.struct("item", "terms", "counts")).alias("items"))  # as many as a block holds
    salt = F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int").alias("salt")
    sent = index.shards.select("shard", salt, every).join(by_block.select("*", salts), ["block", "salt"]).select(
        "block", "shard", F.explode("items").alias("i")).select("block", "shard", "i.*")
    units = rows(index.shards.select("*", every), 0, "ids", "counts").unionByName(rows(sent, 1, "item", "terms", "counts")).unionByName(
        rows(lists.select("*", F.explode("blocks").alias("block")), 2, "term", "places", "counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "shard")])
                cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if b > a:
                        yield tuple(keys[:, a].tolist()), batch.slice(a, b - a)

        for _, unit in groupby(pieces(), lambda p: p[0]):
            yield from _answer([piece for _, piece in unit], n, total, k)

    dealt = units.repartition("block", "shard").sortWithinPartitions("block", "shard")
    found = dealt.mapInArrow(run, "item bigint, doc_id bigint, score bigint, scored bigint")
    return found.join(asked.select("item", "item_id"), "item")


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           tokens: int = SHARD, block: int = ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents with the highest score above 0 for every item.

    Equal scores go to the smaller doc_id, null ids last; fewer rows come back where fewer documents score. Every row of
    ``docs`` is a document of its own, copies and rows with a null id included, and every row of ``items`` is asked on its
    own. Null and empty texts have no terms: such documents are found by nothing, such items find nothing. An empty table
    gives no rows. Other columns are not read.
    """
    found = best(build(docs, key, text, tokens), items, k, item_key, item_text, block)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    group = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    first = found.withColumn("__g", group).withColumn("rank", F.row_number().over(Window.partitionBy("item", "__g").orderBy(*order))).filter(F.col("rank") <= k)
    last = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return first.withColumn("rank", last).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
