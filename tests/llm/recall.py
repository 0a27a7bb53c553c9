"""Measures what the approximate steps find: near-duplicate pairs and nearest neighbours.

    PYTHONPATH=. python tests/llm/recall.py /root/testdata/sf0.1

Near-duplicates: every pair of different sets of five-word shingles with a Jaccard similarity of at least 0.8 is found by
a plain prefix join, outside Spark, and looked up in the groups of ``near_text``. Neighbours: the 20 largest inner products
of every query, by matrix product.
"""

import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np

from foldlake.llm import crosspoly, near_text
from foldlake.session import build_session, stored


def similar_pairs(sets):
    """All (a, b) with at least 0.8 of Jaccard similarity: such sets share one of the rarest fifth of their shingles."""
    counts = Counter(s for of in sets for s in of.tolist())
    by_shingle, found = defaultdict(list), set()
    for k in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        rare = sorted(sets[k].tolist(), key=lambda s: (counts[s], s))
        prefix = rare[:len(rare) - -(-4 * len(rare) // 5) + 1]
        for m in {m for s in prefix for m in by_shingle[s]}:
            if near_text.similar(sets[m], sets[k]):
                found.add((m, k))
        for s in prefix:
            by_shingle[s].append(k)
    return found


def main(sf_dir):
    spark = build_session("recall", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    texts = [(t or "").encode() for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()]
    sets = list({s.tobytes(): s for s in map(near_text.shingles, texts)}.values())
    pairs = similar_pairs(sets)
    node = lambda s: int(np.uint64(near_text.xxhash.xxh64_intdigest(s.tobytes(), 42)).astype(np.int64))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = stored(near_text.marked(docs))
    groups = {r["node"]: r["root"] for r in near_text.candidates(marks).select("node", "root").collect()}
    classes = {r["node"]: r["root"] for r in near_text.similar_classes(docs, marks).collect()}
    together = lambda of: sum(of.get(node(sets[a]), a) == of.get(node(sets[b]), -1 - b) for a, b in pairs)
    print(f"near duplicates: {len(pairs)} pairs of {len(sets)} different sets, {together(groups)} in one candidate group, {together(classes)} in one class")

    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet' WHERE embedding IS NOT NULL ORDER BY vec_id").fetchnumpy()
    ids, x = np.asarray(table["vec_id"]), np.stack([np.asarray(v, dtype=np.float64) for v in table["embedding"]])
    found = defaultdict(set)
    for r in crosspoly.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0").collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = asked = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = x @ x[k]
        score[k] = -np.inf
        best = ids[np.argsort(-score, kind="stable")[:20]]
        hits, asked = hits + len(found[int(ids[k])] & set(best.tolist())), asked + len(best)
    print(f"neighbours: {hits} of {asked} found, recall {hits / asked:.3f}")


if __name__ == "__main__":
    main(sys.argv[1].rstrip("/") if len(sys.argv) > 1 else "/root/testdata/sf0.1")
