"""Models on tokens of any length, and means of wide vectors."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foldlake.constants import AMINO_ACIDS
from foldlake.operators import embed
from foldlake.operators.tokens import encode
from foldlake.plans.retrieval import _letter_counts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests
ROWS = [(f"k{n:03d}", [0, *[4 + (n * 7 + i) % 20 for i in range(n * n % 61)], 2]) for n in range(120)] + [("none", None), ("bare", []), ("ends", [0, 2])]


def mean_model():
    """A vector for each token: its id, its square and its place."""
    def predict(tokens, mask):
        place = np.broadcast_to(np.arange(tokens.shape[1]), tokens.shape)
        return np.stack([tokens, tokens ** 2, place], axis=2).astype(np.float32)

    return predict


def row_model():
    """A vector for each row: the sum over its tokens, the pads left out by the mask."""
    return lambda tokens, mask: np.stack([(tokens * mask).sum(axis=1), mask.sum(axis=1)], axis=1)


def by_hand(tokens):
    inner = list(enumerate(tokens))[1:-1]
    return [float(np.mean([f(i, t) for i, t in inner])) if inner else 0.0 for f in (lambda i, t: t, lambda i, t: t * t, lambda i, t: i)]


@pytest.mark.parametrize("partitions, budget, rows", [(1, 1 << 14, 256), (16, 1 << 14, 256), (3, 40, 4), (2, 1, 1)])
def test_tokens_of_any_length(spark, partitions, budget, rows):
    df = spark.createDataFrame(ROWS, "chain_key string, tokens array<int>").repartition(partitions)
    out = embed.embed_tokens(df, mean_model, budget=budget, rows=rows)
    assert out.columns == ["chain_key", "tokens", "emb"]
    got = {r.chain_key: r.emb for r in out.collect()}
    assert len(got) == len(ROWS) and got["none"] is None
    for key, tokens in ROWS:
        if tokens is not None:
            assert got[key] == pytest.approx(by_hand(tokens), abs=1e-5), key


def test_vectors_of_rows(spark):
    df = spark.createDataFrame(ROWS, "chain_key string, tokens array<int>")
    got = {r.chain_key: r.emb for r in embed.embed_tokens(df, row_model, budget=100).collect()}
    assert all(got[k] == [float(sum(t)), float(len(t))] for k, t in ROWS if t is not None)


def test_batches_are_bounded():
    sizes = np.random.default_rng(1).integers(0, 300, 1000)
    sizes[5] = 5000
    seen = []
    for part in embed.padded_batches(sizes, np.arange(1000), 1024, 64):
        assert len(part) == 1 or (len(part) <= 64 and len(part) * sizes[part].max() <= 1024)
        seen += part.tolist()
    assert sorted(seen) == list(range(1000))
    assert len(list(embed.padded_batches(sizes, np.arange(1000), 1024, 64))) < 400


def test_long_sequences_are_chunked(spark):
    letters = "ACDEFGHIKLMNPQRSTVWY"
    seqs = [("a", "".join(letters[(k * k) % 20] for k in range(57))), ("b", "ACD"), ("c", ""), ("d", "ACJ"), ("e", "W" * 20)]
    df = spark.createDataFrame(seqs, "chain_key string, seq string")
    got = {r.chain_key: r.emb for r in embed.embed_sequences(df, mean_model, max_len=20).collect()}
    assert set(got) == {"a", "b", "e"}
    tokens = {r.seq: r.tokens for r in encode(spark.createDataFrame([(s[k:k + 20],) for _, s in seqs for k in range(0, len(s), 20)], "seq string")).collect()}
    for key, seq in seqs:
        if key in got:
            mean = np.mean([by_hand(tokens[seq[k:k + 20]]) for k in range(0, len(seq), 20)], axis=0)
            assert got[key] == pytest.approx((mean / (np.linalg.norm(mean) + 1e-8)).tolist(), abs=1e-6)


def test_wide_means_are_one_aggregate(spark):
    rng = np.random.default_rng(2)
    data = [(f"c{k % 3}", k % 5, rng.normal(size=1280).tolist()) for k in range(40)]
    df = spark.createDataFrame(data, "chain_key string, chunk_no int, vec array<double>").repartition(7)
    counted = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    seen = df.mapInArrow(touch, df.schema)
    got = {r.chain_key: r.emb for r in embed.mean_pool(seen).collect()}
    assert counted.value == 40  # the input is computed once, its width is not asked for
    for key, emb in got.items():
        assert emb == pytest.approx(np.mean([v for c, _, v in data if c == key], axis=0).tolist(), abs=1e-12)
    pooled = {r.chain_key: r.emb for r in embed.chunk_pool(df).collect()}
    for key, emb in pooled.items():
        chunks = [np.mean([v for c, n, v in data if (c, n) == (key, m)], axis=0) for m in {n for c, n, _ in data if c == key}]
        assert emb == pytest.approx(np.mean(chunks, axis=0).tolist(), abs=1e-12)


def test_letters_of_chunks_are_counted(spark):
    """One pass over the bytes of a chunk, not one per letter."""
    rows = [("a", "ACDEFGHIKLMNPQRSTVWY" * 3 + "WWY"), ("b", "A"), (None, "KKKKK"), ("a", "YV" * 511)]
    out = _letter_counts(spark.createDataFrame(rows, "chain_key string, chunk string").repartition(2))
    assert "replace(" not in out._jdf.queryExecution().toString()
    got = sorted((r.chain_key or "", r.counts) for r in out.collect())
    assert got == sorted((key or "", [float(chunk.count(a)) for a in AMINO_ACIDS]) for key, chunk in rows)
