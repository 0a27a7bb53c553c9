"""Pooling, normalising and indexing of embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CHUNK_LENGTH, VOCAB_LAYOUTS
from ..functions.vectors import l2_normalize
from .tokens import chunk, encode, token_ids


def _mean(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean vector per key: one vector aggregate, so one row per key and task moves, whatever the number of dimensions."""
    vector = array_to_vector(F.col(column).cast("array<double>"))
    return df.filter(F.col(column).isNotNull()).groupBy(*keys).agg(vector_to_array(Summarizer.mean(vector)).alias("emb"))


def mean_pool(token_vecs: DataFrame, key: str = "chain_key", valid: str | None = None) -> DataFrame:
    """Mean token vector per sequence over valid tokens; zeros where none is valid."""
    if valid is None:
        return _mean(token_vecs, [key], "vec")
    pooled = _mean(token_vecs.filter(valid), [key], "vec")
    empty = token_vecs.groupBy(key).agg(F.max(F.size("vec")).alias("__dims"))
    zeros = F.transform(F.sequence(F.lit(1), F.col("__dims")), lambda _: F.lit(0.0))
    return empty.join(pooled, key, "left").select(key, F.coalesce("emb", zeros).alias("emb"))


def chunk_pool(token_vecs: DataFrame, key: str = "chain_key", chunk: str = "chunk_no") -> DataFrame:
    """Plain mean of chunk means: a short last chunk counts like a full one."""
    chunks = _mean(token_vecs, [key, chunk], "vec")
    return _mean(chunks, [key], "emb")


def embed(df: DataFrame, make_predict_fn: Callable, input_col: str, dims: int, batch_size: int = 256) -> DataFrame:
    """Add ``emb`` from a user's model, loaded once per Python worker and fed in batches."""
    predict = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                                input_tensor_shapes=[[dims]])
    return df.withColumn("emb", predict(input_col))


def _pooled(out: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """One vector a row: as the model gave it, or the mean of its token vectors over ``inner``, zeros where there is none."""
    if out.ndim == 2:
        return out
    sums = np.einsum("nld,nl->nd", out, inner.astype(out.dtype))
    return sums / np.maximum(inner.sum(axis=1), 1)[:, None]


def embed_tokens(df: DataFrame, make_model: Callable, column: str = "tokens", budget: int = 1 << 14, rows: int = 256, starts: int = 1, ends: int = 1,
                 pad: int = 1) -> DataFrame:
    """Add ``emb``, a vector for each row of tokens of any length, from a user's model loaded once per task.

    The rows of a partition are sorted by length and dealt into batches of at most ``rows`` rows and ``budget`` padded
    tokens; a single longer row is a batch of its own. ``make_model`` returns a function of (tokens, mask), two arrays of
    (rows, longest) with ``pad`` and False behind the end of each row. It returns one vector a row, or one a token; those
    are averaged over the row's tokens without its own ``starts`` first and ``ends`` last ones. Rows without such tokens
    get zeros, null tokens a null. Nothing is shuffled, and the batches decide cost only, not results.
    """
    size = F.coalesce(F.size(column), F.lit(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            known = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            vectors: list = [None] * batch.num_rows
            for part in padded_batches(sizes, known, budget, rows):
                width = max(1, int(sizes[part].max()))
                mask = np.arange(width) < sizes[part][:, None]
                tokens = np.full((len(part), width), pad, dtype=np.int64)
                tokens[mask] = lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False)
                model = model or make_model()
                inner = mask & (np.arange(width) >= starts) & (np.arange(width) < sizes[part][:, None] - ends)
                for at, vector in zip(part.tolist(), _pooled(np.asarray(model(tokens, mask), dtype=np.float64), inner)):
                    vectors[at] = vector
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*batch.schema.names, "emb"])

    schema = T.StructType([*df.schema.fields, T.StructField("emb", T.ArrayType(T.DoubleType()))])
    return df.withColumn("__size", size).sortWithinPartitions("__size").drop("__size").mapInArrow(run, schema)


def padded_batches(sizes: np.ndarray, rows_of: np.ndarray, budget: int, rows: int) -> Iterator[np.ndarray]:
    """``rows_of`` by rising size, cut where another row would leave the budget of padded tokens or of rows."""
    order = rows_of[np.argsort(sizes[rows_of], kind="stable")]
    first = 0
    for at in range(1, len(order) + 1):
        if at == len(order) or at - first == rows or (at - first + 1) * sizes[order[at]] > budget:
            yield order[first:at]
            first = at


def embed_sequences(df: DataFrame, make_model: Callable, layout: str = "roberta", max_len: int = CHUNK_LENGTH, key: str = "chain_key", **batches) -> DataFrame:
    """key, emb: the unit vector of each sequence (key, seq) of any length.

    Sequences are cut into chunks of ``max_len`` residues, chunks become tokens of the layout, go through the model in padded
    batches, and are averaged plainly, a short last chunk like a full one. Empty sequences and those with letters outside
    the vocabulary have no vector.
    """
    coded = encode(chunk(df, max_len, key), layout, "chunk")
    _, _, starts, ends = VOCAB_LAYOUTS[layout]
    ids = token_ids(layout)
    options = {"starts": starts, "ends": ends, "pad": ids["<pad>"], **batches}
    vectors = embed_tokens(coded.filter(F.col("tokens").isNotNull()).select(key, "chunk_no", "tokens"), make_model, **options)
    return chain_vectors(vectors, key)


def build_index(embeddings: DataFrame, exclude: DataFrame) -> DataFrame:
    """Embeddings of structures that are not excluded and not empty."""
    return embeddings.filter(F.col("L") > 0).join(exclude.select("pdb_id").distinct(), "pdb_id", "left_anti")


def chain_vectors(chunks: DataFrame, key: str = "chain_key") -> DataFrame:
    """Unit vector of each chain from the vectors of its chunks (key, emb): their plain mean, scaled."""
    return _mean(chunks, [key], "emb").withColumn("emb", l2_normalize(F.col("emb")))


def require_rows(df: DataFrame, what: str = "index") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
