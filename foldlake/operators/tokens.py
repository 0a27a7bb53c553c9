"""Vocabulary, encoding, token-budget batches and chunks of residue strings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CHUNK_LENGTH, RESIDUE_TOKENS, VOCAB_LAYOUTS
from ..functions.ordering import hash_pieces, ordinal


def tokens_of(layout: str) -> list[str]:
    """Tokens in id order: specials, residues, fill to a multiple of eight, more specials."""
    before, after, _, _ = VOCAB_LAYOUTS[layout]
    tokens = [*before, *RESIDUE_TOKENS]
    fill = -len(tokens) % 8
    return [*tokens, *[f"<null_{k + 1}>" for k in range(fill)], *after]


def token_ids(layout: str) -> dict[str, int]:
    return {token: k for k, token in enumerate(tokens_of(layout))}


def vocab(spark: SparkSession, layout: str) -> DataFrame:
    return spark.createDataFrame([(t, k) for t, k in token_ids(layout).items()], "token string, id int")


def encode(df: DataFrame, layout: str = "roberta", column: str = "seq", max_len: int | None = None) -> DataFrame:
    """Add ``tokens``: residue ids between the start and end tokens the layout asks for.

    A string with a letter outside the vocabulary gets NULL (see ``split_unknown``).
    """
    ids = token_ids(layout)
    _, _, starts, ends = VOCAB_LAYOUTS[layout]
    residues, first = F.lit("".join(RESIDUE_TOKENS)), ids[RESIDUE_TOKENS[0]]  # residue ids follow each other
    letters = F.filter(F.split(column, ""), lambda c: c != "")
    body = F.transform(letters, lambda c: F.call_function("instr", residues, c) + (first - 1))
    if max_len:
        body = F.slice(body, 1, max_len)
    parts = [F.array(F.lit(ids["<cls>"]))] * starts + [body] + [F.array(F.lit(ids["<eos>"]))] * ends
    known = "".join("\\" + t if t in ".-" else t for t in RESIDUE_TOKENS)
    return df.withColumn("tokens", F.when(F.col(column).rlike(f"^[{known}]*$"), F.concat(*parts)))


def split_unknown(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return encoded.filter(F.col("tokens").isNotNull()), encoded.filter(F.col("tokens").isNull())


def token_batches(df: DataFrame, budget: int, extra: int = 0, key: str = "chain_key") -> DataFrame:
    """key, size, batch_no: batches of similar length whose padded size stays within ``budget`` tokens.

    Sequences are taken by length and packed greedily; those of one length come in the order of a hash of their key.
    A sequence longer than the budget gets a batch of its own. The batches depend on how many sequences there are of
    each length only, so the greedy pass runs over that histogram, a row per distinct length. Each sequence then finds
    its batch by its place among those of its length. Neither partitions nor settings change the result.
    """
    sized = df.select(F.col(key).alias("key"), (F.length("seq") + extra).cast("int").alias("size"))
    hashed = sized.withColumn("__h", F.md5("key"))
    placed = ordinal(hashed, ["size"], [F.col("__h"), F.col("key")], hash_pieces(F.col("__h"), 2), "place")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used = -1, 0  # the open batch and the sequences in it
        for frame in frames:
            rows = []
            for size, n in zip(frame["size"].tolist(), frame["n"].tolist()):
                fit = max(1, budget // size) if size else n + used
                here = min(n, max(0, fit - used)) if used else 0
                rows.append((size, fit, here, last))
                rest = n - here
                last, used = last + -(-rest // fit), (rest - 1) % fit + 1 if rest else used + n
            yield pd.DataFrame(rows, columns=["size", "fit", "here", "open"])

    lengths = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    runs = lengths.repartition(1).sortWithinPartitions("size").mapInPandas(pack, "size int, fit bigint, here bigint, open bigint")
    later = F.expr("CASE WHEN place < here THEN 0 ELSE (place - here) div fit + 1 END")
    return placed.join(runs, "size").select("key", "size", (F.col("open") + later).alias("batch_no"))


def chunk(df: DataFrame, max_len: int = CHUNK_LENGTH, key: str = "chain_key") -> DataFrame:
    """Consecutive pieces of at most ``max_len`` residues; an empty string has none."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{max_len}}}"), F.lit(0))  # one pass; a piece travels without the rest
    return df.select(key, F.posexplode(pieces).alias("chunk_no", "chunk"))
