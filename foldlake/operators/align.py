"""Global alignment of residue strings and the positions it pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AMINO_ACIDS, GAP, MATCH, MISMATCH


def _codes(seq: str) -> np.ndarray:
    """Letter numbers; letters outside the twenty are 0."""
    raw = np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)
    table = np.zeros(256, dtype=np.int16)
    for k, letter in enumerate(AMINO_ACIDS):
        table[ord(letter)] = k + 1
    return table[raw]


def _next_row(above: np.ndarray, code: int, other: np.ndarray, ramp: np.ndarray, gap: int) -> np.ndarray:
    """One row of the score table. A run of gaps is a running maximum, so the row needs no inner loop."""
    score = np.where(other == code, MATCH, MISMATCH) if code else np.zeros(len(other), dtype=np.int64)
    score = np.where(other == 0, 0, score)
    row = np.empty_like(above)
    row[0] = above[0] - gap
    row[1:] = np.maximum(above[:-1] + score, above[1:] - gap)
    return np.maximum.accumulate(row + ramp) - ramp


def align(query: str, template: str, gap: int = GAP) -> tuple[str, str, int]:
    """Gapped strings and score. Of equal ways back: diagonal, then up, then left.

    Only every s-th row of the table is kept (s about the square root of the
    length); the rows between are computed again on the way back, so memory
    grows with length^1.5 and long chains fit.
    """
    a, b = _codes(query), _codes(template)
    ramp = np.arange(len(b) + 1, dtype=np.int64) * gap
    stride = max(1, int(np.sqrt(len(a))))
    row, kept = -ramp, {0: -ramp}
    for i, code in enumerate(a, 1):
        row = _next_row(row, code, b, ramp, gap)
        if i % stride == 0:
            kept[i] = row
    total = int(row[-1])

    out_q, out_t = [], []
    i, j = len(a), len(b)
    base, rows = None, []
    while i > 0 or j > 0:
        if i == 0:
            out_q.append("-"), out_t.append(template[j - 1])
            j -= 1
            continue
        start = (i - 1) // stride * stride
        if start != base:
            base, rows = start, [kept[start]]
            for code in a[start:min(start + stride, len(a))]:
                rows.append(_next_row(rows[-1], code, b, ramp, gap))
        here, above = rows[i - start], rows[i - start - 1]
        same = 0 if j == 0 or not a[i - 1] or not b[j - 1] else (MATCH if a[i - 1] == b[j - 1] else MISMATCH)
        if j > 0 and here[j] == above[j - 1] + same:
            out_q.append(query[i - 1]), out_t.append(template[j - 1])
            i, j = i - 1, j - 1
        elif here[j] == above[j] - gap:
            out_q.append(query[i - 1]), out_t.append("-")
            i -= 1
        else:
            out_q.append("-"), out_t.append(template[j - 1])
            j -= 1
    return "".join(reversed(out_q)), "".join(reversed(out_t)), total


def _align_together(pairs: list[tuple[str, str]], gap: int) -> list[tuple[str, str, int]]:
    """The same result as ``align`` for several short pairs, row by row side by side."""
    size = len(pairs)
    a, b = np.zeros((size, max(len(q) for q, _ in pairs)), np.int16), np.zeros((size, max(len(t) for _, t in pairs)), np.int16)
    for k, (q, t) in enumerate(pairs):
        a[k, :len(q)], b[k, :len(t)] = _codes(q), _codes(t)
    ramp = (np.arange(b.shape[1] + 1) * gap).astype(np.int32)
    row = np.tile(-ramp, (size, 1))
    ends = np.array([len(t) for _, t in pairs])
    totals = row[np.arange(size), ends]
    ways = np.ones((a.shape[1], size, b.shape[1] + 1), np.int8)
    for i in range(a.shape[1]):
        code = a[:, i:i + 1]
        score = np.where(b == code, np.int32(MATCH), np.int32(MISMATCH)) * ((b > 0) & (code > 0))
        diagonal, up = row[:, :-1] + score, row[:, 1:] - gap
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] - gap
        np.maximum(diagonal, up, out=new[:, 1:])
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp
        ways[i, :, 1:] = np.where(row[:, 1:] == diagonal, 0, np.where(row[:, 1:] == up, 1, 2))
        done = np.array([len(q) == i + 1 for q, _ in pairs])
        totals = np.where(done, row[np.arange(size), ends], totals)
    return [(*_walk_back(q, t, ways[:, k]), int(totals[k])) for k, (q, t) in enumerate(pairs)]


def _walk_back(query: str, template: str, ways: np.ndarray) -> tuple[str, str]:
    out_q, out_t, i, j = [], [], len(query), len(template)
    while i > 0 or j > 0:
        way = 2 if i == 0 else ways[i - 1, j]
        out_q.append("-" if way == 2 else query[i - 1])
        out_t.append("-" if way == 1 else template[j - 1])
        i, j = i - (way != 2), j - (way != 1)
    return "".join(reversed(out_q)), "".join(reversed(out_t))


# Cells of the score tables worked on side by side; a longer pair is aligned by itself.
_CELLS = 16_000_000


def align_many(pairs: list[tuple[str, str]], gap: int = GAP) -> list[tuple[str, str, int]]:
    """Alignments of many pairs, those of similar size together."""
    results: list = [None] * len(pairs)
    waiting: list[int] = []

    def flush() -> None:
        if waiting:
            for k, done in zip(waiting, _align_together([pairs[k] for k in waiting], gap)):
                results[k] = done
            waiting.clear()

    rows = cols = 0
    for k in sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1]))):
        m, n = len(pairs[k][0]), len(pairs[k][1])
        if m * n > _CELLS // 4 or m == 0 or n == 0:
            results[k] = align(*pairs[k], gap)
            continue
        if waiting and max(rows, m) * max(cols, n) * (len(waiting) + 1) > _CELLS:
            flush()
            rows = cols = 0
        rows, cols = max(rows, m), max(cols, n)
        waiting.append(k)
    flush()
    return results


def many_tasks(df: DataFrame) -> int:
    """Tasks for rows whose cost has nothing to do with their bytes; a number that is given is not lowered for small data."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _candidates(pairs: DataFrame, queries: DataFrame, templates: DataFrame) -> DataFrame:
    """Each (query_key, tpl_key) once, with both strings, spread evenly over the tasks.

    The cost of a pair has nothing to do with its key, so pairs are dealt out after the two lookups.
    """
    wanted = pairs.select("query_key", "tpl_key").distinct()
    found = (wanted.join(queries.select(F.col("chain_key").alias("query_key"), F.col("seq").alias("q_seq")), "query_key")
             .join(templates.select(F.col("chain_key").alias("tpl_key"), F.col("seq").alias("t_seq")), "tpl_key"))
    return found.repartition(many_tasks(pairs), "query_key", "tpl_key")


def align_pairs(pairs: DataFrame, queries: DataFrame, templates: DataFrame, gap: int = GAP) -> DataFrame:
    """Alignments of (query_key, tpl_key) candidates: q_aln, t_aln, score. Repeated candidates are aligned once."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = align_many(list(zip(frame["q_seq"], frame["t_seq"])), gap)
            yield pd.DataFrame({
                "query_key": frame["query_key"], "tpl_key": frame["tpl_key"], "q_aln": [d[0] for d in done],
                "t_aln": [d[1] for d in done], "score": [d[2] for d in done]})

    return _candidates(pairs, queries, templates).mapInPandas(
        run, "query_key string, tpl_key string, q_aln string, t_aln string, score int")


_POSITIONS = "query_key string, tpl_key string, qpos int, tpos int, q_aa string, t_aa string"


def _paired(query_key: str, tpl_key: str, q_aln: str, t_aln: str) -> pd.DataFrame:
    """Positions that stand above each other in one alignment."""
    q, t = np.array(list(q_aln), dtype="<U1"), np.array(list(t_aln), dtype="<U1")
    both = (q != "-") & (t != "-")
    return pd.DataFrame({
        "query_key": query_key, "tpl_key": tpl_key, "qpos": (np.cumsum(q != "-") - 1)[both].astype("int32"),
        "tpos": (np.cumsum(t != "-") - 1)[both].astype("int32"), "q_aa": q[both], "t_aa": t[both]})


def align_positions(pairs: DataFrame, queries: DataFrame, templates: DataFrame, gap: int = GAP) -> DataFrame:
    """Aligned positions of (query_key, tpl_key) candidates, made where they are aligned: no column of an alignment moves."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = align_many(list(zip(frame["q_seq"], frame["t_seq"])), gap)
            for query_key, tpl_key, d in zip(frame["query_key"], frame["tpl_key"], done):
                yield _paired(query_key, tpl_key, d[0], d[1])

    return _candidates(pairs, queries, templates).mapInPandas(run, _POSITIONS)


def _letter_score(a: Column, b: Column) -> Column:
    known = F.lit(AMINO_ACIDS)
    inside = (F.call_function("instr", known, a) > 0) & (F.call_function("instr", known, b) > 0)
    return F.when(~inside, 0).when(a == b, MATCH).otherwise(MISMATCH)


def align_score(query: Column, template: Column, gap: int = GAP) -> Column:
    """Alignment score of two strings without leaving the JVM, in time of their lengths' product.

    The table is made diagonal by diagonal: a cell needs the two diagonals in front only. Both strings travel with the
    diagonals as letters, so that they are split once.
    """
    def letters(c: Column) -> Column:
        return F.filter(F.split(c, ""), lambda x: x != "")

    def line(value) -> Column:
        return F.transform(F.sequence(F.lit(0), F.length(query)), value)

    def step(state: Column, d: Column) -> Column:
        def cell(i: Column) -> Column:
            j = d - i
            both = F.when((i > 0) & (j > 0), F.get(state["h2"], i - 1) + _letter_score(F.get(state["a"], i - 1), F.get(state["b"], j - 1)))
            up, left = F.when(i > 0, F.get(state["h1"], i - 1) - gap), F.when(j > 0, F.get(state["h1"], i) - gap)
            return F.when((j >= 0) & (j <= F.size(state["b"])), F.greatest(both, up, left))

        following = F.transform(F.sequence(F.lit(0), F.size(state["a"])), cell)
        return F.struct(state["a"].alias("a"), state["b"].alias("b"), state["h1"].alias("h2"), following.alias("h1"))

    start = F.struct(letters(query).alias("a"), letters(template).alias("b"), line(lambda i: F.lit(None).cast("int")).alias("h2"),
                     line(lambda i: F.when(i == 0, 0)).alias("h1"))
    diagonals = F.filter(F.sequence(F.lit(0), F.length(query) + F.length(template)), lambda d: d > 0)
    return F.aggregate(diagonals, start, step, lambda s: F.element_at(s["h1"], -1))


def rescore(q_aln: Column, t_aln: Column, gap: int = GAP) -> Column:
    """Score of given gapped strings."""
    def one(a: Column, b: Column) -> Column:
        return F.when((a == "-") | (b == "-"), -gap).otherwise(_letter_score(a, b))

    steps = F.zip_with(F.split(q_aln, ""), F.split(t_aln, ""), lambda a, b: F.when(a == "", 0).otherwise(one(a, b)))
    return F.aggregate(steps, F.lit(0), lambda acc, s: acc + s)


def aligned_positions(alignments: DataFrame) -> DataFrame:
    """Pairs of positions (qpos, tpos) that stand above each other, with both letters, for alignments from elsewhere."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in zip(frame["query_key"], frame["tpl_key"], frame["q_aln"], frame["t_aln"]):
                yield _paired(*row)

    return alignments.select("query_key", "tpl_key", "q_aln", "t_aln").mapInPandas(run, _POSITIONS)


def cigar_positions(df: DataFrame, key: str = "key", column: str = "cigar") -> DataFrame:
    """Aligned positions of run-length encoded alignments (M, =, X pair up; I query only; D template only)."""
    runs = F.transform(
        F.regexp_extract_all(F.col(column), F.lit(r"(\d+[MIDX=])"), 1),
        lambda r: F.struct(F.regexp_extract(r, r"(\d+)", 1).cast("int").alias("n"), F.substring(r, -1, 1).alias("op")))
    steps = df.select(key, F.posexplode(runs).alias("at", "r")).select(key, "at", "r.n", "r.op")
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)

    def moved(skip: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("op") == skip, 0).otherwise(F.col("n"))).over(before), F.lit(0))

    placed = steps.select(key, "n", "op", moved("D").alias("q0"), moved("I").alias("t0"))
    paired = placed.filter(F.col("op").isin("M", "=", "X") & (F.col("n") > 0))
    cells = paired.select(key, "q0", "t0", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    return cells.select(key, (F.col("q0") + F.col("s")).cast("int").alias("qpos"), (F.col("t0") + F.col("s")).cast("int").alias("tpos"))
