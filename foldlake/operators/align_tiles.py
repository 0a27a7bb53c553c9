"""Global alignment of pairs too long for one task, tile by tile.

The score table of a pair is cut into square tiles. A tile needs the last row of the tile above and the last column of the
tile to its left, so the tiles of one diagonal, of all pairs, are one distributed step, and only borders travel between
steps. The way back crosses at most as many tiles as there are diagonals: in each step the tile in which a pair stands is
made again from its borders and walked through. A task holds one tile, whatever the lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import GAP, MATCH, MISMATCH
from ..session import stored
from .align import _codes, many_tasks

#: Residues along the side of a tile.
TILE = 4096
_PAIR = ["query_key", "tpl_key"]
_TILE = "query_key string, tpl_key string, row int, col int, top binary, side binary, bottom binary, right binary"
_WALK = "query_key string, tpl_key string, step int, i int, j int, score int, q_part string, t_part string"


def table_of(q: str, t: str, top: np.ndarray, side: np.ndarray, gap: int) -> np.ndarray:
    """Scores of one tile with its borders: ``top`` with the corner in front, ``side`` without it."""
    a, b = _codes(q), _codes(t)
    ramp = np.arange(len(b) + 1, dtype=np.int32) * np.int32(gap)
    out = np.empty((len(a) + 1, len(b) + 1), dtype=np.int32)
    out[0] = top
    for k, code in enumerate(a, 1):
        above, row = out[k - 1], out[k]
        score = np.where(b == code, np.int32(MATCH), np.int32(MISMATCH)) * ((b > 0) & (code > 0))
        row[0] = side[k - 1]
        np.maximum(above[:-1] + score, above[1:] - gap, out=row[1:])
        np.subtract(np.maximum.accumulate(row + ramp), ramp, out=row)
    return out


def walk(table: np.ndarray, q: str, t: str, i: int, j: int, gap: int) -> tuple[int, int, str, str]:
    """From place (i, j) of a tile to its first row or column: diagonal before up before left, as in ``align``."""
    a, b, out_q, out_t = _codes(q), _codes(t), [], []
    while i > 0 and j > 0:
        same = 0 if not a[i - 1] or not b[j - 1] else MATCH if a[i - 1] == b[j - 1] else MISMATCH
        if table[i, j] == table[i - 1, j - 1] + same:
            i, j = i - 1, j - 1
            out_q.append(q[i]), out_t.append(t[j])
        elif table[i, j] == table[i - 1, j] - gap:
            i -= 1
            out_q.append(q[i]), out_t.append("-")
        else:
            j -= 1
            out_q.append("-"), out_t.append(t[j])
    return i, j, "".join(reversed(out_q)), "".join(reversed(out_t))


def _numbers(border) -> np.ndarray:
    return np.frombuffer(border, dtype=np.int32)


def _frames(rows: Iterator[tuple], columns: list[str], room: int = 1 << 25) -> Iterator[pd.DataFrame]:
    """Rows as frames of about ``room`` bytes at most: many small tiles share a frame, large ones do not pile up."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str | bytes))
        if size >= room:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _pieces(strings: DataFrame, keys: list[str], column: str, number: str, tile: int) -> DataFrame:
    """keys, number and piece of every string, ``tile`` letters each."""
    cuts = F.posexplode(F.sequence(F.lit(0), F.length(column) - 1, F.lit(tile))).alias(number, "at")
    return strings.filter(F.length(column) > 0).select(*keys, cuts, column).select(*keys, number, F.col(column).substr(F.col("at") + 1, F.lit(tile)).alias(f"{column}_piece"))


def align_long(pairs: DataFrame, queries: DataFrame, templates: DataFrame, gap: int = GAP, tile: int = TILE) -> DataFrame:
    """Alignments of (query_key, tpl_key) candidates: q_aln, t_aln, score; the strings ``align_pairs`` gives.

    Two steps per diagonal of tiles, so this is for few long pairs; ``align_pairs`` takes many short ones. Repeated
    candidates are aligned once. An empty string stands against gaps.
    """
    wanted = pairs.select(*_PAIR).distinct()
    sized = stored(wanted.join(queries.select(F.col("chain_key").alias("query_key"), F.col("seq").alias("q")), "query_key")
                   .join(templates.select(F.col("chain_key").alias("tpl_key"), F.col("seq").alias("t")), "tpl_key")
                   .select(*_PAIR, "q", "t", F.length("q").alias("m"), F.length("t").alias("n")))
    rows, cols = stored(_pieces(sized, _PAIR, "q", "row", tile)), stored(_pieces(sized, _PAIR, "t", "col", tile))
    ends = sized.filter("m > 0 and n > 0").select(*_PAIR, F.expr(f"(m - 1) div {tile}").cast("int").alias("last_row"), F.expr(f"(n - 1) div {tile}").cast("int").alias("last_col"))
    waves = (ends.agg(F.max(F.col("last_row") + F.col("last_col"))).first()[0] or 0) + 1
    tasks = many_tasks(pairs)
    tile_columns, walk_columns = ([part.split()[0] for part in schema.split(", ")] for schema in (_TILE, _WALK))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                top = _numbers(r.top) if r.top is not None else -gap * np.arange(r.col * tile, r.col * tile + len(r.t_piece) + 1, dtype=np.int32)
                side = _numbers(r.side) if r.side is not None else -gap * np.arange(r.row * tile + 1, r.row * tile + len(r.q_piece) + 1, dtype=np.int32)
                table = table_of(r.q_piece, r.t_piece, top, side, gap)
                yield r.query_key, r.tpl_key, r.row, r.col, top.tobytes(), side.tobytes(), table[-1].tobytes(), table[1:, -1].tobytes()

    none = F.lit(None).cast("binary")
    begun = ends.select(*_PAIR, F.lit(0).alias("row"), F.lit(0).alias("col"), none.alias("top"), none.alias("side"))
    done = None
    for _ in range(waves):
        met = begun.join(rows, [*_PAIR, "row"]).join(cols, [*_PAIR, "col"]).repartition(tasks, *_PAIR, "row", "col")
        made = stored(met.mapInPandas(lambda frames: _frames(score(frames), tile_columns), _TILE))
        done = made if done is None else done.unionByName(made)
        down = made.select(*_PAIR, (F.col("row") + 1).alias("row"), "col", F.col("bottom").alias("top"), none.alias("side"))
        right = made.select(*_PAIR, "row", (F.col("col") + 1).alias("col"), none.alias("top"), F.col("right").alias("side"))
        begun = down.unionByName(right).join(ends, _PAIR).filter("row <= last_row and col <= last_col").groupBy(*_PAIR, "row", "col").agg(
            F.first("top", ignorenulls=True).alias("top"), F.first("side", ignorenulls=True).alias("side"))

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                table = table_of(r.q_piece, r.t_piece, _numbers(r.top), _numbers(r.side), gap)
                i, j, q_part, t_part = walk(table, r.q_piece, r.t_piece, r.i - r.row * tile, r.j - r.col * tile, gap)
                total = int(table[-1, -1]) if r.step == 0 else 0
                yield r.query_key, r.tpl_key, r.step + 1, i + r.row * tile, j + r.col * tile, total, q_part, t_part

    # Pairs with an empty string have no tile: all gaps.
    at = sized.select(*_PAIR, F.lit(0).alias("step"), F.col("m").alias("i"), F.col("n").alias("j"),
                      F.when((F.col("m") == 0) | (F.col("n") == 0), -gap * (F.col("m") + F.col("n"))).otherwise(0).alias("score"), F.lit("").alias("q_part"), F.lit("").alias("t_part"))
    walked = at
    for _ in range(waves):
        standing = at.filter("i > 0 and j > 0").select(*_PAIR, "step", "i", "j", F.expr(f"(i - 1) div {tile}").cast("int").alias("row"), F.expr(f"(j - 1) div {tile}").cast("int").alias("col"))
        met = standing.join(done.select(*_PAIR, "row", "col", "top", "side"), [*_PAIR, "row", "col"]).join(rows, [*_PAIR, "row"]).join(cols, [*_PAIR, "col"])
        at = stored(met.repartition(tasks, *_PAIR).mapInPandas(lambda frames: _frames(back(frames), walk_columns), _WALK))
        walked = walked.unionByName(at)

    # What is left in front of the last step stands against gaps; parts come last step first.
    parts = F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("order"), "i", "j", "q_part", "t_part")))
    joined = walked.groupBy(*_PAIR).agg(parts.alias("parts"), F.sum("score").cast("int").alias("score")).join(sized.select(*_PAIR, "q", "t"), _PAIR)
    first = F.element_at("parts", 1)
    lead_q = F.concat(F.substring(F.col("q"), F.lit(1), first["i"]), F.repeat(F.lit("-"), first["j"]))
    lead_t = F.concat(F.repeat(F.lit("-"), first["i"]), F.substring(F.col("t"), F.lit(1), first["j"]))
    rest = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return joined.select(*_PAIR, F.concat(lead_q, rest("q_part")).alias("q_aln"), F.concat(lead_t, rest("t_part")).alias("t_aln"), "score")
