"""Residue pairs: distances, contacts, masks, crops, padding, corrections.

Pair tables hold one row per unordered pair (i < j) unless stated otherwise.
Pairs are always found through a spatial grid or taken from a given table;
nothing here lists all pairs of a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONTACT_CUTOFF, MIN_SEPARATION, SEED
from ..functions import vectors as V

# The zero offset and the 13 offsets after it: each pair of neighbouring cells is met once.
_FORWARD = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]

# Background correction: blocks of 128 by 128 residues; numbers that stand for an unknown residue and for all of them.
_TILE_BITS = 7
_NOWHERE, _ALL = -(1 << 63), (1 << 63) - 1


def _cell(axis: str, size: float) -> Column:
    return F.floor(F.col(axis) / size).cast("int")


def pair_distances(residues: DataFrame, radius: float, join: str | None = None) -> DataFrame:
    """Pairs of one chain less than ``radius`` apart, with their distance.

    Residues meet only in the same or a neighbouring cube of edge ``radius``, and only in cubes that their ball
    reaches, so the work follows the number of close pairs and the join key (chain and cube) stays small however long
    the chain is. The planner chooses the join, which can spill; ``join="shuffle_hash"`` is faster where the residues
    of a shuffle partition are known to fit in memory.
    """
    size = radius * (1 + 1e-9)
    here = residues.filter("has_ca").select(
        "chain_key", F.col("pos").alias("p"), "x", "y", "z",
        _cell("x", size).alias("cx"), _cell("y", size).alias("cy"), _cell("z", size).alias("cz"))
    offsets = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in _FORWARD])

    def gap(axis: str, cell: str, step: str) -> Column:
        """Distance along one axis to the cube ``step`` cubes away."""
        inside = F.col(axis) - F.col(cell) * size
        return F.when(F.col(step) > 0, size - inside).when(F.col(step) < 0, inside).otherwise(0.0)

    gaps = [gap(axis, cell, step) for axis, cell, step in (("x", "cx", "o.a"), ("y", "cy", "o.b"), ("z", "cz", "o.c"))]
    reached = sum((g * g for g in gaps), F.lit(0.0)) <= radius * radius * (1 + 1e-6)
    reach = here.select("chain_key", "p", "x", "y", "z", "cx", "cy", "cz", F.explode(offsets).alias("o")).filter(reached).select(
        F.col("chain_key").alias("k"), F.col("p").alias("q"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w"),
        (F.col("cx") + F.col("o.a")).alias("ex"), (F.col("cy") + F.col("o.b")).alias("ey"), (F.col("cz") + F.col("o.c")).alias("ez"),
        ((F.col("o.a") == 0) & (F.col("o.b") == 0) & (F.col("o.c") == 0)).alias("home"))
    dx, dy, dz = F.col("x") - F.col("u"), F.col("y") - F.col("v"), F.col("z") - F.col("w")
    dist = F.sqrt(dx * dx + dy * dy + dz * dz)
    plain = here.hint(join) if join else here
    met = plain.join(reach, (F.col("chain_key") == F.col("k")) & (F.col("cx") == F.col("ex")) & (F.col("cy") == F.col("ey"))
                    & (F.col("cz") == F.col("ez")) & (~F.col("home") | (F.col("q") < F.col("p"))) & (dist < radius))
    return met.select("chain_key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), dist.alias("dist"))


def contacts(residues: DataFrame, cutoff: float = CONTACT_CUTOFF, min_sep: int = MIN_SEPARATION, join: str | None = None) -> DataFrame:
    """Pairs closer than ``cutoff`` and at least ``min_sep`` positions apart."""
    return pair_distances(residues, cutoff, join).filter(F.col("j") - F.col("i") >= min_sep)


def mirror(pairs: DataFrame) -> DataFrame:
    """Both orders of every pair. Each row is turned into two; nothing is shuffled."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return pairs.select(*rest, F.explode(both).alias("ij")).select("ij.i", "ij.j", *rest).select(*pairs.columns)


def matrix_rows(pairs: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Rows of the symmetric 0/1 matrix, for residues with at least one pair: their partners in order.

    With ``windows`` (chain_key, crop_start, crop_end), rows inside a chain's window also get its cells, dense; a
    window bounds them, whatever the length of the chain.
    """
    partners = mirror(pairs.select("chain_key", "i", "j")).groupBy("chain_key", "i").agg(F.array_sort(F.collect_set("j")).alias("partners"))
    if windows is None:
        return partners
    inside = (F.col("i") >= F.col("crop_start")) & (F.col("i") < F.col("crop_end"))
    near = F.filter("partners", lambda j: (j >= F.col("crop_start")) & (j < F.col("crop_end")))
    cells = F.transform(F.sequence(F.col("crop_start"), F.col("crop_end") - 1), lambda k: F.when(F.array_contains("near", k), 1).otherwise(0))
    met = partners.join(windows.select("chain_key", "crop_start", "crop_end"), "chain_key", "left").withColumn("near", near)
    return met.select("chain_key", "i", "partners", F.when(inside, cells).alias("cells"))


def pair_mask(pairs: DataFrame, residues: DataFrame, include_diagonal: bool = False) -> DataFrame:
    """Pairs marked 1 where both residues are present (and differ, unless asked otherwise)."""
    present = residues.select("chain_key", F.col("pos"), F.col("has_ca"))
    left = present.select("chain_key", F.col("pos").alias("i"), F.col("has_ca").alias("has_i"))
    right = present.select("chain_key", F.col("pos").alias("j"), F.col("has_ca").alias("has_j"))
    both = F.coalesce(F.col("has_i"), F.lit(False)) & F.coalesce(F.col("has_j"), F.lit(False))
    if not include_diagonal:
        both = both & (F.col("i") != F.col("j"))
    return (pairs.join(left, ["chain_key", "i"], "left").join(right, ["chain_key", "j"], "left")
            .select(*pairs.columns, both.cast("int").alias("mask")))


def long_range(pairs: DataFrame, min_sep: int) -> DataFrame:
    return pairs.filter(F.abs(F.col("i") - F.col("j")) >= min_sep)


def crop_windows(chains: DataFrame, size: int, mode: str = "random", seed: int = SEED) -> DataFrame:
    """Crop bounds per chain: the middle, a reproducible random place, or everything."""
    room = F.col("L") - size
    if mode == "center":
        start = F.greatest(F.lit(0), F.floor(room / 2))
    elif mode == "random":
        draw = F.conv(F.substring(F.md5(F.concat("chain_key", F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint")
        start = draw % (room + 1)
    else:
        start = None
    if start is None or size <= 0:
        begin, end = F.lit(0), F.col("L")
    else:
        begin = F.when(room > 0, start).otherwise(0)
        end = F.when(room > 0, begin + size).otherwise(F.col("L"))
    return chains.withColumn("crop_start", begin.cast("int")).withColumn("crop_end", end.cast("int"))


def crop_pairs(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs inside their chain's window, counted from its start."""
    cut = pairs.join(windows.select("chain_key", "crop_start", "crop_end"), "chain_key").filter(
        (F.col("i") >= F.col("crop_start")) & (F.col("j") < F.col("crop_end")))
    moved = {"i": F.col("i") - F.col("crop_start"), "j": F.col("j") - F.col("crop_start")}
    return cut.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in pairs.columns], "crop_start", "crop_end")


def crop_residues(residues: DataFrame, windows: DataFrame) -> DataFrame:
    """Residues inside their chain's window, counted from its start."""
    cut = residues.join(windows.select("chain_key", "crop_start", "crop_end"), "chain_key").filter(
        (F.col("pos") >= F.col("crop_start")) & (F.col("pos") < F.col("crop_end")))
    return cut.withColumn("pos", F.col("pos") - F.col("crop_start")).select(*residues.columns)


def pad_arrays(df: DataFrame, batch: str, column: str, value) -> DataFrame:
    """Arrays filled up with ``value`` to the longest of their batch."""
    widest = df.groupBy(batch).agg(F.max(F.size(column)).alias("__width"))
    fill = F.array_repeat(F.lit(value), F.col("__width") - F.size(column))
    return df.join(widest, batch).withColumn(column, F.concat(F.col(column), fill)).select(*df.columns)


def infer_cb(backbone: DataFrame) -> DataFrame:
    """Position of the first side-chain atom of each residue, from its backbone."""
    # Ideal geometry coefficients.
    normal, along, back = -0.58273431, 0.56802827, -0.54067466
    bond = V.sub(V.point("ca"), V.point("n"))
    leave = V.sub(V.point("c"), V.point("ca"))
    steps = backbone.select("chain_key", "pos", "ca", *V.fields("b", bond), *V.fields("c", leave))
    b, c = V.named("b"), V.named("c")
    cb = V.add(V.add(V.add(V.scale(V.cross(b, c), normal), V.scale(b, along)), V.scale(c, back)), V.point("ca"))
    return steps.select("chain_key", "pos", *V.fields("cb", cb))


def distogram(pairs: DataFrame, backbone: DataFrame, min_bin: float, max_bin: float, bins: int) -> DataFrame:
    """Distance bin of each given pair: squared distances against squared edges.

    The pair table decides which cells are binned, so a caller asks for the
    neighbourhood needed; a residue without all three atoms yields NULL.
    """
    beta = infer_cb(backbone)
    left = beta.select("chain_key", F.col("pos").alias("i"), *V.fields("l", V.named("cb")))
    right = beta.select("chain_key", F.col("pos").alias("j"), *V.fields("r", V.named("cb")))
    step = (max_bin - min_bin) / (bins - 2)
    edges = F.array(*[F.lit((min_bin + step * k) ** 2) for k in range(bins - 1)])
    gap = V.named("g")
    met = pairs.select("chain_key", "i", "j").join(left, ["chain_key", "i"]).join(right, ["chain_key", "j"]).select(
        "chain_key", "i", "j", *V.fields("g", V.sub(V.named("l"), V.named("r"))))
    squared = met.select("chain_key", "i", "j", V.dot(gap, gap).alias("d2"))
    bin_no = F.size(F.filter(edges, lambda e: e < F.col("d2")))
    return squared.select("chain_key", "i", "j", F.when(F.col("d2").isNotNull(), bin_no).alias("bin"))


def symmetrize(directed: DataFrame, how: str = "mean", keys: tuple[str, ...] = ("chain_key",), value: str = "x") -> DataFrame:
    """x[i,j] + x[j,i] per unordered pair, halved for the mean; a missing order counts as 0."""
    total = F.sum(value) if how == "sum" else F.sum(value) / 2
    diagonal = F.max(value) * (2 if how == "sum" else 1)
    low, high = F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    summed = directed.groupBy(*keys, low, high).agg(total.alias("__total"), diagonal.alias("__diagonal"))
    return summed.select(*keys, "i", "j", F.when(F.col("i") == F.col("j"), F.col("__diagonal")).otherwise(F.col("__total")).alias(value))


def _end(column: str) -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(_NOWHERE))


def apc(pairs: DataFrame, keys: tuple[str, ...] = ("chain_key",), values: tuple[str, ...] = ("x",), tasks: int | None = None) -> DataFrame:
    """x - row sum * column sum / total of a symmetric matrix given by its pairs i < j.

    Several value columns are corrected in one pass, in ``tasks`` tasks (``spark.sql.shuffle.partitions`` unless given).
    The pairs move once, into blocks of the matrix, which no single chain can make one-sided; keys after the first, such
    as a channel, stay together in a block. A block's sums, one row per residue and one for all, are added up over the
    blocks of the chain and come back to the block as a map. Whole numbers give results that are exact but for one
    division.
    """
    tasks = tasks or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, inner = keys[0], keys[1:]
    block, sums = [first, "__ti", "__tj"], [f"__s_{v}" for v in values]
    tiles = {t: F.shiftright(_end(c), _TILE_BITS) for t, c in (("__ti", "i"), ("__tj", "j"))}
    # The tiles are not sent along; and as they need i and j, both readers below need the same columns and share one shuffle.
    dealt = pairs.dropna(subset=list(keys)).repartition(tasks, first, *tiles.values()).withColumns(tiles)
    ends = dealt.select(*block, *inner, F.explode(F.array(_end("i"), _end("j"), F.lit(_ALL))).alias("__at"), *values)
    local = ends.groupBy(*block, *inner, "__at").agg(*[F.sum(v).alias(s) for v, s in zip(values, sums)]).filter(F.col("__at") != _NOWHERE)
    over = Window.partitionBy(*keys, "__at")
    whole = local.repartition(tasks, *keys, "__at").select(*block, *inner, "__at", *[F.sum(s).over(over).alias(s) for s in sums])
    known = whole.repartition(tasks, *block).groupBy(*block, *inner).agg(
        F.map_from_entries(F.collect_list(F.struct("__at", F.struct(*sums)))).alias("__known"))
    found = F.col("__known")
    if inner:
        known = known.groupBy(*block).agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*inner), "__known"))).alias("__known"))
        found = F.try_element_at("__known", F.struct(*inner))
    row, column, total = (F.try_element_at(found, at) for at in (_end("i"), _end("j"), F.lit(_ALL)))
    met = dealt.join(known, block).select(*pairs.columns, row.alias("__row"), column.alias("__column"), total.alias("__total"))
    fixed = {v: (F.col(v) - F.col(f"__row.{s}") * F.col(f"__column.{s}") / (F.col(f"__total.{s}") * 2)).alias(v) for v, s in zip(values, sums)}
    return met.filter(F.col("__row").isNotNull() & F.col("__column").isNotNull()).select(
        *[fixed[c] if c in fixed else F.col(c) for c in pairs.columns])


def logistic_score(features: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """sigmoid(sum of weight * channel + bias) per pair, channels side by side as columns."""
    z = sum((F.col(c) * w for c, w in weights.items()), F.lit(float(bias)))
    return features.select("chain_key", "i", "j", (1 / (1 + F.exp(-z))).alias("score"))


def logistic_score_long(features: DataFrame, weights: DataFrame, bias: float) -> DataFrame:
    """The same for a row per pair and channel, for models with hundreds of channels.

    ``weights`` (channel, w) has one row per channel, a size fixed by the model.
    """
    z = F.sum(F.col("x") * F.col("w")) + bias
    return features.join(F.broadcast(weights), "channel").groupBy("chain_key", "i", "j").agg((1 / (1 + F.exp(-z))).alias("score"))
