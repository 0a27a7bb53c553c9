"""Positions and running sums inside groups of any size.

``row_number() over (partition by group)`` sorts a whole group in one task. The
functions here split each group first by a coarse key that rises with the sort
order, count the pieces, and add up the counts of the pieces in front. No task
then holds more than one piece, however large the group is.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def _pieces(count: int) -> list[str]:
    return [f"__piece{k}" for k in range(count)]


def ordinal(df: DataFrame, group: list[str], order: list[Column], pieces: list[Column], name: str,
            running: dict[str, Column] | None = None) -> DataFrame:
    """Add ``name``: the 0-based place of each row in its group by ``order``.

    ``pieces`` are columns that never fall as ``order`` advances (for example the
    first hex digits of a hash the order starts with). ``running`` maps a new
    column to a numeric expression whose inclusive running sum is wanted.
    """
    running = running or {}
    names = _pieces(len(pieces))
    cut = df.select("*", *[p.alias(n) for p, n in zip(pieces, names)])
    keys = [*group, *names]

    sizes = cut.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(expr).alias(f"__s_{out}") for out, expr in running.items()],
    )
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"__at_{k}") for k in keys],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows_before"),
        *[F.coalesce(F.sum(f"__s_{out}").over(before), F.lit(0)).alias(f"__before_{out}") for out in running],
    )

    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same_piece = [F.col(k).eqNullSafe(F.col(f"__at_{k}")) for k in keys]
    return cut.join(offsets, same_piece, "inner").select(
        *df.columns,
        (F.row_number().over(inside) - 1 + F.col("__rows_before")).cast("bigint").alias(name),
        *[(F.sum(expr).over(upto) + F.col(f"__before_{out}")).alias(out) for out, expr in running.items()],
    )


def hash_pieces(hash_col: Column, digits: int = 3) -> list[Column]:
    """Coarse key for an order that starts with a hex hash: its leading digits."""
    return [F.substring(hash_col, 1, digits)]


def range_pieces(df: DataFrame, column: str, pieces: int = 256) -> list[Column]:
    """Coarse key for a numeric order column: its quantile range.

    Reads at most ``pieces`` - 1 boundary values to the driver, whatever the size of ``df``.
    """
    cuts = [k / pieces for k in range(1, pieces)]
    row = df.agg(F.percentile_approx(column, cuts, 1000).alias("q")).first()
    bounds = sorted(set(row["q"] or []))
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0))
    return [F.size(F.filter(edges, lambda b: b < F.col(column)))]


def with_score_pieces(df: DataFrame, score: str, tie_breaker: str, pieces: int = 128, width: int = 64) -> tuple[DataFrame, list[Column]]:
    """``df`` with a coarse key for descending scores, also when most of them are equal, wherever they lie; and the key.

    Borders are quantiles of the scores (at most ``pieces`` - 1 values reach the driver). A score that is a border has
    a piece of its own, as any score more frequent than 1 in ``pieces`` is; there all rows tie, so the piece is cut
    again along the tie breaker. Between borders lies about one part in ``pieces`` of the rows.
    """
    cuts = [k / pieces for k in range(1, pieces)]
    found = df.agg(F.percentile_approx(F.col(score).cast("double"), cuts, 20 * pieces).alias("q")).first()["q"]
    borders = sorted({-b for b in found or [0.0]})
    placed = Bucketizer(splits=[float("-inf"), *borders, float("inf")], inputCol="__descending", outputCol="__range").transform(
        df.withColumn("__descending", -F.col(score).cast("double")))  # range k starts at border k - 1, itself included
    lower = F.element_at(F.array(F.lit(float("-inf")), *[F.lit(b) for b in borders]), F.col("__range").cast("int") + 1)
    at_border = F.col("__descending") == lower
    rank = 2 * F.col("__range").cast("int") + F.when(at_border, 0).otherwise(1)
    tie = F.when(at_border, F.floor(F.col(tie_breaker) / width)).otherwise(F.lit(0))
    return placed.withColumns({"__piece_range": rank, "__piece_tie": tie}).drop("__descending", "__range"), [F.col("__piece_range"), F.col("__piece_tie")]


def sums_of_best(df: DataFrame, group: str, wanted: DataFrame, places: list[str], order: list[str], value: str, limit: int = 1 << 16,
                 digits: int = 256) -> DataFrame:
    """``wanted`` (``group`` and ``places``, a row per group) with each place replaced by the sum of ``value`` over so many first rows.

    Rows come by the first column of ``order`` descending, then by the others rising. A group of up to ``limit`` rows is
    ranked as it is. Of larger ones nothing but what lies around the asked places is sorted: the range of a group's scores
    is cut into ``digits`` parts, which are counted and summed; the part in which a place falls is cut again, by the next
    column where its scores are all equal, until it has at most ``limit`` rows. ``df`` is read several times: store it.
    """
    rows = df.select(group, *order, value)
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__rows"))
    if (sizes.agg(F.max("__rows")).first()[0] or 0) <= limit:
        return _ranked_sums(rows, group, wanted, places, order, value)
    sizes = stored(sizes)
    small, large = (sizes.filter(c).select(group) for c in (F.col("__rows") <= limit, F.col("__rows") > limit))
    ranked = _ranked_sums(rows.join(small, group, "left_semi"), group, wanted.join(large, group, "left_anti"), places, order, value)
    asked = wanted.join(large, group, "left_semi")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("bigint").alias("n")) for n in places])).alias("a")
    marks = asked.select(group, each).select(group, "a.name", F.col("a.n").alias("__need"), F.lit(0).cast("bigint").alias("__part"), F.lit(0).cast("bigint").alias("__sum"))
    found = _sums_by_digits(rows.join(large, group, "left_semi"), group, marks, order, value, limit, digits)
    wide = found.groupBy(group).agg(*[F.sum(F.when(F.col("name") == n, F.col("best"))).alias(n) for n in places])
    rest = [c for c in wanted.columns if c not in places]
    summed = asked.select(*rest).join(wide, group, "left").select(*[F.coalesce(c, F.lit(0)).alias(c) if c in places else F.col(c) for c in wanted.columns])
    return ranked.unionByName(summed)


def _ranked_sums(rows: DataFrame, group: str, wanted: DataFrame, places: list[str], order: list[str], value: str) -> DataFrame:
    """``sums_of_best`` where every group fits in a task."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order[0]), *order[1:]))
    rest = [c for c in wanted.columns if c != group and c not in places]
    ranked = wanted.join(rows, group, "left").withColumn("__place", place)
    sums = [F.coalesce(F.sum(F.when(F.col("__place") <= F.col(n), F.col(value))), F.lit(0)).alias(n) for n in places]
    return ranked.groupBy(group, *rest).agg(*sums).select(*wanted.columns)


def _sums_by_digits(rows: DataFrame, group: str, marks: DataFrame, order: list[str], value: str, limit: int, digits: int) -> DataFrame:
    """group, name, best of ``marks``: places (``__need``) inside a part (``__part``), with what lies in front (``__sum``)."""
    rows, before_round = rows.withColumn("__part", F.lit(0).cast("bigint")), None
    while True:
        extremes = rows.groupBy(group, "__part").agg(*[e for c in order for e in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))])
        digit = F.lit(0)
        for c in reversed(order):
            low, high = F.col(f"__lo_{c}").cast("double"), F.col(f"__hi_{c}").cast("double")
            share = (high - F.col(c) if c == order[0] else F.col(c) - low) / (high - low)
            digit = F.when(low < high, F.least(F.lit(digits - 1), F.floor(share * digits))).otherwise(digit)
        cut = rows.join(extremes, [group, "__part"]).select(group, *order, value, (F.col("__part") * digits + digit).alias("__sub"), "__part")
        sizes = cut.groupBy(group, "__part", "__sub").agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__v"))
        before = Window.partitionBy(group, "__part").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
        summed = sizes.select(group, "__part", "__sub", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__front"),
                              F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__front_v"))
        inside = (F.col("__need") > F.col("__front")) & (F.col("__need") <= F.col("__front") + F.col("__n"))
        marks = stored(marks.join(summed, [group, "__part"]).filter(inside).select(
            group, "name", F.col("__sub").alias("__part"), (F.col("__need") - F.col("__front")).alias("__need"),
            (F.col("__sum") + F.col("__front_v")).alias("__sum"), "__n"))
        largest = marks.agg(F.max("__n")).first()[0] or 0
        marks = marks.drop("__n")
        rows = cut.select(group, *order, value, F.col("__sub").alias("__part")).join(marks.select(group, "__part").distinct(), [group, "__part"], "left_semi")
        if largest <= limit or largest == before_round:  # scores that are no numbers are not cut
            break
        rows, before_round = stored(rows), largest
    place = F.row_number().over(Window.partitionBy(group, "__part").orderBy(F.desc(order[0]), *order[1:]))
    met = marks.join(rows.withColumn("__place", place), [group, "__part"]).filter("__place <= __need")
    return met.groupBy(group, "name", "__sum").agg(F.sum(value).alias("__v")).select(group, "name", (F.col("__sum") + F.col("__v")).alias("best"))
