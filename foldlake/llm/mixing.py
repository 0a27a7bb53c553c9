"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Documents belong to leaves of a tree (such as domain, language, source). A token budget is handed down from the root:
the children of a node get shares in proportion to their weights, but none gets more than the leaves under it can
supply (their tokens times the greatest number of epochs). What a child cannot take goes to its siblings, by their
weights, before it goes further up; since a node is never given more than it can supply, this is one pass from the top,
a water level per node found with window sums over its sorted children. All sums are whole numbers and exact.

A leaf's quota is a prefix of its epochs. Whole epochs take every document; of the last one, the prefix in the order of
a seeded hash is taken, its last document in part. The place of the cut is found from token sums per leading hash
digits: only documents of one small hash bucket per leaf are ever sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

NONE = "(none)"


@dataclass(frozen=True)
class Tree:
    """Levels from the top, each a name and a column of ``docs``, and a whole non-negative weight for each level's nodes.

    Weights are expressions over the level names, with those of a level and its ancestors in reach. Null names count as
    ``(none)``.
    """

    levels: dict[str, Column]
    weights: dict[str, Column] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return list(self.levels)


def words(text: str = "text") -> Column:
    """Tokens of a text: its words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("bigint")


def keyed(docs: DataFrame, tree: Tree, tokens: Column) -> DataFrame:
    """doc_id, the leaf's names and n_tokens of every row."""
    names = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in tree.levels.items()]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *names, tokens.cast("bigint").alias("n_tokens"))


def quotas(rows: DataFrame, tree: Tree, budget: Column, max_epochs: int) -> DataFrame:
    """The leaf's names, tokens (it has) and quota (it gives), for every leaf of ``rows``.

    ``budget`` is an expression over ``total``, the tokens of all leaves. The quotas add up to it, or to what all
    leaves of positive weight can supply.
    """
    names = tree.names
    weight = {n: f"w_{n}" for n in names}
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaves.select("*", *[tree.weights.get(n, F.lit(1)).cast("bigint").alias(w) for n, w in weight.items()])
    excluded = F.least(*[F.col(w) for w in weight.values()], F.lit(1)) <= 0
    leaves = leaves.withColumn("supply", F.when(excluded, 0).otherwise(F.col("tokens") * max_epochs).cast("decimal(38,0)"))

    root = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("supply"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    whole = root.select(F.least(F.col("supply"), F.floor(budget)).cast("bigint")).first()[0]
    given = None
    for depth, name in enumerate(names):
        path, above = names[:depth + 1], names[:depth]
        children = leaves.groupBy(*path).agg(F.max(weight[name]).alias("weight"), F.sum("supply").alias("supply"))
        met = children.join(given, above) if above else children.withColumn("quota", F.lit(whole).cast("decimal(38,0)"))
        given = _level(met, above, name)
    return leaves.join(given, names).select(*names, "tokens", F.col("quota").cast("bigint").alias("quota"))


def _level(children: DataFrame, above: list[str], name: str) -> DataFrame:
    """Share each parent's ``quota`` among its children by weight, none above its supply."""
    wide = "decimal(38,0)"
    by_need = Window.partitionBy(*above).orderBy(F.col("supply") / F.greatest("weight", F.lit(1)), name)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*above)
    zero = F.lit(0).cast(wide)
    asked = children.withColumn("weight", F.when(F.col("supply") > 0, F.col("weight")).otherwise(0).cast(wide))
    marked = asked.withColumn("filled", F.col("supply") * F.sum("weight").over(rest)
                              <= (F.col("quota") - F.coalesce(F.sum("supply").over(before), zero)) * F.col("weight"))
    marked = marked.withColumn("filled", F.col("filled") | (F.col("supply") == 0))
    level = marked.select(
        "*", F.sum(F.when(F.col("filled"), F.col("supply")).otherwise(zero)).over(whole).alias("taken"),
        F.sum(F.when(F.col("filled"), zero).otherwise(F.col("weight"))).over(whole).alias("open"))
    share = F.expr("CASE WHEN filled THEN supply ELSE cast(((quota - taken) * weight) div open AS decimal(38,0)) END")
    shared = level.withColumn("share", share)
    # Fewer units than open children are left by rounding down: one each, by name.
    by_name = Window.partitionBy(*above, "filled").orderBy(name)
    left = F.col("quota") - F.sum("share").over(whole)
    counted = shared.select("*", left.alias("left"), F.row_number().over(by_name).alias("turn"))
    extra = F.when(~F.col("filled") & (F.col("turn") <= F.col("left")), 1).otherwise(0)
    return counted.select(*above, name, (F.col("share") + extra).cast(wide).alias("quota"))


def _order(seed: int, epoch: str = "epochs") -> Column:
    """Place of a document in the epoch of its leaf that is taken in part."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)), F.col(epoch).cast("string")))


def _planned(rows: DataFrame, tree: Tree, budget: Column, max_epochs: int, seed: int, digits: int) -> tuple[DataFrame, DataFrame]:
    """Documents of the buckets that are cut, with their place, and the leaves' plan.

    The plan has, by leaf, epochs (whole ones), rest (tokens of the next), bucket (leading digits of the hashes between
    which the cut lies) and ahead (tokens of the hashes before). The bucket is narrowed by two digits at a time, so no
    more than 256 sums of a leaf are ever compared.
    """
    names = tree.names
    shares = quotas(rows, tree, budget, max_epochs)
    whole = shares.select(*names, F.expr("CASE WHEN tokens > 0 THEN quota div tokens ELSE 0 END").alias("epochs"),
                          F.expr("CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END").cast("bigint").alias("rest"))
    cut = stored(whole.withColumn("bucket", F.lit("")).withColumn("ahead", F.lit(0).cast("bigint")))
    plan = cut
    before = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    for width in range(2, digits + 1, 2):
        inside = _inside(rows, cut.filter("rest > 0"), names, seed)
        sums = inside.groupBy(*names, "epochs", "rest", "ahead", F.substring("order", 1, width).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        running = sums.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        cut = stored(running.filter("ahead < rest and rest <= ahead + n").select(*names, "epochs", "rest", "bucket", "ahead"))
    plan = stored(plan.select(*names, "epochs", "rest").join(cut.select(*names, "bucket", "ahead"), names, "left"))
    crossed = _inside(rows, cut, names, seed)
    upto = Window.partitionBy(*names).orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = crossed.withColumn("start", F.sum("n_tokens").over(upto) - F.col("n_tokens") + F.col("ahead"))
    return placed.filter("start < rest"), plan


def _inside(rows: DataFrame, cut: DataFrame, names: list[str], seed: int) -> DataFrame:
    """Rows of the buckets in ``cut``, with their ``order``."""
    met = rows.join(cut, names).withColumn("order", _order(seed))
    return met.filter(F.col("order").startswith(F.col("bucket")))


def mix(docs: DataFrame, tree: Tree, budget: Column, max_epochs: int = 4, tokens: Column | None = None, seed: int = 42,
        digits: int = 4) -> DataFrame:
    """doc_id, the leaf's names, epoch (from 0), n_tokens and take_tokens of every document taken, once per epoch.

    take_tokens is smaller than n_tokens only for the last document of a leaf's quota. Null texts have no tokens; null
    and repeated doc_ids are rows like any other; documents without tokens are taken with their epoch. Leaves of weight
    0 give nothing. An empty table gives no rows. Columns of ``docs`` other than those the tree names are not read.
    """
    names = tree.names
    rows = stored(keyed(docs, tree, words() if tokens is None else tokens))
    placed, plan = _planned(rows, tree, budget, max_epochs, seed, digits)
    out = ["doc_id", *names, "epoch", "n_tokens", "take_tokens"]
    joined = rows.join(plan.filter("epochs > 0 or bucket is not null"), names)
    whole = joined.filter("epochs > 0").select("*", F.explode(F.expr("sequence(0, cast(epochs as int) - 1)")).alias("epoch"), F.col("n_tokens").alias("take_tokens"))
    first = joined.filter("bucket is not null").filter(F.substring(_order(seed), 1, digits) < F.col("bucket")).select(
        "*", F.col("epochs").cast("int").alias("epoch"), F.col("n_tokens").alias("take_tokens"))
    last = placed.select("*", F.col("epochs").cast("int").alias("epoch"), F.least("n_tokens", F.col("rest") - F.col("start")).alias("take_tokens"))
    return whole.select(*out).union(first.select(*out)).union(last.select(*out))


def choose(docs: DataFrame, tree: Tree, budget: Column, max_epochs: int = 1, tokens: Column | None = None, seed: int = 42,
           digits: int = 4) -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes, whole, with all their columns, once per epoch in which they are taken.

    The text of a document at the end of a quota is not cut. Repeated rows at the cut stay together. Only the plan of
    the leaves is joined to the texts.
    """
    names = tree.names
    tokens = words() if tokens is None else tokens
    rows = stored(keyed(docs, tree, tokens))
    placed, plan = _planned(rows, tree, budget, max_epochs, seed, digits)
    cut = placed.groupBy(*names).agg(F.max(F.struct("order", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("cut"))
    cut = plan.join(cut, names, "left").filter("epochs > 0 or cut is not null")
    cut = stored(cut.select(*[F.col(n).alias(f"__{n}") for n in names], F.col("epochs").alias("__epochs"), F.col("cut").alias("__cut")))
    leaf = [F.coalesce(c.cast("string"), F.lit(NONE)) == F.col(f"__{n}") for n, c in tree.levels.items()]
    met = docs.join(cut, leaf)
    place = F.struct(_order(seed, "__epochs").alias("order"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"))
    times = F.col("__epochs").cast("int") + F.when(F.col("__cut").isNotNull() & (place <= F.col("__cut")), 1).otherwise(0)
    if max_epochs == 1:
        return met.filter(times > 0).select(*docs.columns)
    return met.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), times)).alias("__once")).drop("__once")
