"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on statistics of labelled texts. Every path from a root is a rule, a conjunction of comparisons. A
logistic regression with an L1 penalty weighs the rules and drops most of them; the rest are compiled into one Spark
column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import stored
from .langid import bucket

#: Statistics of a text, in the order `statistics` returns them.
NAMES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "stop", "bang", "space", "beyond_ascii",
    "distinct_words", "distinct_shingles", "distinct_lines", "line_length", "marked_words",
)
#: Begins the names of their columns.
PREFIX = "__q_"
_LOWER, _UPPER, _DIGIT, _SYMBOL, _STOP, _BANG, _SPACE, _LEAD, _TAIL = range(9)


def _classes() -> np.ndarray:
    kind = np.full(256, _SYMBOL, dtype=np.uint8)
    kind[ord("a"):ord("z") + 1], kind[ord("A"):ord("Z") + 1], kind[ord("0"):ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    kind[[ord(c) for c in ".,;:?'\"()-"]], kind[ord("!")] = _STOP, _BANG
    kind[[*range(9, 14), 32]] = _SPACE
    kind[0xC0:], kind[0x80:0xC0] = _LEAD, _TAIL
    return kind


_KIND = _classes()


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of one whole text; all 0 for an empty one."""
    if not text:
        return (0.0,) * len(NAMES)
    seen = np.bincount(_KIND[np.frombuffer(text.encode(), dtype=np.uint8)], minlength=9).tolist()
    chars, words, lines = len(text), text.split(), text.split("\n")
    letters = max(1, seen[_LOWER] + seen[_UPPER] + seen[_LEAD])
    count = max(1, len(words))
    shingles = max(1, len(words) - 2)
    marked = sum(not w[-1].isalnum() and not w[-1] in ".,;:?'\"()-" for w in words)
    return (
        float(np.log1p(chars)), float(np.log1p(len(words))), sum(map(len, words)) / count, seen[_UPPER] / letters, seen[_DIGIT] / chars,
        seen[_SYMBOL] / chars, seen[_STOP] / chars, seen[_BANG] / chars, seen[_SPACE] / chars, seen[_LEAD] / chars,
        len(set(words)) / count, len(set(zip(words, words[1:], words[2:]))) / shingles if len(words) > 2 else 1.0,
        len(set(lines)) / len(lines), chars / len(lines), marked / count,
    )


def with_statistics(docs: DataFrame, drop_text: bool = False) -> DataFrame:
    """``docs`` with a column ``PREFIX`` + name for each statistic of ``text`` (null: empty)."""
    kept = docs.drop(*[f"{PREFIX}{n}" for n in NAMES])
    names = [c for c in kept.columns if not (drop_text and c == "text")]
    schema = StructType([*[kept.schema[c] for c in names], *[StructField(f"{PREFIX}{n}", DoubleType()) for n in NAMES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column("text").to_pylist()]
            columns = [pa.array(c, pa.float64()) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * len(NAMES)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], names=schema.names)

    return kept.mapInArrow(run, schema)


# ---------------------------------------------------------------- rules

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is above, threshold), all of which hold


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; the probability of label 1 is the logistic of their sum."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """The probability as an expression over the columns of the statistics."""
        total = reduce(lambda a, b: a + b, [F.when(condition(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-total))


def condition(rule: Rule) -> Column:
    def one(part: tuple[int, bool, float]) -> Column:
        column = F.col(f"{PREFIX}{NAMES[part[0]]}")
        return column > part[2] if part[1] else column <= part[2]

    return reduce(and_, map(one, rule))


def _paths(node, above: dict) -> Iterator[Rule]:
    """Rules of all nodes below ``node``; of several thresholds of one side the tightest stays."""
    if node.getClass().getSimpleName() != "InternalNode":
        return
    split = node.split()
    index, threshold = split.featureIndex(), split.threshold()
    for right, child in ((False, node.leftChild()), (True, node.rightChild())):
        held = dict(above)
        known = held.get((index, right))
        held[index, right] = threshold if known is None else max(known, threshold) if right else min(known, threshold)
        yield tuple(sorted((i, r, t) for (i, r), t in held.items()))
        yield from _paths(child, held)


def fit(labelled: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.0005, seed: int = 5) -> Ensemble:
    """Rules and weights from ``labelled``: the statistics and ``label`` 0.0 or 1.0.

    With no rows, or one label only, there are no rules and the score is 0.5, or near that label.
    """
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Ensemble((), 0.0 if not counts else 6.0 if 1.0 in counts else -6.0)
    columns = [f"{PREFIX}{n}" for n in NAMES]
    table = VectorAssembler(inputCols=columns, outputCol="statistics").transform(labelled.select("label", *columns))
    forest = RandomForestClassifier(labelCol="label", featuresCol="statistics", numTrees=trees, maxDepth=depth, maxBins=64,
                                    featureSubsetStrategy="0.5", seed=seed).fit(table)
    rules = sorted({rule for tree in forest.trees for rule in _paths(tree._call_java("rootNode"), {})})
    if not rules:
        share = counts[1.0] / sum(counts.values())
        return Ensemble((), float(np.log(share / (1 - share))))
    held = labelled.select("label", *[condition(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    table = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="rules").transform(held).select("label", "rules")
    weights = LogisticRegression(labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=penalty, standardization=False,
                                 maxIter=60).fit(table)
    chosen = tuple((rule, float(w)) for rule, w in zip(rules, weights.coefficients.toArray()) if abs(w) > 1e-6)
    return Ensemble(chosen, float(weights.intercept))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ensemble:
    """Fit on all labelled documents.

    ``labels`` has doc_id and ``label``; rows without either, and ids that no document has, teach nothing. An id
    with several labels is taken at its largest. Texts become statistics where they are read; only those meet the labels.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    chosen = known.groupBy("doc_id").agg(F.max(F.col(label)).cast("double").alias("label"))
    return fit(stored(with_statistics(docs.select("doc_id", "text"), drop_text=True).join(chosen, "doc_id")))


def predict(docs: DataFrame, ensemble: Ensemble, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``names``: the score (0 to 1), and 1 if it is 0.5 or more, else 0.

    Null texts count as empty; empty texts are scored by their statistics (all 0). An empty table gives no rows.
    Columns already called so are replaced, other columns stay.
    """
    kept = docs.drop(*names)
    scored = with_statistics(kept).withColumn(names[0], ensemble.score())
    return scored.select(*kept.columns, names[0], F.when(F.col(names[0]) >= 0.5, 1).otherwise(0).alias(names[1]))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of fold ``held`` are not learned."""
    ensemble = learn(docs, labels.filter(bucket("doc_id", folds) != held))
    held_out = (bucket("doc_id", folds) == held).alias("held_out")
    return predict(docs.select("doc_id", "text"), ensemble).select("doc_id", held_out, "score", "predicted")
