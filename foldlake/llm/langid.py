"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point, and so does the place between words. An
n-gram's vector binds its letters, each permuted by its place (rotated by the number of letters after it, then
multiplied). A text's vector bundles (adds) its n-grams, a language's prototype the unit vectors of its texts. A text
gets the language whose prototype has the highest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

UNKNOWN = "und"
_BITS = 21  # of a letter's number inside an n-gram's code


@dataclass
class Letters:
    """Random vectors of the letters met so far; the vector of a letter does not depend on the order of meeting."""

    dims: int
    seed: int
    number: np.ndarray = field(default_factory=lambda: np.full(0x110000, -1, dtype=np.int32))  # -1: not met, 0: no letter
    rows: int = 0

    def __post_init__(self):
        self.vectors = np.empty((64, self.dims), dtype=np.int8)
        self._add(0x110000)  # between words

    def _add(self, code: int) -> int:
        if self.rows == len(self.vectors):
            self.vectors = np.vstack([self.vectors, np.empty_like(self.vectors)])
        bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims, dtype=np.int8)
        self.vectors[self.rows] = bits * 2 - 1
        self.rows += 1
        return self.rows - 1

    def numbers(self, text: str) -> np.ndarray:
        """The lower-cased text as letter numbers; what is no letter is 0."""
        codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
        found = self.number[codes]
        if (found < 0).any():
            for code in np.unique(codes[found < 0]).tolist():
                self.number[code] = self._add(code) if chr(code).isalpha() else 0
            found = self.number[codes]
        return found


class Profiles:
    """Vectors of whole texts."""

    def __init__(self, dims: int, n: int, seed: int):
        self.dims, self.n = dims, n
        self.letters = Letters(dims, seed)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams (n rows of letter numbers) and their counts; words end with one 0, none without a letter."""
        found = self.letters.numbers(text)
        letter = found != 0
        if not letter.any():
            return np.empty((self.n, 0), np.int64), np.empty(0)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of several other signs the first stays
        line = np.zeros(int(keep.sum()) + 2, dtype=np.int64)
        line[1:-1] = found[keep]
        if len(line) < self.n:
            line = np.append(line, np.zeros(self.n - len(line), dtype=np.int64))
        count = len(line) - self.n + 1
        if self.n * _BITS < 64:
            codes = line[:count]
            for k in range(1, self.n):
                codes = codes << _BITS | line[k:k + count]
            codes = np.sort(codes)
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            times = np.diff(np.append(first, count))
            mask = (1 << _BITS) - 1
            return np.stack([codes[first] >> _BITS * (self.n - 1 - k) & mask for k in range(self.n)]), times
        windows = np.stack([line[k:k + count] for k in range(self.n)])
        rows, times = np.unique(windows, axis=1, return_counts=True)
        return rows, times

    def vector(self, text: str, step: int = 4096) -> np.ndarray | None:
        """The bundle of the text's n-grams; None without a letter."""
        grams, times = self.grams(text)
        if not len(times):
            return None
        total = np.zeros(self.dims, dtype=np.float32)
        turned = [np.roll(self.letters.vectors[:self.letters.rows], self.n - 1 - k, axis=1) for k in range(self.n)]
        for first in range(0, len(times), step):
            part = slice(first, first + step)
            bound = turned[0][grams[0, part]]
            for k in range(1, self.n):
                bound = bound * turned[k][grams[k, part]]
            total += times[part].astype(np.float32) @ bound.astype(np.float32)
        return total


@dataclass(frozen=True)
class Model:
    """Unit prototypes of the learned languages."""

    languages: list[str]
    prototypes: np.ndarray
    dims: int
    n: int
    seed: int


def _learned(labelled: DataFrame) -> DataFrame:
    """lang, text of the rows that teach: all that have both."""
    return labelled.filter("lang is not null and text is not null").select("lang", "text")


def fit(labelled: DataFrame, dims: int = 1024, n: int = 3, seed: int = 11) -> Model:
    """Prototypes from ``labelled`` (text, lang): all rows, whole texts.

    Rows without a language or text teach nothing; without any, the model knows no language. Texts stay where they are
    read; a task gives one sum per language, and sums meet in 64 tasks before they reach the driver.
    """
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dims, n, seed), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vector = profiles.vector(text)
                if vector is not None and (size := np.linalg.norm(vector)):
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64) / size
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for lang, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[lang] = sums.get(lang, 0) + v.values.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    made = _learned(labelled).mapInArrow(bundle, "lang string, v array<double>")
    sums: dict[str, np.ndarray] = {}
    for row in made.repartition(64).mapInArrow(add, "lang string, v array<double>").collect():  # 64 sums per language at most
        sums[row["lang"]] = sums.get(row["lang"], 0) + np.array(row["v"])
    languages = sorted(sums)
    prototypes = np.array([sums[lang] / np.linalg.norm(sums[lang]) for lang in languages]).reshape(len(languages), dims)
    return Model(languages, prototypes, dims, n, seed)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``names``: the language and the score (the cosine, at least 0) of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. Equal cosines go to the
    first language by name. Only ``text`` is read for the prediction; all columns stay. An empty table gives no rows;
    columns already called so are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        profiles, prototypes = Profiles(model.dims, model.n, model.seed), model.prototypes.astype(np.float32)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                vector = profiles.vector(text) if text and model.languages else None
                if vector is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = prototypes @ vector / max(float(np.linalg.norm(vector)), 1e-9)
                best = int(np.argmax(cosines))
                langs.append(model.languages[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names])

    kept = docs.drop(*names)
    schema = StructType([*kept.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return kept.mapInArrow(run, schema)


#: Characters from which a score tells a language from noise.
SHORT = 64


def _length_class(text: str) -> Column:
    """The binary logarithm of the number of characters, rounded down."""
    return F.floor(F.log2(F.greatest(F.length(text), F.lit(1)))).cast("int")


def floors(labelled: DataFrame, model: Model, quantile: float = 0.01, part: float = 0.5) -> dict[int, float]:
    """By length class, the score under which a text is in none of the learned languages.

    That is ``part`` of the ``quantile`` of the scores of learned texts of that length. Texts under SHORT characters have
    no floor: a few clean words score as low as noise does. Without learned rows there is none at all.
    """
    scored = predict(_learned(labelled), model, ("__lang", "__score")).filter(F.length("text") >= SHORT)
    found = scored.groupBy(_length_class("text").alias("k")).agg(F.percentile_approx("__score", quantile, 10_000).alias("q")).collect()  # a row per class
    return {r["k"]: part * r["q"] for r in found}


def recognised(floor: dict[int, float], lang: str = "lang_pred", score: str = "score", text: str = "text") -> Column:
    """Whether a predicted text has a letter and reaches the floor of its length, where there is one."""
    known = F.col(lang) != UNKNOWN
    if not floor:
        return known
    least = F.try_element_at(F.create_map(*[F.lit(x) for pair in floor.items() for x in pair]), _length_class(text))
    return known & (F.col(score) >= F.when(F.length(text) >= SHORT, F.coalesce(least, F.lit(0.0))).otherwise(0.0))


def bucket(doc_id: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text) % buckets


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the model learns from the rows of the other folds than 0 only."""
    held_out = bucket("doc_id", folds) == 0
    model = fit(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
