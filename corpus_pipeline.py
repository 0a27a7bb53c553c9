"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake.llm import langid, mixing, near_text, packing, quality
from foldlake.llm.encoding import vocabulary_path
from foldlake.llm.queries import source_tree, table
from foldlake.session import stored

#: Part of the tokens that pass the filters which is packed. The most wanted domain has a quarter of them and shall have 40 %.
MIX_SHARE = 0.65


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in none of the languages of ``docs``: a null text, one without a letter, and one that scores
    far below what learned texts of its length do. Texts of a few words score as low as noise and are kept.
    """
    labelled = docs.filter(langid.bucket("doc_id", 5) != 0)
    model = langid.fit(labelled)
    named = langid.predict(docs, model, ("__lang", "__score"))
    return named.filter(langid.recognised(langid.floors(labelled, model), "__lang", "__score")).select(*docs.columns)


def rule_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that more likely have quality 0."""
    labels = table(spark, sf_dir, "labels").filter(langid.bucket("doc_id", 3) != 1)
    ensemble = quality.learn(docs, labels)
    return quality.predict(docs, ensemble, ("__score", "__predicted")).filter("__predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by Jaccard similarity of at least 0.8 of runs of five words."""
    return near_text.keep_one(docs)


def hierarchical_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings domains, languages and sources near their target weights; no document is taken twice."""
    return mixing.choose(docs, source_tree(), F.col("total") * MIX_SHARE, max_epochs=1)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("rule_quality", rule_quality),
    ("near_dedup", near_dedup),
    ("hierarchical_mix", hierarchical_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Language and quality are models fitted on the data and tokens come from a vocabulary; SQL cannot state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
