"""Registered corpus queries: their SQL where there is some, and the columns each must return."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from foldlake.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op2_": "doc_id held_out lang_pred score", "op4_": "doc_id held_out score predicted",
    "op5_": "doc_id n_words n_base first_word last_word base_labels labels score", "op6_": "doc_id fingerprint component_id",
    "op7_": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_": "page_id url text n_chars", "op10_": "query_id rank vec_id score",
    "op11_": "anchor_id positive_id rank negative_id positive_score negative_score", "op12_": "item_id rank doc_id score",
    "op13_": "query_id rank vec_id score",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    line = compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert line.startswith("ok"), line


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("prefix", sorted(COLUMNS))
def test_columns(spark, sf_dir, prefix):
    name = next(n for n in QUERIES if n.startswith(prefix))
    assert set(COLUMNS[prefix].split()) <= set(QUERIES[name](spark, sf_dir).columns)
