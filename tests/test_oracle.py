"""Every registered query against its SQL on DuckDB."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from foldlake.plans import load_all
from foldlake.plans.registry import ORACLES, QUERIES

load_all()  # the corpus queries have tests of their own


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    line = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert line.startswith(("ok", "rows-only")), line


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
