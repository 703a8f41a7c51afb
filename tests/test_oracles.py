"""Every registered query against its DuckDB counterpart."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import compare
from checks.oracles import SQL
from checks.registry import QUERIES

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(queries()))
def test_matches_duckdb(spark, duck, sf_dir, name):
    message, rows, _, _ = compare.check(spark, duck, name, queries()[name], ORACLES.get(name), sf_dir)
    assert message is None
    assert rows > 0 or name in ("q6_orphan_rules",)


def test_every_query_has_an_oracle():
    """Of the library's own queries; which optional ones have one is for their own tests to say."""
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry(spark).count() > 0
