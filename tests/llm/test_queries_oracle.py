"""Registered queries with SQL against DuckDB on the smallest driver tables."""

import os

import pytest

from oracle import compare, duck
from rosterkit.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("ROSTERKIT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, key):
    ok, _, _, _, detail = compare(spark, con, key, QUERIES[key], ORACLE_SQL[key], SF)
    assert ok, detail


def test_one_query_each():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
