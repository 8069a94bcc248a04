"""Every catalogue key against its DuckDB oracle on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from rosterkit.catalog import QUERIES

SF = os.environ.get("ROSTERKIT_TEST_SF", "/root/testdata/sf0.001")
KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_key_has_an_oracle():
    assert set(KEYS) <= set(entry.queries()) and set(KEYS) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    ok, n_spark, n_duck, _, detail = compare(spark, con, key, entry.queries()[key],
                                             entry.oracle_sql()[key], SF)
    assert ok, detail


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["SongID", "Title", "Duration", "ReleaseDate", "Genres", "Contributors",
                          "CollaborationName"]
    assert df.count() >= 0
