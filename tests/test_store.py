"""Stored roster tables (``rosterkit.star.store=true``) change where queries read, never results.

Every query key runs on the lazy builder and on the tables written once
under the checkpoint folder; the row multisets and schemas must be equal.
Filters must then reach the stored table's Parquet scan.
"""

import pytest

import __spark_entry__ as entry
from rosterkit.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def _run(spark, key, store):
    try:
        spark.conf.set("rosterkit.star.store", store)
        df = entry.queries()[key](spark, SF)
        return df.schema.simpleString(), sorted((tuple(r) for r in df.collect()), key=repr)
    finally:
        spark.conf.unset("rosterkit.star.store")


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_store_keeps_results(spark, key):
    assert _run(spark, key, "false") == _run(spark, key, "true")


def test_store_reads_written_tables_with_pushdown(spark):
    try:
        spark.conf.set("rosterkit.star.store", "true")
        df = entry.queries()["song_duration_range"](spark, SF)
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("rosterkit.star.store")
    assert "roster-" in text
    assert "l_orderkey" not in text and "p_partkey" not in text
    # the duration bounds reach the scan of the stored Song table, which reads two columns
    assert "PushedFilters: [IsNotNull(Duration), GreaterThanOrEqual(Duration,100)" in text
    assert "ReadSchema: struct<SongID:bigint,Duration:int>" in text
