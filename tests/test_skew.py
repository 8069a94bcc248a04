"""The hot-key split changes plans, never results.

Each query runs twice on the smallest driver tables: with the split
turned off, and with a threshold so low that most keys are hot and get
several buckets.  The row multisets must be equal.
"""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rosterkit.operators.joins import join_to_unique

SF = "/root/testdata/sf0.001"
KEYS = ["song_catalog", "collaboration_catalog", "employee_directory", "contributor_directory",
        "song_search", "contributor_requests_classified", "apply_conflict_policy",
        "create_songs_links", "resolve_contributor_tokens", "delete_labels_persons",
        "delete_songs_collaborations", "delete_contributors_songs",
        "delete_contributors_collaborations", "update_songs_genres",
        "update_collaborations_contributors", "qc_fk_song_genre"]


def _rows(spark, key):
    df = entry.queries()[key](spark, SF)
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_split_keeps_results(spark, key):
    try:
        spark.conf.set("rosterkit.skew.enabled", "false")
        plain = _rows(spark, key)
        spark.conf.set("rosterkit.skew.enabled", "true")
        spark.conf.set("rosterkit.skew.hotRows", "3")
        split = _rows(spark, key)
    finally:
        for k in ("rosterkit.skew.enabled", "rosterkit.skew.hotRows"):
            spark.conf.unset(k)
    assert split == plain


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_null_and_hot_keys_are_spread(spark, how):
    """Half the rows under NULL, half under one key: no partition holds twice the mean."""
    big = spark.range(40000).selectExpr("case when id % 2 = 0 then 7 end k", "id v")
    unique = spark.createDataFrame([(7, "x"), (8, "y")], "k int, w string")
    if how in ("left_semi", "left_anti"):
        unique = unique.select("k")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                          "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        out = join_to_unique(big, unique, "k", how, hot_rows=400)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    rows = {"inner": 20000, "left": 40000, "left_semi": 20000, "left_anti": 20000}[how]
    assert sum(sizes) == rows
    assert len(sizes) >= 20 and max(sizes) <= 4 * rows / len(sizes)
