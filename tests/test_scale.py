"""What keeps one task, or one job, small: rows per task, posting lists in blocks, tables read as stored."""

import tempfile

import __spark_entry__ as entry
from pyspark.sql import functions as F

from rosterkit.operators import trigrams
from rosterkit.sources import star

SF = "/root/testdata/sf0.001"


def test_links_are_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(star, "TASK_ROWS", 500)
    t = star.star_tables(spark, SF, fresh=True)
    lines = star.read_driver(spark, SF)["lineitem"].count()
    want = -(-lines // 500)
    assert want > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("RLC_raw", "RecordLabel_Collaboration", "Collaboration_Contributor"):
        assert t[name].rdd.getNumPartitions() == want, name
    monkeypatch.undo()
    star.star_tables(spark, SF, fresh=True)


def test_label_links_of_repeated_and_null_keys(spark, tmp_path):
    made = {
        "customer": ([(1, 5), (1, 6), (2, None), (None, 7)], "c_custkey long, c_nationkey int"),
        "supplier": ([(1, 5), (2, 6), (2, 8), (3, None), (None, 9)], "s_suppkey long, s_nationkey int"),
        "orders": ([(10, 1), (10, 2), (11, 2), (12, None), (None, 1), (13, 1), (13, 1)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(10, 1), (10, 2), (10, 2), (11, 3), (12, 1), (None, 1), (13, None), (13, 3), (14, 1)],
                     "l_orderkey long, l_suppkey long"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    want = {(n1, n2, o) for lo, ls in made["lineitem"][0] for o, oc in made["orders"][0] if lo is not None and lo == o
            for c, n1 in made["customer"][0] if c is not None and c == oc
            for s, n2 in made["supplier"][0] if s is not None and s == ls}
    got = [tuple(r) for r in star.star_tables(spark, str(tmp_path), fresh=True)["RLC_raw"].collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_posting_lists_are_made_in_blocks(spark, monkeypatch):
    texts = [f"Customer {i % 7}, Customer {i}" for i in range(300)] + ["é\U0001f600 ü\0x", "ab", None, "İStanbul" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    low = {r[0]: r[1] for r in df.select("id", F.lower("text")).collect() if r[1] is not None}
    want = sorted({(x[i:i + 3], k) for k, x in low.items() for i in range(len(x) - 2)})
    assert sorted(map(tuple, trigrams.postings(df, "id", "text").collect())) == want
    made = trigrams.blocks(df, "id", "text")
    assert made.count() == len({g for g, _ in want})  # one batch: one row per run
    # a batch of many bytes is cut, and loses nothing
    monkeypatch.setattr(trigrams, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, trigrams.postings(df, "id", "text").collect())) == want
    assert trigrams.blocks(df, "id", "text").count() > made.count()
    index = trigrams.write_postings(df, "id", "text", tempfile.mkdtemp(prefix="rk-tri-", dir="/tmp") + "/i")
    assert sorted(map(tuple, index.collect())) == want


def test_what_follows_a_change_reads_stored_tables(spark):
    for key in ("purge_after_updates", "collaboration_catalog_refreshed"):
        read = entry.queries()[key](spark, SF).inputFiles()
        assert not any("lineitem.parquet" in f for f in read), key


def test_trigram_search_reads_the_stored_lists(spark):
    read = entry.queries()["contributor_list_trigrams"](spark, SF).inputFiles()
    assert read and not any("lineitem.parquet" in f for f in read)
