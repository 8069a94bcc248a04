"""Sources and sinks: typed load and versioned publish, JSON requests, streaming intake."""

import json
import tempfile

from rosterkit.operators import views
from rosterkit.operators.records import write_records
from rosterkit.sources import publish, read_tables
from rosterkit.sources.requests import read_requests
from rosterkit.streaming import start_intake


def test_publish_and_read_back(spark, loaded):
    path = tempfile.mkdtemp(prefix="rk-pub-", dir="/tmp")
    written = publish(loaded, f"{path}/v1")
    assert len(written) == 14
    back = read_tables(spark, f"{path}/v1")
    assert back["Song"].dtypes == loaded["Song"].dtypes
    assert views.dashboard_counts(back).first() == views.dashboard_counts(loaded).first()


def test_csv_load_with_fixed_schema(spark, loaded):
    path = tempfile.mkdtemp(prefix="rk-csv-", dir="/tmp")
    loaded["Song"].write.option("header", "true").csv(f"{path}/Song")
    back = read_tables(spark, path, fmt="csv", tables=["Song"])
    assert back["Song"].dtypes == loaded["Song"].dtypes
    assert back["Song"].count() == 5


def _write_json(rows):
    path = tempfile.mkdtemp(prefix="rk-req-", dir="/tmp")
    with open(f"{path}/part-0.json", "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    return path


REQS = [{"seq": 1, "NIF": " P100 ", "Name": " Zoe ", "Roles": "Artist"},
        {"seq": 2, "NIF": "P101", "Name": "", "Roles": "Producer"},
        {"seq": 3, "Name": "No Nif", "Roles": "Artist"}]


def test_read_requests(spark):
    good, bad = read_requests(spark, _write_json(REQS), "contributor")
    assert [(r.seq, r.NIF, r.Name) for r in good.collect()] == [(1, "P100", "Zoe")]
    assert sorted((r.seq, r.reason) for r in bad.collect()) == [
        (2, "Missing required fields: Name"), (3, "Missing required fields: NIF")]


def test_streaming_intake(spark):
    src = _write_json(REQS)
    out = tempfile.mkdtemp(prefix="rk-out-", dir="/tmp")
    ckpt = tempfile.mkdtemp(prefix="rk-sck-", dir="/tmp")
    q = start_intake(spark, src, out, "contributor", ckpt, available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{out}/accepted").count() == 1
    assert spark.read.parquet(f"{out}/rejects").count() == 2


def test_write_records(spark, loaded):
    path = tempfile.mkdtemp(prefix="rk-rec-", dir="/tmp")
    write_records(views.collaboration_catalog(loaded), "collaboration", f"{path}/c")
    rows = spark.read.json(f"{path}/c").collect()
    assert len(rows) == 4
