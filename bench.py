"""Benchmark: run the query catalogue at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's full plan is executed with the ``noop`` sink (every row is
produced, nothing is collected to the driver).  Prints one JSON line:
{"metric": ..., "value": total seconds of the headline queries, "unit":
"sec", "queries": {key: seconds}, "all_queries_sec": ..., "load_sec": ...,
"sf": ...}.  Set BENCH_QUERIES=all (default) or a comma list of keys.

The roster tables are built from the driver tables once (``load_sec``:
every table written as Parquet under the session's checkpoint folder,
``rosterkit.star.store=true``) and the queries read the stored tables, as
they would read a stored roster on a cluster.  BENCH_STORE=false runs
every query on the lazy builder instead (each query recomputes the
tables it reads from the line items).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["collaboration_catalog", "song_catalog", "collaboration_label_members",
            "delete_labels_collaborations", "contributor_requests_classified"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from rosterkit.catalog import QUERIES
    from rosterkit.plans import build_session, ensure_checkpoint_dir
    from rosterkit.sources.star import CONF_STORE, star_tables

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          app="rosterkit-bench")
    ensure_checkpoint_dir(spark)
    wanted = os.environ.get("BENCH_QUERIES", "all")
    keys = list(QUERIES) if wanted == "all" else [k.strip() for k in wanted.split(",") if k.strip()]
    # warm-up: JVM start, Parquet footers, code generation caches
    QUERIES["dashboard_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    load_sec = 0.0
    if os.environ.get("BENCH_STORE", "true").lower() == "true":
        spark.conf.set(CONF_STORE, "true")
        t0 = time.perf_counter()
        tables = star_tables(spark, sf_dir)
        for name in tables:
            tables[name]  # builds and writes the table
        load_sec = round(time.perf_counter() - t0, 3)

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for k in keys:
        t0 = time.perf_counter()
        try:
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as ex:  # noqa: BLE001 - one failing query must not hide the others
            failed[k] = f"{type(ex).__name__}: {str(ex)[:200]}"
            continue
        times[k] = round(time.perf_counter() - t0, 3)
    head = [k for k in HEADLINE if k in times]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total_sec",
        "value": round(sum(times[k] for k in head), 3),
        "unit": "sec",
        "queries": times,
        "all_queries_sec": round(sum(times.values()), 3),
        "load_sec": load_sec,
        "total_with_load_sec": round(sum(times.values()) + load_sec, 3),
        "headline": head,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
