"""Joining a possibly skewed side to a side with one row per key.

A link or fan-out table may hold a third of its rows under one key (a
prolific contributor, a song used by many collaborations).  Joined to
the table that has one row per key, that key becomes one straggler task.
AQE can split such a partition only when both join inputs are plain
shuffle stages, which a side built from co-partitioned joins and
aggregates is not; so the split is written out:

1. count rows per key on the big side (partial counts on the map side);
   a key is hot from ``hot_rows`` rows on and gets ``ceil(n / hot_rows)``
   buckets, however many that are;
2. big-side rows of a hot key are spread over its buckets by a hash of
   the row, rows with a NULL key (which match nothing) over all
   partitions, and every other row goes to bucket 0;
3. the single row of a hot key on the unique side is copied once per
   bucket; every other key keeps one copy in bucket 0;
4. the join runs on (key, bucket).

The hot-key table has one row per hot key, at most ``rows / hot_rows``
rows; Spark's runtime size check (AQE) decides whether it is broadcast.
No row is dropped or sampled: every big-side row meets exactly the one
unique row of its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default: a key is hot from one million rows on.
HOT_ROWS = 1_000_000
CONF_HOT_ROWS = "rosterkit.skew.hotRows"
CONF_ENABLED = "rosterkit.skew.enabled"  # "false": plain joins, for data known to be even


def _setting(df: DataFrame, key: str, default: int) -> int:
    value = df.sparkSession.conf.get(key, None)
    return int(value) if value else default


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(big: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """(keys…, _buckets) for keys, NULL apart, holding at least ``hot_rows`` rows of ``big``."""
    known = big.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") >= hot_rows).select(
        *keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_buckets"))


def join_to_unique(big: DataFrame, unique: DataFrame, on: str | list[str], how: str = "inner",
                   hot_rows: int | None = None) -> DataFrame:
    """``big.join(unique, on, how)`` where ``unique`` has at most one row per key.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti`` (``big``
    is the left side; for the last two ``unique`` is a set of keys).  Hot
    keys of ``big`` are split over buckets as described in the module text.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how must be 'inner', 'left', 'left_semi' or 'left_anti'")
    keys = [on] if isinstance(on, str) else list(on)
    if (big.sparkSession.conf.get(CONF_ENABLED, "true") or "true").lower() == "false":
        return big.join(unique, keys, how)
    hot = hot_keys(big, keys, hot_rows or _setting(big, CONF_HOT_ROWS, HOT_ROWS))

    # each step is one projection, so the plan stays small for the analyzer
    row_hash = F.xxhash64(*[F.col(c) for c in big.columns])
    no_key = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    b = big.join(hot, keys, "left").select(
        *big.columns, F.when(no_key, F.pmod(row_hash, F.lit(_partitions(big))).cast("int"))
        .when(F.col("_buckets").isNull(), F.lit(0))
        .otherwise(F.pmod(row_hash, F.col("_buckets")).cast("int")).alias("_bucket"))
    u = unique.join(hot, keys, "left").select(
        *unique.columns, F.explode(F.when(F.col("_buckets").isNull(), F.array(F.lit(0)))
                                   .otherwise(F.sequence(F.lit(0), F.col("_buckets") - 1)))
        .alias("_bucket"))
    return b.join(u, keys + ["_bucket"], how).drop("_bucket")
