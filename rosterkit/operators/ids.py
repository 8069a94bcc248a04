"""WR-1: gap-free surrogate ids after the current maximum, in request order.

``row_number() OVER (ORDER BY seq)`` would move every row into one task.
Instead the batch is range-partitioned on the order keys and sorted
inside each partition, the position of a row inside its partition is
read from ``monotonically_increasing_id`` (no shuffle), and a prefix sum
over the per-partition counts (one row per partition, a proven small
table) gives each partition its offset.

Range bounds come from sampling, so the partitioned batch is
checkpointed (reliably, into ``spark.checkpoint.dir``) before it is read
twice; a recomputation after a lost executor then sees the same rows in
the same partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir

_POS_MASK = (1 << 33) - 1


def max_id(df: DataFrame, col: str) -> DataFrame:
    """One-row DataFrame ``_base`` = max(col), 0 for an empty table."""
    return df.agg(F.coalesce(F.max(col).cast("bigint"), F.lit(0).cast("bigint")).alias("_base"))


def assign_ids(batch: DataFrame, id_col: str, order_by: list[str], base: DataFrame | int,
               num_partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = base + 1, base + 2, … following ``order_by``.

    ``order_by`` must be a total order of the batch (e.g. a unique ``seq``).
    ``base`` is an int or a one-row DataFrame with column ``_base``.
    """
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = (batch.repartitionByRange(n, *order_by)
              .sortWithinPartitions(*order_by)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK))))
    ranked = ranked.checkpoint(eager=True)
    # One row per partition: a bounded table, so the single-partition
    # window and the broadcast below stay small at any batch size.
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_off"))
    if isinstance(base, DataFrame):
        offsets = offsets.crossJoin(base.select("_base"))
    else:
        offsets = offsets.withColumn("_base", F.lit(int(base)).cast("bigint"))
    out = ranked.join(F.broadcast(offsets), "_pid")
    return out.withColumn(id_col, F.col("_base") + F.col("_off") + F.col("_pos") + 1).drop(
        "_pid", "_pos", "_off", "_base")
