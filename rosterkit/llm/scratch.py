"""Tables written to the shared checkpoint folder to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.session import ensure_checkpoint_dir

#: Spark's setting to remove the shuffle files of a query at its end
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A new folder of Parquet tables under ``spark.checkpoint.dir``.

    A table kept here is computed once, is read back with column pruning
    and survives the loss of any executor.  Joins of two kept tables are
    plain shuffles on both sides, which AQE can split at a hot key.  If
    ``tidy``, the shuffle files of a table go once it is written.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark = spark
        self.tidy = tidy
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is not None:
                self.spark.conf.set(CLEANUP, before)
            elif self.tidy:
                self.spark.conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
