"""Stateless request intake: JSON files in, accepted requests and rejects out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.requests import parsed, split_parsed


def request_stream(spark: SparkSession, path: str, entity: str,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of requests from new JSON-lines files under ``path``, with their file and malformed lines."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parsed(reader.text(path).select("value", F.col("_metadata.file_name").alias("file")), entity)


def start_intake(spark: SparkSession, in_path: str, out_path: str, entity: str,
                 checkpoint_location: str, available_now: bool = False) -> StreamingQuery:
    """Append checked requests to ``out_path/accepted`` and rejects to ``out_path/rejects``.

    Each micro-batch is split once (a persisted batch, released after both
    writes).  The stream keeps its progress in ``checkpoint_location``
    (a shared folder), so a restarted driver resumes where it stopped and
    a micro-batch is never half-applied: both sinks are idempotent appends
    keyed by the batch id folder.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good, bad = split_parsed(batch, entity)
        good.write.mode("overwrite").parquet(f"{out_path}/accepted/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{out_path}/rejects/batch={batch_id}")
        batch.unpersist()

    writer = (request_stream(spark, in_path, entity).writeStream
              .foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    return writer.start()
