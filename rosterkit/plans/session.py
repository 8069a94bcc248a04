"""Session settings and the shared checkpoint folder.

The library never picks a machine-local folder on a cluster: lineage is
cut with ``DataFrame.checkpoint()`` into the folder the cluster names in
``spark.checkpoint.dir``.  Only a local-mode session (tests, bench) with
no such setting gets a fresh scratch folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the operators are written for.  AQE re-plans joins from
# runtime sizes (broadcast only below the threshold it measures), splits
# skewed shuffle partitions and coalesces small ones.
DEFAULT_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "rosterkit", extra: dict[str, str] | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, reading it from the session first.

    On a cluster the folder must be configured (a shared file system);
    only local mode falls back to a new scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder for checkpoints")
    folder = tempfile.mkdtemp(prefix="rosterkit-ckpt-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def scale_settings(input_bytes: int, total_cores: int,
                   partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Shuffle and scan settings sized for the input, for a cluster session.

    Shuffle partitions start at about one per ``partition_bytes`` of input
    (never fewer than two waves of tasks), so a hash partition of a full
    fact-sized shuffle stays near that size and fits an executor's memory
    without spilling much; AQE then coalesces small partitions to the same
    advisory size and splits skewed ones above five times the median.
    Scans read ``partition_bytes`` per task.  At 100 TB and 256 MB that is
    about 400,000 shuffle partitions before coalescing.
    """
    partitions = max(2 * total_cores, -(-input_bytes // partition_bytes))
    size = str(partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(partition_bytes // 8),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }
