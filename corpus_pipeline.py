"""Training-data pipeline over ``documents``: rules, near duplicates, leaks, mix, shards.

Each stage works on all that the one before it kept; its result is written
as Parquet under the shared checkpoint folder and read again.  The first
four return the columns of ``documents``; the last adds ``shard`` and
``slot``.

1. quality rules: failing lines are removed, rejected documents go;
2. near duplicates: the least id of each group stays;
3. decontamination: benchmark passages are cut out, documents mostly made of
   them go;
4. mixing: the files are in the order of the source mix, no row goes;
5. sharding: 40 shards, gapless slots in the order of the source mix inside
   each shard (Spark does not keep the order of files, so the schedule is
   computed again from the rows).

An empty table passes through every stage; null texts and texts without ten
words go in the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterkit.llm import decontaminate, mixing, near_dedup, quality_rules, sharding
from rosterkit.llm.scratch import Scratch


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else docs


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality_rules.cleaned(docs))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return _counted(decontaminate.decontaminated(docs, items))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.ordered(docs)


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Slots of a shard in the order of the source mix; the schedule is a function of the rows, not of the files."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    mix = mixing.mixed(docs)
    blocks = -(-docs.count() // mixing.BLOCK_ROWS) + mixing.MAX_SOURCES
    return sharding.sharded(mix, order=("mix_slot", "mix_row"), blocks=blocks).select(*names, "shard", "slot")


STAGES = [
    ("quality_rules", stage_quality_rules),
    ("near_dedup", stage_near_dedup),
    ("decontamination", stage_decontamination),
    ("mixing", stage_mixing),
    ("sharding", stage_sharding),
]

#: SQL can't express the mixing order and the hash tree; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
