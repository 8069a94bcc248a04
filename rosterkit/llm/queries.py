"""Registered queries of the training-data operators: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, conversation_repair, decontaminate, jaccard_join, license_scan, mixing, near_dedup,
               quality_classifier, quality_rules, sharding, substring_dedup, toxicity, whitening)
from .oracles import ORACLE_SQL as _SQL

#: The conversation added to the table to show that control strings survive.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def op1_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op2_source_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents", "doc_id", "source"))


def op3_quality_classifier(spark, sf_dir):
    return quality_classifier.scores(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op4_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn int, role string, text string"))
    return chat_format.digest(chat_format.formatted(turns))


def op5_sharding(spark, sf_dir):
    return sharding.shards(documents(spark, sf_dir))


def op6_toxicity(spark, sf_dir):
    return toxicity.scores(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.measures(documents(spark, sf_dir)).drop("clean_text")


def op8_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.scan(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_license_scans(spark, sf_dir):
    return license_scan.scan(documents(spark, sf_dir)).drop("places")


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.shared_passages(documents(spark, sf_dir))


def op11_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.linked(documents(spark, sf_dir))


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.damaged_and_repaired(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_sharding": op5_sharding,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_license_scans": op9_license_scans,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB SQL where it can express the query.
ORACLE_SQL: dict[str, str] = {k: v for k, v in _SQL.items() if k in QUERIES}
