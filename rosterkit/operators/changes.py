"""ChangeSet: the result of a write job, and small shared helpers.

A write job never mutates a table in place.  It returns new versions of
the affected tables (lazy DataFrames), a DataFrame of rejected requests
with a reason, and named reports.  ``sources.publish`` writes a version.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]

REJECT_SCHEMA = "entity STRING, seq BIGINT, key STRING, reason STRING"


@dataclass
class ChangeSet:
    tables: Tables
    rejects: DataFrame
    reports: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def empty_rejects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REJECT_SCHEMA)


def rejects(df: DataFrame, entity: str, key, reason, seq="seq", extra=()) -> DataFrame:
    """Reject rows in the common layout (entity, seq, key, reason), then the ``extra`` columns."""
    def col(c):
        return F.col(c) if isinstance(c, str) and c in df.columns else (
            c if not isinstance(c, str) else F.lit(c))
    seq_col = F.col(seq).cast("bigint") if seq in df.columns else F.lit(None).cast("bigint")
    return df.select(F.lit(entity).alias("entity"), seq_col.alias("seq"),
                     col(key).cast("string").alias("key"), col(reason).cast("string").alias("reason"), *extra)


def lazy_reports(**items) -> "Mapping[str, DataFrame]":
    """Named reports; a callable value is built only when the report is read."""
    from ..sources.lazy import LazyTables
    return LazyTables({k: (v if callable(v) else (lambda v=v: v)) for k, v in items.items()})


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def with_tables(t: Tables, **changed: DataFrame) -> Tables:
    """A new table map with some tables replaced; the others are shared."""
    if hasattr(t, "replace"):
        return t.replace(**changed)
    out = dict(t)
    out.update(changed)
    return out


def keys_of(df: DataFrame, cols: list[str], rename: list[str] | None = None) -> DataFrame:
    """Distinct key columns (partial aggregation on the map side)."""
    rename = rename or cols
    return df.select(*[F.col(c).alias(r) for c, r in zip(cols, rename)]).distinct()


def drop_keys(df: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    return df.join(keys, cols, "left_anti")
