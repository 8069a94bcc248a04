"""Plan summaries: what a query's physical plan does, counted by operator.

Reads the executed (AQE: initial) physical plan text of a DataFrame and
counts shuffles, join strategies, aggregates and scans, so a change that
adds a shuffle or falls back to a nested-loop join shows up in a test or
a review without reading the whole plan.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

_NODES = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
          "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
          "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "ObjectHashAggregate",
          "SortAggregate", "Window", "Generate", "FileScan", "ReusedExchange", "BatchEvalPython",
          "ArrowEvalPython")


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan_summary(df: DataFrame) -> dict[str, int]:
    """Operator counts of the physical plan (join counts include their type)."""
    text = plan_text(df)
    counts: Counter = Counter()
    for line in text.splitlines():
        body = line.strip(" :+-*()0123456789")
        for node in _NODES:
            if body.startswith(node):
                if node.endswith("Join"):
                    kind = re.search(r"\], \[.*?\], (\w+)", body)
                    counts[f"{node}:{kind.group(1) if kind else '?'}"] += 1
                else:
                    counts[node] += 1
                break
    return dict(sorted(counts.items()))


def read_schemas(df: DataFrame) -> list[str]:
    """The columns each Parquet scan reads (``ReadSchema``)."""
    return re.findall(r"ReadSchema: (struct<[^>]*>)", plan_text(df))
