"""Comma lists: splitting request lists into rows and rolling rows up.

Splitting is ``split`` + ``trim`` + ``explode`` (no cursor loop); rolling
up is a sorted ``collect_list`` joined with a separator.  Both stay in
Catalyst expressions, so whole-stage codegen covers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(col, sep: str = ",") -> Column:
    """Array of trimmed items; empty items are kept (as STRING_SPLIT does)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(F.split(c, sep, -1), lambda x: F.trim(x))


def rollup(rows: DataFrame, key: str, item: str, out: str, sep: str = ", ",
           empty_as_null: bool = True) -> DataFrame:
    """One row per ``key`` with the sorted items joined by ``sep``.

    NULL items are skipped, as STRING_AGG skips them.  The list of one key
    is that key's output value, so it is built in the task that owns the
    key; the map side ships partial lists, not raw rows.  A key without
    items is absent here; callers left-join and decide between NULL and ''.
    """
    agg = rows.where(F.col(item).isNotNull()).groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(item)), sep).alias(out))
    if empty_as_null:
        agg = agg.withColumn(out, F.nullif(F.col(out), F.lit("")))
    return agg


def flag_list(flags: list[tuple[Column, str]], sep: str = ", ") -> Column:
    """Names of the set flags in the given order; NULL when none is set."""
    parts = [F.when(cond, F.lit(name)) for cond, name in flags]
    return F.nullif(F.concat_ws(sep, *parts), F.lit(""))


def list_items(col, sep: str = ",") -> Column:
    """Comma text back to an array: trimmed, empty items dropped."""
    return F.filter(tokens(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), sep),
                    lambda x: x != "")
