"""Scalar predicates and formats (all built-in Catalyst expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_ci(col, term: str, pattern: bool = False) -> Column:
    """``LIKE '%term%'`` as a case-insensitive literal substring test.

    NULL column values never match (the predicate is NULL).  With
    ``pattern=True`` the term keeps ``%`` and ``_`` as wildcards (``ilike``).
    """
    c = _col(col)
    if pattern:
        return c.ilike("%" + term + "%")
    return F.lower(c).contains(F.lit(term.lower()))


def where_all(df: DataFrame, predicates) -> DataFrame:
    """AND of the predicates that are set; an unset (None) one is no filter."""
    preds = [p for p in predicates if p is not None]
    if not preds:
        return df
    return df.where(reduce(lambda a, b: a & b, preds))


def text_or_empty(col) -> Column:
    return F.coalesce(_col(col).cast("string"), F.lit(""))


def same_or_empty(a, b) -> Column:
    """Equality where NULL and '' count as the same value (dates as ISO text)."""
    return text_or_empty(a) == text_or_empty(b)


def iso_date(col) -> Column:
    return F.date_format(_col(col), "yyyy-MM-dd")


def padded_key(prefix: str, col, width: int = 7) -> Column:
    """``prefix`` + number, zero-padded to at least ``width`` digits and never shortened."""
    digits = _col(col).cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))
