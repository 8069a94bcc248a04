"""Scalar and list helpers built from ``pyspark.sql.functions``."""

from .lists import flag_list, list_items, rollup, tokens
from .text import (contains_ci, iso_date, padded_key, same_or_empty, text_or_empty,
                   where_all)

__all__ = ["contains_ci", "where_all", "same_or_empty", "text_or_empty", "iso_date",
           "padded_key", "tokens", "rollup", "flag_list", "list_items"]
