"""SNK-1: view rows as export records (ISO dates, '' for some NULL texts, two lists as arrays)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lists import list_items
from ..functions.text import iso_date

# Per entity, the text columns exported as '' when NULL and
# the comma-list columns exported as arrays.
_EMPTY_TEXT = {
    "song": ("Genres", "Contributors", "CollaborationName"),
    "employee": ("RecordLabelName",),
    "contributor": ("RecordLabelName", "Roles"),
}
_LISTS = {"collaboration": ("RecordLabels", "Contributors")}


def to_records(df: DataFrame, entity: str) -> DataFrame:
    """Dates → 'yyyy-MM-dd' text, NULL → '' where the entity says so, comma lists → arrays (trimmed, no empties)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "date":
            c = iso_date(c)
        if f.name in _LISTS.get(entity, ()):
            out.append(list_items(c).alias(f.name))
            continue
        if f.name in _EMPTY_TEXT.get(entity, ()):
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
        if entity == "employee" and f.name == "Salary":
            # SC-13: the amount as shown to users, two decimals, no grouping
            out.append(F.col("Salary").cast("decimal(38,2)").cast("string").alias("SalaryText"))
    return df.select(*out)


def write_records(df: DataFrame, entity: str, path: str, mode: str = "overwrite") -> None:
    """Write the records as JSON lines, one file per task."""
    to_records(df, entity).write.mode(mode).json(path)
