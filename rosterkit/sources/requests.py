"""SRC-2: request batches read from JSON lines with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import split_valid
from .schema import _ddl

# Request schemas per entity (comma lists are plain text:
# genres, NIFs, label names, roles).
REQUEST_SCHEMAS = {
    "label": _ddl("seq BIGINT, RecordLabelID INT, Name STRING, Location STRING, Website STRING, "
                  "Email STRING, PhoneNumber STRING"),
    "song": _ddl("seq BIGINT, SongID BIGINT, Title STRING, Duration INT, ReleaseDate DATE, "
                 "Genres STRING, Contributors STRING"),
    "contributor": _ddl("seq BIGINT, ContributorID BIGINT, NIF STRING, Name STRING, DateOfBirth DATE, "
                        "Email STRING, PhoneNumber STRING, Roles STRING, policy STRING"),
    "employee": _ddl("seq BIGINT, EmployeeID BIGINT, NIF STRING, Name STRING, DateOfBirth DATE, "
                     "Email STRING, PhoneNumber STRING, JobTitle STRING, Department STRING, "
                     "Salary DECIMAL, HireDate DATE, RecordLabelID INT, policy STRING"),
    "collaboration": _ddl("seq BIGINT, CollaborationID BIGINT, CollaborationName STRING, "
                          "StartDate DATE, EndDate DATE, Description STRING, SongID BIGINT, "
                          "RecordLabels STRING, Contributors STRING"),
    "person": _ddl("seq BIGINT, NIF STRING, Name STRING, DateOfBirth DATE, Email STRING, "
                   "PhoneNumber STRING"),
}


_CORRUPT = "_corrupt_record"


def parsed(lines: DataFrame, entity: str) -> DataFrame:
    """Request columns of text lines (``value``, ``file``), and ``line`` where a line does not fit the schema.

    A line that is no JSON object, or has a value of another type, gives
    NULL fields and its whole text; blank lines give nothing.
    """
    schema = T.StructType([*REQUEST_SCHEMAS[entity].fields, T.StructField(_CORRUPT, T.StringType())])
    r = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = lines.where(F.trim("value") != "").select("value", "file", r.alias("_r"))
    broken = F.col("_r").isNull() | F.col(f"_r.{_CORRUPT}").isNotNull()
    return rows.select(*[F.col(f"_r.{f}").alias(f) for f in REQUEST_SCHEMAS[entity].names], "file",
                       F.when(broken, F.col("value")).alias("line"))


def split_parsed(rows: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejects) of ``parsed`` lines.

    Rejects carry the name of their file, a malformed line also its text.
    """
    broken = rows.where(F.col("line").isNotNull()).select(
        F.lit(entity).alias("entity"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("key"),
        F.lit("malformed line").alias("reason"), "file", "line")
    good, missing = split_valid(rows.where(F.col("line").isNull()), entity, extra=("file", "line"))
    return good.drop("file", "line"), missing.unionByName(broken)


def read_requests(spark: SparkSession, path: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejects) from JSON lines at ``path``.

    The schema is fixed (no inference pass); required fields are checked
    and NIF / name fields trimmed as the reference's endpoints do.
    ``rejects`` has the file of each refused request and the text of each
    malformed line, so nothing that was sent is lost.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return split_parsed(parsed(lines, entity), entity)
