"""Fixed schemas of the 14 roster tables and their rules as data.

Spark does not enforce keys, so the rules of each table (primary key,
unique columns, not-null columns, foreign keys with their delete rule,
row checks, text lengths) are plain Python values.  The quality checks
(``operators.quality``) and the delete closure (``operators.remove``)
read them; nothing here touches data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


_TYPES = {"INT": T.IntegerType(), "BIGINT": T.LongType(), "STRING": T.StringType(),
          "DATE": T.DateType(), "DECIMAL": T.DecimalType(10, 2)}


def _ddl(text: str) -> T.StructType:
    """StructType from ``name TYPE [NOT NULL], ...`` (DECIMAL means DECIMAL(10,2))."""
    fields = []
    for item in text.split(","):
        words = item.split()
        if not words:
            continue
        fields.append(T.StructField(words[0], _TYPES[words[1]], "NOT" not in words[2:]))
    return T.StructType(fields)


# Table schemas of the roster model (column names, types,
# nullability).  Keys are BIGINT, except RecordLabelID, which keeps the
# INT type of the key it is mapped from.
SCHEMAS: dict[str, T.StructType] = {
    "RecordLabel": _ddl(
        "RecordLabelID INT NOT NULL, Name STRING NOT NULL, Location STRING, "
        "Website STRING, Email STRING NOT NULL, PhoneNumber STRING NOT NULL"),
    "Person": _ddl(
        "NIF STRING NOT NULL, Name STRING NOT NULL, DateOfBirth DATE, "
        "Email STRING, PhoneNumber STRING"),
    "Song": _ddl(
        "SongID BIGINT NOT NULL, Title STRING NOT NULL, Duration INT NOT NULL, "
        "ReleaseDate DATE"),
    "Contributor": _ddl("ContributorID BIGINT NOT NULL, Person_NIF STRING NOT NULL"),
    "Songwriter": _ddl("Contributor_ContributorID BIGINT NOT NULL"),
    "Producer": _ddl("Contributor_ContributorID BIGINT NOT NULL"),
    "Artist": _ddl("Contributor_ContributorID BIGINT NOT NULL, StageName STRING"),
    "Collaboration": _ddl(
        "CollaborationID BIGINT NOT NULL, CollaborationName STRING NOT NULL, "
        "StartDate DATE NOT NULL, EndDate DATE, Description STRING, Song_SongID BIGINT"),
    "Collaboration_Contributor": _ddl(
        "Collaboration_CollaborationID BIGINT NOT NULL, Contributor_ContributorID BIGINT NOT NULL"),
    "Contributor_Song": _ddl(
        "Contributor_ContributorID BIGINT NOT NULL, Song_SongID BIGINT NOT NULL, Date DATE"),
    "Song_Genre": _ddl("Song_SongID BIGINT NOT NULL, Genre STRING NOT NULL"),
    "Artist_Genre": _ddl("Artist_ContributorID BIGINT NOT NULL, Genre STRING NOT NULL"),
    "RecordLabel_Collaboration": _ddl(
        "RecordLabel_RecordLabelID1 INT NOT NULL, RecordLabel_RecordLabelID2 INT NOT NULL, "
        "Collaboration_CollaborationID BIGINT NOT NULL"),
    "Employee": _ddl(
        "EmployeeID BIGINT NOT NULL, JobTitle STRING NOT NULL, Department STRING, "
        "Salary DECIMAL, HireDate DATE NOT NULL, RecordLabel_RecordLabelID INT NOT NULL, "
        "Person_NIF STRING NOT NULL"),
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str  # "cascade" or "restrict"


@dataclass(frozen=True)
class Check:
    name: str
    sql: str  # a predicate that every row must satisfy (NULL passes, as in SQL)


@dataclass
class TableRules:
    pk: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    checks: tuple[Check, ...] = ()
    max_length: dict[str, int] = field(default_factory=dict)


# Keys, unique columns, NOT NULL columns, checks and
# VARCHAR lengths of the roster model.
RULES: dict[str, TableRules] = {
    "RecordLabel": TableRules(
        pk=("RecordLabelID",),
        unique=(("Name",), ("Website",), ("Email",), ("PhoneNumber",)),
        not_null=("Name", "Email", "PhoneNumber"),
        max_length={"Name": 255, "Location": 255, "Website": 255, "Email": 255, "PhoneNumber": 50}),
    "Song": TableRules(pk=("SongID",), not_null=("Title", "Duration"),
                       max_length={"Title": 255}),
    "Collaboration": TableRules(
        pk=("CollaborationID",), not_null=("CollaborationName", "StartDate"),
        checks=(Check("end_after_start",
                      "EndDate IS NULL OR StartDate IS NULL OR EndDate >= StartDate"),),
        max_length={"CollaborationName": 255}),
    "Person": TableRules(
        pk=("NIF",), unique=(("Email",), ("PhoneNumber",)), not_null=("Name",),
        max_length={"NIF": 20, "Name": 255, "Email": 255, "PhoneNumber": 50}),
    "Contributor": TableRules(pk=("ContributorID",), unique=(("Person_NIF",),),
                              not_null=("Person_NIF",)),
    "Employee": TableRules(
        pk=("EmployeeID",), unique=(("Person_NIF",),),
        not_null=("JobTitle", "HireDate", "RecordLabel_RecordLabelID", "Person_NIF"),
        checks=(Check("salary_not_negative", "Salary >= 0"),),
        max_length={"JobTitle": 100, "Department": 100}),
    "Songwriter": TableRules(pk=("Contributor_ContributorID",)),
    "Producer": TableRules(pk=("Contributor_ContributorID",)),
    "Artist": TableRules(pk=("Contributor_ContributorID",), unique=(("StageName",),),
                         max_length={"StageName": 255}),
    "RecordLabel_Collaboration": TableRules(
        pk=("RecordLabel_RecordLabelID1", "RecordLabel_RecordLabelID2",
            "Collaboration_CollaborationID"),
        checks=(Check("distinct_labels",
                      "RecordLabel_RecordLabelID1 <> RecordLabel_RecordLabelID2"),)),
    "Collaboration_Contributor": TableRules(
        pk=("Collaboration_CollaborationID", "Contributor_ContributorID")),
    "Contributor_Song": TableRules(pk=("Contributor_ContributorID", "Song_SongID")),
    "Song_Genre": TableRules(pk=("Song_SongID", "Genre"), max_length={"Genre": 50}),
    "Artist_Genre": TableRules(pk=("Artist_ContributorID", "Genre"), max_length={"Genre": 50}),
}

# Foreign keys and their delete rule ("NO ACTION" is restrict).
FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("Collaboration", ("Song_SongID",), "Song", ("SongID",), "restrict"),
    ForeignKey("Contributor", ("Person_NIF",), "Person", ("NIF",), "restrict"),
    ForeignKey("Employee", ("RecordLabel_RecordLabelID",), "RecordLabel", ("RecordLabelID",), "restrict"),
    ForeignKey("Employee", ("Person_NIF",), "Person", ("NIF",), "restrict"),
    ForeignKey("Songwriter", ("Contributor_ContributorID",), "Contributor", ("ContributorID",), "cascade"),
    ForeignKey("Producer", ("Contributor_ContributorID",), "Contributor", ("ContributorID",), "cascade"),
    ForeignKey("Artist", ("Contributor_ContributorID",), "Contributor", ("ContributorID",), "cascade"),
    ForeignKey("RecordLabel_Collaboration", ("RecordLabel_RecordLabelID1",), "RecordLabel",
               ("RecordLabelID",), "cascade"),
    ForeignKey("RecordLabel_Collaboration", ("RecordLabel_RecordLabelID2",), "RecordLabel",
               ("RecordLabelID",), "restrict"),
    ForeignKey("RecordLabel_Collaboration", ("Collaboration_CollaborationID",), "Collaboration",
               ("CollaborationID",), "cascade"),
    ForeignKey("Collaboration_Contributor", ("Collaboration_CollaborationID",), "Collaboration",
               ("CollaborationID",), "cascade"),
    ForeignKey("Collaboration_Contributor", ("Contributor_ContributorID",), "Contributor",
               ("ContributorID",), "restrict"),
    ForeignKey("Contributor_Song", ("Contributor_ContributorID",), "Contributor",
               ("ContributorID",), "restrict"),
    ForeignKey("Contributor_Song", ("Song_SongID",), "Song", ("SongID",), "cascade"),
    ForeignKey("Song_Genre", ("Song_SongID",), "Song", ("SongID",), "cascade"),
    ForeignKey("Artist_Genre", ("Artist_ContributorID",), "Artist", ("Contributor_ContributorID",),
               "cascade"),
)

# Parents before children; the FK graph is acyclic, so one pass in this
# order sees every cascade.
TOPOLOGICAL_ORDER: tuple[str, ...] = (
    "RecordLabel", "Person", "Song", "Collaboration", "Contributor", "Employee",
    "Artist", "Producer", "Songwriter", "Artist_Genre", "RecordLabel_Collaboration",
    "Collaboration_Contributor", "Contributor_Song", "Song_Genre",
)

TABLES: tuple[str, ...] = tuple(SCHEMAS)


def pk(table: str) -> list[str]:
    return list(RULES[table].pk)


def foreign_keys_of(child: str) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.child == child]
