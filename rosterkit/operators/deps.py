"""Dependency reports: one row per requested parent (DEP-1 … DEP-5, SET-1).

Counts are grouped on the child side first (map-side partial counts, so
a parent with a huge share of children ships one partial count per
task), then joined 1:1 to the requested parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import views
from .changes import empty_rejects, rejects

Tables = dict[str, DataFrame]


def _counts(df: DataFrame, key: str, out: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias(out))


def _ids(ids: DataFrame | None, parent: DataFrame, key: str, ids_col: str | None) -> DataFrame:
    if ids is None:
        return parent.select(key)
    return ids.select(F.col(ids_col or key).alias(key)).distinct()


def _with_counts(base: DataFrame, key: str, parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    out = base
    for child, child_key, name in parts:
        cnt = _counts(child, child_key, name)
        out = out.join(cnt.withColumnRenamed("_k", key), key, "left")
    return out.select(key, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for _, _, n in parts])


def label_dependencies(t: Tables, ids: DataFrame | None = None, side: str = "id2",
                       ids_col: str = "RecordLabelID") -> tuple[DataFrame, DataFrame]:
    """DEP-1: (counts for known labels, rejects for unknown ids)."""
    counts = views.label_dependencies(t, side=side)
    if ids is None:
        return counts, empty_rejects(counts.sparkSession)
    req = ids.select(F.col(ids_col).alias("RecordLabelID")).distinct()
    known = counts.join(req, "RecordLabelID", "left_semi")
    unknown = rejects(req.join(counts.select("RecordLabelID"), "RecordLabelID", "left_anti"),
                      "RecordLabel", "RecordLabelID", F.lit("RecordLabel not found"))
    return known, unknown


def split_deletable(t: Tables, ids: DataFrame, side: str = "id2",
                    ids_col: str = "RecordLabelID") -> tuple[DataFrame, DataFrame]:
    """DEP-5: requested labels split into (deletable ids, blocked with counts)."""
    known, _ = label_dependencies(t, ids, side=side, ids_col=ids_col)
    free = (F.col("EmployeeCount") == 0) & (F.col("CollaborationCount") == 0)
    return known.where(free).select("RecordLabelID"), known.where(~free)


def song_dependencies(t: Tables, ids: DataFrame | None = None, ids_col: str = "SongID") -> DataFrame:
    """DEP-2: collaborations and contributor links per song; unknown id → 0, 0."""
    return _with_counts(_ids(ids, t["Song"], "SongID", ids_col), "SongID", [
        (t["Collaboration"].where(F.col("Song_SongID").isNotNull()), "Song_SongID",
         "CollaborationCount"),
        (t["Contributor_Song"], "Song_SongID", "ContributorCount")])


def contributor_dependencies(t: Tables, ids: DataFrame | None = None,
                             ids_col: str = "ContributorID") -> DataFrame:
    """DEP-3: collaboration links and song links per contributor; unknown → 0, 0."""
    return _with_counts(_ids(ids, t["Contributor"], "ContributorID", ids_col), "ContributorID", [
        (t["Collaboration_Contributor"], "Contributor_ContributorID", "CollaborationCount"),
        (t["Contributor_Song"], "Contributor_ContributorID", "SongCount")])


def employee_dependencies(t: Tables, ids: DataFrame | None = None,
                          ids_col: str = "EmployeeID") -> DataFrame:
    """DEP-4: the contributor counts of the employee's person (via NIF)."""
    emp = t["Employee"].select("EmployeeID", "Person_NIF")
    if ids is not None:
        req = ids.select(F.col(ids_col).alias("EmployeeID")).distinct()
        emp = req.join(emp, "EmployeeID", "left")
    c = t["Contributor"].select("Person_NIF", "ContributorID")
    base = emp.join(c, "Person_NIF", "left").select("EmployeeID", "ContributorID")
    parts = [(t["Collaboration_Contributor"], "Contributor_ContributorID", "CollaborationCount"),
             (t["Contributor_Song"], "Contributor_ContributorID", "SongCount")]
    out = base
    for child, child_key, name in parts:
        cnt = _counts(child, child_key, name)
        out = out.join(cnt.withColumnRenamed("_k", "ContributorID"), "ContributorID", "left")
    return out.select("EmployeeID", *[F.coalesce(F.col(n), F.lit(0)).alias(n)
                                      for _, _, n in parts])


def collaboration_label_members(links: DataFrame) -> DataFrame:
    """SET-1: distinct (collaboration, label) over both label columns, one scan."""
    return links.select(
        F.col("Collaboration_CollaborationID").alias("CollaborationID"),
        F.explode(F.array("RecordLabel_RecordLabelID1", "RecordLabel_RecordLabelID2"))
        .alias("LabelID")).distinct()

