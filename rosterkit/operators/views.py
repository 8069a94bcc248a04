"""Denormalised catalogue views (VW-1 … VW-7).

Each view is a function ``T -> DataFrame`` over the table dict.  Child
lists are rolled up per parent first (partial aggregation on the map
side) and then joined 1:1 to the parent, instead of a correlated
sub-query per parent row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lists import flag_list, rollup
from .joins import join_to_unique

Tables = dict[str, DataFrame]


def label_catalog(t: Tables) -> DataFrame:
    """VW-1: the label list."""
    return t["RecordLabel"].select("RecordLabelID", "Name", "Location", "Website", "Email",
                                   "PhoneNumber")


def _count_by(df: DataFrame, key: str, out: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias(out))


def label_dependencies(t: Tables, side: str = "id2") -> DataFrame:
    """VW-2: employees and collaboration links per label, 0 when none.

    ``side='id2'`` counts links on the second label column only (the
    reference's definition); ``'either'`` counts a link on both sides.
    """
    links = t["RecordLabel_Collaboration"]
    if side == "id2":
        link_keys = links.select(F.col("RecordLabel_RecordLabelID2").alias("_l"))
    elif side == "either":
        link_keys = links.select(F.explode(F.array(
            "RecordLabel_RecordLabelID1", "RecordLabel_RecordLabelID2")).alias("_l"))
    else:
        raise ValueError(f"side must be 'id2' or 'either', not {side!r}")
    emp = _count_by(t["Employee"], "RecordLabel_RecordLabelID", "EmployeeCount")
    lnk = _count_by(link_keys, "_l", "CollaborationCount")
    rl = t["RecordLabel"].select("RecordLabelID")
    return (rl.join(emp.withColumnRenamed("_k", "RecordLabelID"), "RecordLabelID", "left")
            .join(lnk.withColumnRenamed("_k", "RecordLabelID"), "RecordLabelID", "left")
            .select("RecordLabelID",
                    F.coalesce("EmployeeCount", F.lit(0)).alias("EmployeeCount"),
                    F.coalesce("CollaborationCount", F.lit(0)).alias("CollaborationCount")))


def employee_directory(t: Tables) -> DataFrame:
    """VW-3: Employee ⨝ Person ⨝ RecordLabel (inner joins)."""
    e = t["Employee"].select("EmployeeID", F.col("Person_NIF").alias("NIF"), "JobTitle",
                             "Department", "Salary", "HireDate",
                             F.col("RecordLabel_RecordLabelID").alias("RecordLabelID"))
    p = t["Person"].select("NIF", "Name", "DateOfBirth", "Email", "PhoneNumber")
    rl = t["RecordLabel"].select("RecordLabelID", F.col("Name").alias("RecordLabelName"))
    return (join_to_unique(e.join(p, "NIF"), rl, "RecordLabelID")
            .select("EmployeeID", "NIF", "Name", "DateOfBirth", "JobTitle", "Department", "Salary",
                    "HireDate", "Email", "PhoneNumber", "RecordLabelID", "RecordLabelName"))


def contributor_names(t: Tables, links: DataFrame, link_key: str, link_contributor: str) -> DataFrame:
    """(link_key, person name) for each link row: link ⨝ Contributor ⨝ Person."""
    c = t["Contributor"].select(F.col("ContributorID").alias("_c"), F.col("Person_NIF").alias("_nif"))
    p = t["Person"].select(F.col("NIF").alias("_nif"), F.col("Name").alias("_name"))
    names = c.join(p, "_nif").select("_c", "_name")  # one row per contributor
    # a prolific contributor's links are spread over buckets (joins.join_to_unique)
    return join_to_unique(links.select(F.col(link_key).alias("_key"), F.col(link_contributor).alias("_c")),
                          names, "_c").select("_key", "_name")


def song_lists(t: Tables) -> DataFrame:
    """Song with its genre list and contributor-name list ('' when empty)."""
    genres = rollup(t["Song_Genre"].select(F.col("Song_SongID").alias("_key"),
                                           F.col("Genre").alias("_name")),
                    "_key", "_name", "Genres", empty_as_null=False)
    names = rollup(contributor_names(t, t["Contributor_Song"], "Song_SongID",
                                     "Contributor_ContributorID"),
                   "_key", "_name", "Contributors", empty_as_null=False)
    s = t["Song"]
    return (s.join(genres.withColumnRenamed("_key", "SongID"), "SongID", "left")
            .join(names.withColumnRenamed("_key", "SongID"), "SongID", "left")
            .select("SongID", "Title", "Duration", "ReleaseDate",
                    F.coalesce("Genres", F.lit("")).alias("Genres"),
                    F.coalesce("Contributors", F.lit("")).alias("Contributors")))


def song_catalog(t: Tables) -> DataFrame:
    """VW-4: one row per (song, collaboration of the song); NULL name if none.

    The (song, collaboration) pairs are built first on skinny columns:
    every collaboration that names a song, plus one NULL-named pair for
    each song no collaboration uses (an anti join against distinct song
    ids, which the map side pre-aggregates).  The pairs are then
    inner-joined once to the songs with their roll-ups.  A song used by a
    huge share of collaborations thus sits on the splittable side of an
    inner join (AQE skew split) instead of the non-splittable side of
    ``Song LEFT JOIN Collaboration``, and the roll-ups are computed once.
    """
    songs = song_lists(t)
    k = t["Collaboration"].where(F.col("Song_SongID").isNotNull())
    named = k.select(F.col("Song_SongID").alias("SongID"), "CollaborationName")
    used = k.select(F.col("Song_SongID").alias("SongID")).distinct()
    unnamed = (t["Song"].select("SongID").join(used, "SongID", "left_anti")
               .withColumn("CollaborationName", F.lit(None).cast("string")))
    pairs = named.unionByName(unnamed)
    return join_to_unique(pairs, songs, "SongID").select(
        "SongID", "Title", "Duration", "ReleaseDate", "Genres", "Contributors", "CollaborationName")


ROLE_TABLES = (("Artist", "Artist"), ("Producer", "Producer"), ("Songwriter", "Songwriter"))


def contributor_roles(t: Tables) -> DataFrame:
    """(ContributorID, Roles): fixed role order Artist, Producer, Songwriter.

    The three role tables are stacked and grouped once (one shuffle)
    rather than probed by three existence joins.
    """
    stacked = None
    for table, role in ROLE_TABLES:
        part = t[table].select(F.col("Contributor_ContributorID").alias("ContributorID"),
                               F.lit(role).alias("_role"))
        stacked = part if stacked is None else stacked.unionAll(part)
    flags = stacked.groupBy("ContributorID").agg(
        *[F.max(F.col("_role") == role).alias(f"_is_{role}") for _, role in ROLE_TABLES])
    return flags.select("ContributorID", flag_list(
        [(F.col(f"_is_{role}"), role) for _, role in ROLE_TABLES]).alias("Roles"))


def contributor_directory(t: Tables) -> DataFrame:
    """VW-5: person fields, employing label (if any) and role list."""
    c = t["Contributor"].select("ContributorID", F.col("Person_NIF").alias("NIF"))
    p = t["Person"].select("NIF", "Name", "DateOfBirth", "Email", "PhoneNumber")
    e = t["Employee"].select(F.col("Person_NIF").alias("NIF"),
                             F.col("RecordLabel_RecordLabelID").alias("_elabel"))
    rl = t["RecordLabel"].select(F.col("RecordLabelID").alias("_elabel"),
                                 F.col("Name").alias("RecordLabelName"))
    return (join_to_unique(c.join(p, "NIF").join(e, "NIF", "left"), rl, "_elabel", "left")
            .join(contributor_roles(t), "ContributorID", "left")
            .select("ContributorID", "NIF", "Name", "DateOfBirth", "Email", "PhoneNumber",
                    "RecordLabelName", "Roles"))


def collaboration_lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Label-name list (ID2 side) and contributor-name list per collaboration."""
    rl = t["RecordLabel"].select(F.col("RecordLabelID").alias("_rl"), F.col("Name").alias("_name"))
    labels = rollup(
        t["RecordLabel_Collaboration"].select(
            F.col("Collaboration_CollaborationID").alias("_key"),
            F.col("RecordLabel_RecordLabelID2").alias("_l"))
        .join(rl, F.col("_l") == F.col("_rl")).select("_key", "_name"),
        "_key", "_name", "RecordLabels")
    names = rollup(contributor_names(t, t["Collaboration_Contributor"],
                                     "Collaboration_CollaborationID", "Contributor_ContributorID"),
                   "_key", "_name", "Contributors")
    return labels, names


def collaboration_catalog(t: Tables) -> DataFrame:
    """VW-6: collaboration with song title, label list and contributor list.

    Lists of no rows are NULL (the reference's STUFF over an empty string).
    """
    labels, names = collaboration_lists(t)
    k = t["Collaboration"]
    s = t["Song"].select(F.col("SongID").alias("Song_SongID"), "SongID",
                         F.col("Title").alias("SongTitle"))
    return (join_to_unique(k, s, "Song_SongID", "left")
            .join(labels.withColumnRenamed("_key", "CollaborationID"), "CollaborationID", "left")
            .join(names.withColumnRenamed("_key", "CollaborationID"), "CollaborationID", "left")
            .select("CollaborationID", "CollaborationName", "StartDate", "EndDate", "Description",
                    "SongID", "SongTitle", "RecordLabels", "Contributors"))


def dashboard_counts(t: Tables) -> DataFrame:
    """VW-7: five table counts in one row (five one-row aggregates)."""
    parts = [("RecordLabel", "RecordLabelCount"), ("Employee", "EmployeeCount"),
             ("Song", "SongCount"), ("Contributor", "ContributorCount"),
             ("Collaboration", "CollaborationCount")]
    out = None
    for table, name in parts:
        one = t[table].agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out
