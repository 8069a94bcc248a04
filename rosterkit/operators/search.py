"""Optional multi-field search and key lookups (FLT-1 … FLT-15, SRT-1).

Every parameter is optional; an unset one adds no predicate.  Filters on
base columns sit directly above the base table, so Catalyst pushes them
below the joins (and range/equality predicates into the Parquet scan).
Filters on a rolled-up list run after the roll-up, as they must.  When a
search sets base-column filters, the roll-up inputs are first reduced to
the matching parents with a semi join, so a selective search does not
aggregate the whole link table.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ci, where_all
from . import views
from .changes import with_tables

Tables = dict[str, DataFrame]


def _ci(col, term, pattern):
    return None if term is None else contains_ci(col, term, pattern)


def search_labels(t: Tables, *, name=None, location=None, website=None, email=None, phone=None,
                  pattern: bool = False) -> DataFrame:
    """FLT-1: contains-search over the label list."""
    return where_all(views.label_catalog(t), [
        _ci("Name", name, pattern), _ci("Location", location, pattern),
        _ci("Website", website, pattern), _ci("Email", email, pattern),
        _ci("PhoneNumber", phone, pattern)])


def search_employees(t: Tables, *, nif=None, name=None, job_title=None, department=None,
                     email=None, phone=None, min_salary=None, label=None,
                     pattern: bool = False) -> DataFrame:
    """FLT-2, FLT-10, FLT-11: employee directory search.

    ``min_salary`` keeps Salary >= the bound (decimal compare); ``label``
    is a contains-search on the label name where NULL counts as ''.
    """
    salary = None
    if min_salary is not None:
        salary = F.col("Salary") >= F.lit(Decimal(str(min_salary))).cast("decimal(10,2)")
    label_pred = None
    if label is not None:
        label_pred = contains_ci(F.coalesce(F.col("RecordLabelName"), F.lit("")), label, pattern)
    return where_all(views.employee_directory(t), [
        _ci("NIF", nif, pattern), _ci("Name", name, pattern), _ci("JobTitle", job_title, pattern),
        _ci("Department", department, pattern), _ci("Email", email, pattern),
        _ci("PhoneNumber", phone, pattern), salary, label_pred])


def _restrict(t: Tables, table: str, keys: DataFrame, key_col: str, on: str) -> Tables:
    """Copy of ``t`` with ``table`` reduced to rows whose ``on`` is in ``keys``.

    A plain semi join against the distinct matching parents: the point is
    to skip rolling up links of parents the search drops, so it must not
    first count the whole link table per key (the hot-key split would).
    A selective search yields a small key set, which Spark's runtime size
    check broadcasts (no skew in a broadcast join); the roll-up joins
    after it split hot keys as usual.
    """
    return with_tables(t, **{table: t[table].join(
        keys.select(F.col(key_col).alias(on)).distinct(), on, "left_semi")})


def search_songs(t: Tables, *, title=None, min_duration=None, max_duration=None,
                 release_date=None, genre=None, contributor=None, collaboration=None,
                 genre_exact=None, pattern: bool = False) -> DataFrame:
    """FLT-3, FLT-8, FLT-9, FLT-15: song catalogue search.

    ``genre``/``contributor`` search the rolled-up lists (a match may span
    an item border, as in the reference); ``genre_exact`` keeps songs that
    have exactly that genre item (a semi join before the roll-up).
    """
    base = [_ci("Title", title, pattern),
            None if min_duration is None else F.col("Duration") >= F.lit(int(min_duration)),
            None if max_duration is None else F.col("Duration") <= F.lit(int(max_duration)),
            None if release_date is None else
            F.col("ReleaseDate") == F.lit(_as_date(release_date))]
    if any(p is not None for p in base) or genre_exact is not None:
        songs = where_all(t["Song"], base)
        if genre_exact is not None:
            songs = songs.join(t["Song_Genre"].where(F.col("Genre") == genre_exact)
                               .select(F.col("Song_SongID").alias("SongID")).distinct(),
                               "SongID", "left_semi")
        t = with_tables(t, Song=songs)
        t = _restrict(t, "Song_Genre", songs, "SongID", "Song_SongID")
        t = _restrict(t, "Contributor_Song", songs, "SongID", "Song_SongID")
        t = _restrict(t, "Collaboration", songs, "SongID", "Song_SongID")
    return where_all(views.song_catalog(t), [
        _ci("Genres", genre, pattern), _ci("Contributors", contributor, pattern),
        _ci("CollaborationName", collaboration, pattern)])


def search_contributors(t: Tables, *, name=None, role=None, email=None, phone=None, label=None,
                        nif=None, pattern: bool = False, sort: bool = False) -> DataFrame:
    """FLT-4, FLT-11, FLT-12, SRT-1: contributor directory search.

    ``sort=True`` orders by ContributorID (a distributed range sort).
    """
    label_pred = None
    if label is not None:
        label_pred = contains_ci(F.coalesce(F.col("RecordLabelName"), F.lit("")), label, pattern)
    nif_pred = None
    if nif is not None:
        nif_pred = contains_ci(F.coalesce(F.col("NIF"), F.lit("")), nif, pattern)
    out = where_all(views.contributor_directory(t), [
        _ci("Name", name, pattern), _ci("Roles", role, pattern), _ci("Email", email, pattern),
        _ci("PhoneNumber", phone, pattern), label_pred, nif_pred])
    return out.orderBy("ContributorID") if sort else out


def search_collaborations(t: Tables, *, name=None, start=None, end=None, song=None, label=None,
                          contributor=None, pattern: bool = False) -> DataFrame:
    """FLT-5, FLT-9, FLT-15: collaboration catalogue search (dates by equality)."""
    base = [_ci("CollaborationName", name, pattern),
            None if start is None else F.col("StartDate") == F.lit(_as_date(start)),
            None if end is None else F.col("EndDate") == F.lit(_as_date(end))]
    if any(p is not None for p in base):
        k = where_all(t["Collaboration"], base)
        t = with_tables(t, Collaboration=k)
        t = _restrict(t, "RecordLabel_Collaboration", k, "CollaborationID",
                      "Collaboration_CollaborationID")
        t = _restrict(t, "Collaboration_Contributor", k, "CollaborationID",
                      "Collaboration_CollaborationID")
    return where_all(views.collaboration_catalog(t), [
        _ci("SongTitle", song, pattern), _ci("RecordLabels", label, pattern),
        _ci("Contributors", contributor, pattern)])


def lookup(df: DataFrame, key: str, keys: DataFrame, keys_col: str | None = None) -> DataFrame:
    """FLT-13: rows of ``df`` whose ``key`` is in a set of keys (semi join).

    The key set is de-duplicated first; duplicates in it never multiply rows.
    """
    kc = keys_col or key
    return df.join(keys.select(F.col(kc).alias(key)).distinct(), key, "left_semi")


def lookup_songs(t: Tables, keys: DataFrame, keys_col: str = "SongID") -> DataFrame:
    """FLT-13 on VW-4: every table is reduced to the looked-up songs before the lists are rolled up."""
    wanted = keys.select(F.col(keys_col).alias("SongID")).distinct()
    songs = t["Song"].join(wanted, "SongID", "left_semi")
    t = with_tables(t, Song=songs)
    for table in ("Song_Genre", "Contributor_Song", "Collaboration"):
        t = _restrict(t, table, wanted, "SongID", "Song_SongID")
    return views.song_catalog(t)


def lookup_collaborations(t: Tables, keys: DataFrame, keys_col: str = "CollaborationID") -> DataFrame:
    """FLT-13 on VW-6: as ``lookup_songs``."""
    wanted = keys.select(F.col(keys_col).alias("CollaborationID")).distinct()
    t = with_tables(t, Collaboration=t["Collaboration"].join(wanted, "CollaborationID", "left_semi"))
    for table in ("RecordLabel_Collaboration", "Collaboration_Contributor"):
        t = _restrict(t, table, wanted, "CollaborationID", "Collaboration_CollaborationID")
    return views.collaboration_catalog(t)


def lookup_persons(t: Tables, nifs: DataFrame, nif_col: str = "NIF") -> DataFrame:
    """FLT-14: persons by NIF with their contributor id (NULL if none)."""
    p = lookup(t["Person"], "NIF", nifs, nif_col)
    c = t["Contributor"].select(F.col("Person_NIF").alias("NIF"), "ContributorID")
    return p.join(c, "NIF", "left").select("NIF", "Name", "DateOfBirth", "Email", "PhoneNumber",
                                           "ContributorID")


def _as_date(v):
    if isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v))
