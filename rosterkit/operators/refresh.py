"""Catalogue views kept up to date: only the touched parents are rolled up again (AG-6, AG-7, JN-9).

A stored view (VW-4 songs, VW-6 collaborations) is wrong after a change only
for the parents the change touched.  ``touched_songs`` and
``touched_collaborations`` follow the keys a change set names (songs,
collaborations, contributors, persons, labels) to the parents whose rows or
lists hold them, before and after the change; ``refresh_*`` drops those
parents from the old view by an anti join, reduces every link table to them by
a semi join before the roll-up, and adds their new rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir
from . import views
from .changes import union_all, with_tables
from .joins import join_to_unique

Tables = dict[str, DataFrame]


def _contributors(t: Tables, contributors: DataFrame | None, persons: DataFrame | None) -> DataFrame | None:
    """Contributor ids named directly or by their person's NIF."""
    found = []
    if contributors is not None:
        found.append(contributors.select("ContributorID"))
    if persons is not None:
        found.append(t["Contributor"].select("ContributorID", F.col("Person_NIF").alias("NIF")).join(
            persons.select("NIF").distinct(), "NIF", "left_semi").select("ContributorID"))
    return union_all(found).distinct() if found else None


def _linked(links: DataFrame, on: str, keys: DataFrame, key: str, parent: str, out: str) -> DataFrame:
    """Parents that the link rows of ``keys`` name; a prolific key is split."""
    return join_to_unique(links.select(on, parent), keys.select(F.col(key).alias(on)).distinct(), on, "left_semi").select(
        F.col(parent).alias(out))


def touched_songs(before: Tables, after: Tables, songs: DataFrame | None = None, collaborations: DataFrame | None = None,
                  contributors: DataFrame | None = None, persons: DataFrame | None = None) -> DataFrame:
    """Song ids whose VW-4 rows may differ between the two versions of the tables."""
    found = [] if songs is None else [songs.select("SongID")]
    for t in (before, after):
        who = _contributors(t, contributors, persons)
        if who is not None:
            found.append(_linked(t["Contributor_Song"], "Contributor_ContributorID", who, "ContributorID", "Song_SongID",
                                 "SongID"))
        if collaborations is not None:
            found.append(_linked(t["Collaboration"], "CollaborationID", collaborations, "CollaborationID", "Song_SongID",
                                 "SongID"))
    return _kept(union_all(found).where("SongID is not null").distinct())


def touched_collaborations(before: Tables, after: Tables, collaborations: DataFrame | None = None,
                           songs: DataFrame | None = None, contributors: DataFrame | None = None,
                           persons: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Collaboration ids whose VW-6 rows may differ between the two versions of the tables."""
    found = [] if collaborations is None else [collaborations.select("CollaborationID")]
    for t in (before, after):
        who = _contributors(t, contributors, persons)
        if who is not None:
            found.append(_linked(t["Collaboration_Contributor"], "Contributor_ContributorID", who, "ContributorID",
                                 "Collaboration_CollaborationID", "CollaborationID"))
        if songs is not None:
            found.append(_linked(t["Collaboration"], "Song_SongID", songs, "SongID", "CollaborationID", "CollaborationID"))
        if labels is not None:
            found.append(_linked(t["RecordLabel_Collaboration"], "RecordLabel_RecordLabelID2", labels, "RecordLabelID",
                                 "Collaboration_CollaborationID", "CollaborationID"))
    return _kept(union_all(found).distinct())


def _kept(keys: DataFrame) -> DataFrame:
    """The touched keys, written once: every table of the refresh is reduced to them."""
    ensure_checkpoint_dir(keys.sparkSession)
    return keys.checkpoint(eager=True)


def _only(t: Tables, keys: DataFrame, key: str, tables: dict[str, str]) -> Tables:
    """The tables with those of ``tables`` (name to key column) reduced to ``keys``, below every join.

    Plain semi joins, as in the searches: they must not first count the
    whole link tables by key, which the hot-key split would.
    """
    return with_tables(t, **{name: t[name].join(keys.select(F.col(key).alias(on)), on, "left_semi")
                             for name, on in tables.items()})


def refresh_song_catalog(view: DataFrame, after: Tables, touched: DataFrame) -> DataFrame:
    """VW-4 after a change: the rows of untouched songs as they are, those of touched songs made again."""
    new = views.song_catalog(_only(after, touched, "SongID", {
        "Song": "SongID", "Song_Genre": "Song_SongID", "Contributor_Song": "Song_SongID", "Collaboration": "Song_SongID"}))
    return view.join(touched, "SongID", "left_anti").select(*new.columns).unionByName(new)


def refresh_collaboration_catalog(view: DataFrame, after: Tables, touched: DataFrame) -> DataFrame:
    """VW-6 after a change: the rows of untouched collaborations as they are, the others made again."""
    new = views.collaboration_catalog(_only(after, touched, "CollaborationID", {
        "Collaboration": "CollaborationID", "RecordLabel_Collaboration": "Collaboration_CollaborationID",
        "Collaboration_Contributor": "Collaboration_CollaborationID"}))
    return view.join(touched, "CollaborationID", "left_anti").select(*new.columns).unionByName(new)
