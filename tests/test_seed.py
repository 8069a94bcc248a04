"""Golden tests on the seed fixture (expected results of FIXTURES.md §2)."""

import datetime as dt

from pyspark.sql import functions as F

from rosterkit.operators import deps, quality, remove, views


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def ids(df, col):
    return sorted(r[0] for r in df.select(col).collect())


def test_load_rejects(spark, seed):
    t, rej = quality.enforce_rules(seed, materialize=True)
    got = sorted((r.table, r.rule) for r in rej.collect())
    assert got.count(("RecordLabel_Collaboration", "pk")) == 3
    assert got.count(("RecordLabel_Collaboration", "check:distinct_labels")) == 3
    assert rows(t["RecordLabel_Collaboration"], "*") == [(1, 2, 1), (2, 3, 7), (4, 5, 3)]


def test_state_after_purges(loaded):
    assert ids(loaded["Collaboration"], "CollaborationID") == [1, 2, 3, 7]
    assert ids(loaded["Song"], "SongID") == [1, 2, 5, 6, 9]
    assert loaded["Collaboration_Contributor"].count() == 9
    assert loaded["Contributor_Song"].count() == 9
    assert loaded["Song_Genre"].count() == 8


def test_purges_idempotent(loaded):
    again = remove.purge_small_collaborations(loaded).tables
    again = remove.purge_orphan_songs(again).tables
    assert again["Collaboration"].count() == loaded["Collaboration"].count()
    assert again["Song"].count() == loaded["Song"].count()


def test_dashboard(loaded):
    assert tuple(views.dashboard_counts(loaded).first()) == (5, 5, 5, 9, 4)


def test_label_dependencies(loaded):
    assert rows(views.label_dependencies(loaded), "*") == [
        (1, 1, 0), (2, 1, 1), (3, 1, 1), (4, 1, 0), (5, 1, 1)]


def test_song_catalog(loaded):
    got = {r.SongID: (r.Genres, r.Contributors, r.CollaborationName)
           for r in views.song_catalog(loaded).collect()}
    assert got == {
        1: ("Dance, Pop", "Alice Johnson, Bruno Mars", "Summer Vibes Project"),
        2: ("Acoustic, Indie", "Bruno Mars, Camila Mendes, Daniel Kim", "Acoustic Sessions"),
        5: ("Dream Pop", "Eva Green, Frank Ocean", "Dreamscape EP"),
        6: ("EDM, Electronic", "Frank Ocean", None),
        9: ("Duet", "Ivy League", "Duet Dreams"),
    }


def test_contributor_directory(loaded):
    got = {r.ContributorID: (r.Roles, r.RecordLabelName)
           for r in views.contributor_directory(loaded).collect()}
    assert got == {
        1: ("Songwriter", "Harmony Records"), 2: ("Artist, Producer", None),
        3: ("Artist", None), 4: ("Artist, Producer", "Nova Tunes"),
        5: ("Artist, Songwriter", "Sunset Beats"), 6: ("Artist, Producer, Songwriter", "OceanWave Records"),
        7: ("Songwriter", "SilverNote Music"), 8: ("Producer", None), 9: ("Artist", None),
    }


def test_collaboration_catalog_labels(loaded):
    got = {r.CollaborationID: r.RecordLabels for r in views.collaboration_catalog(loaded).collect()}
    assert got == {1: "Nova Tunes", 2: None, 3: "SilverNote Music", 7: "Sunset Beats"}


def _ids_df(spark, col, values):
    return spark.createDataFrame([(v,) for v in values], f"{col} BIGINT")


def test_label_strict_blocked(spark, loaded):
    out = remove.delete_labels(loaded, _ids_df(spark, "RecordLabelID", [2]), mode="strict")
    assert rows(out.reports["blocked"], "*") == [(2, 1, 1)]
    assert 2 in ids(out.tables["RecordLabel"], "RecordLabelID")


def test_label_cascade(spark, loaded):
    out = remove.delete_labels(loaded, _ids_df(spark, "RecordLabelID", [2]), mode="cascade").tables
    assert ids(out["Collaboration"], "CollaborationID") == [2, 3]
    assert "P004" in ids(out["Person"], "NIF")
    assert ids(out["Employee"], "Person_NIF") == ["P001", "P005", "P006", "P007"]
    assert 2 not in ids(out["RecordLabel"], "RecordLabelID")


def test_delete_contributor_9(spark, loaded):
    out = remove.delete_contributors(loaded, _ids_df(spark, "ContributorID", [9]))
    t = out.tables
    assert 7 not in ids(t["Collaboration"], "CollaborationID")
    assert 9 not in ids(t["Song"], "SongID")
    assert 9 not in ids(t["Artist"], "Contributor_ContributorID")
    assert 9 not in ids(t["Artist_Genre"], "Artist_ContributorID")
    assert "P009" not in ids(t["Person"], "NIF")


def test_delete_contributor_6(spark, loaded):
    out = remove.delete_contributors(loaded, _ids_df(spark, "ContributorID", [6]))
    t = out.tables
    assert 3 not in ids(t["Collaboration"], "CollaborationID")
    assert 6 not in ids(t["Song"], "SongID")
    assert 5 in ids(t["Song"], "SongID")
    assert "P006" in ids(t["Person"], "NIF")


def test_delete_song_1(spark, loaded):
    t = remove.delete_songs(loaded, _ids_df(spark, "SongID", [1])).tables
    assert 1 not in ids(t["Collaboration"], "CollaborationID")
    assert 1 not in ids(t["Collaboration_Contributor"], "Collaboration_CollaborationID")
    assert 1 not in ids(t["Song"], "SongID")


def test_orphan_song_blocked(spark, loaded):
    t = dict(loaded)
    t["Contributor_Song"] = loaded["Contributor_Song"].where(
        ~((F.col("Contributor_ContributorID") == 9) & (F.col("Song_SongID") == 9)))
    out = remove.purge_orphan_songs(t)
    assert ids(out.reports["blocked"], "SongID") == [9]
    assert 9 in ids(out.tables["Song"], "SongID")


def test_delete_employee_keeps_contributor_person(spark, loaded):
    t = remove.delete_employees(loaded, _ids_df(spark, "EmployeeID", [1])).tables
    assert "P001" in ids(t["Person"], "NIF")
    assert 1 not in ids(t["Employee"], "EmployeeID")


def test_dependency_counts_unknown_ids(spark, loaded):
    got = rows(deps.song_dependencies(loaded, _ids_df(spark, "SongID", [1, 99])), "*")
    assert got == [(1, 1, 2), (99, 0, 0)]
    known, unknown = deps.label_dependencies(loaded, _ids_df(spark, "RecordLabelID", [1, 42]))
    assert ids(known, "RecordLabelID") == [1]
    assert [r.key for r in unknown.collect()] == ["42"]


def test_qc_clean_after_load(loaded):
    bad = quality.check_tables(loaded).collect()
    # the loaded state satisfies every rule except the unchecked seed lengths
    assert [tuple(r) for r in bad] == []


def test_dates_survive(loaded):
    r = loaded["Collaboration"].where("CollaborationID = 1").first()
    assert r.StartDate == dt.date(2024, 5, 1)
