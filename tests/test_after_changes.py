"""What follows a change: purges against a one-by-one model, refreshed views, versions, the trigram index, intake."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from rosterkit.operators import ingest, refresh, remove, trigrams, update, views
from rosterkit.sources import publish, read_tables, read_version, tables as published
from rosterkit.sources.requests import read_requests
from rosterkit.sources.schema import SCHEMAS


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


# ------------------------------------------------------------------ purges

def one_by_one(collabs, cc, rl, songs, cs, touched_k, touched_s):
    """Delete one parent at a time while a rule is broken among the touched ones."""
    collabs, songs, touched_s = dict(collabs), set(songs), set(touched_s)
    while True:
        bad = next((k for k in sorted(collabs) if k in touched_k and (
            len({c for i, c in cc if i == k}) < 2 or len({x for i, a, b in rl if i == k for x in (a, b)}) == 1)), None)
        if bad is not None:
            if collabs[bad] is not None:
                touched_s.add(collabs[bad])
            del collabs[bad]
            continue
        bad = next((s for s in sorted(songs) if s in touched_s and s not in {x for x, _ in cs}
                    and s not in collabs.values()), None)
        if bad is None:
            return set(collabs), songs
        songs.remove(bad)


@pytest.mark.parametrize("n", range(3))
def test_purge_after_equals_one_by_one(spark, loaded, n):
    rng = random.Random(n)
    collabs = {k: rng.choice([None, *range(8)]) for k in range(14)}
    cc = {(rng.randrange(14), rng.randrange(1, 6)) for _ in range(30)}
    rl = {(rng.randrange(14), *rng.sample(range(1, 5), 2)) for _ in range(12)} | {(0, 1, 1), (1, 2, 2)}
    cs = {(rng.randrange(8), rng.randrange(1, 6)) for _ in range(5)}
    touched_k, touched_s = set(rng.sample(range(14), 9)), set(rng.sample(range(8), 3))
    make = lambda name, data: spark.createDataFrame(data, SCHEMAS[name])
    import datetime as dt
    t = dict(loaded)
    t["Collaboration"] = make("Collaboration", [(k, f"k{k}", dt.date(2024, 1, 1), None, None, s) for k, s in collabs.items()])
    t["Song"] = make("Song", [(s, f"s{s}", 100, None) for s in range(8)])
    t["Collaboration_Contributor"] = make("Collaboration_Contributor", sorted(cc))
    t["RecordLabel_Collaboration"] = make("RecordLabel_Collaboration", [(a, b, k) for k, a, b in sorted(rl)])
    t["Contributor_Song"] = make("Contributor_Song", [(c, s, None) for s, c in sorted(cs)])
    t["Song_Genre"] = make("Song_Genre", [(s, "Pop") for s in range(8)])
    out = remove.purge_after(t, spark.createDataFrame([(k,) for k in touched_k], "CollaborationID long"),
                             spark.createDataFrame([(s,) for s in touched_s], "SongID long"))
    want_k, want_s = one_by_one(collabs, cc, rl, range(8), cs, touched_k, touched_s)
    assert {r[0] for r in out.tables["Collaboration"].select("CollaborationID").collect()} == want_k
    assert {r[0] for r in out.tables["Song"].select("SongID").collect()} == want_s
    assert {r[0] for r in out.tables["Song_Genre"].select("Song_SongID").collect()} == want_s
    gone = {(r["table"], r["id"]) for r in out.reports["purged"].collect()}
    assert gone == {("Collaboration", k) for k in set(collabs) - want_k} | {("Song", s) for s in set(range(8)) - want_s}


# ------------------------------------------------------------------ refreshed views

SONG_REQ = "seq BIGINT, SongID BIGINT, Title STRING, Duration INT, ReleaseDate DATE, Genres STRING, Contributors STRING"


def changes(spark, t):
    """(name, tables after, keyword arguments of touched_songs, of touched_collaborations)"""
    def stored(after):
        return {k: v if v is t[k] else v.cache() for k, v in after.items()}

    songs = spark.createDataFrame([(1, 1, "New title", 100, None, "Jazz", "P002")], SONG_REQ)
    yield "songs", stored(update.update_songs(t, songs).tables), dict(songs=songs), dict(songs=songs)
    people = spark.createDataFrame([(1, "P002", "Zed"), (2, "P005", "Yan")], "seq BIGINT, NIF STRING, Name STRING")
    yield "persons", stored(update.update_persons(t, people).tables), dict(persons=people), dict(persons=people)
    labels = t["RecordLabel"].where("RecordLabelID <= 2").withColumn("Name", F.concat("Name", F.lit(" Ltd"))).withColumn(
        "seq", F.col("RecordLabelID").cast("long"))
    yield "labels", stored(update.update_labels(t, labels).tables), None, dict(labels=labels)
    ids = spark.createDataFrame([(2,), (6,)], "ContributorID long")
    gone = t["Collaboration_Contributor"].join(ids, F.col("Contributor_ContributorID") == F.col("ContributorID")).select(
        F.col("Collaboration_CollaborationID").alias("CollaborationID")).distinct()
    yield "contributors", stored(remove.delete_contributors(t, ids).tables), dict(contributors=ids, collaborations=gone), \
        dict(contributors=ids)
    ids = spark.createDataFrame([(1,), (3,)], "CollaborationID long")
    yield "collaborations", stored(remove.delete_collaborations(t, ids).tables), dict(collaborations=ids), \
        dict(collaborations=ids)


def test_refreshed_views_equal_the_full_ones(spark, loaded):
    for name, after, by_song, by_collab in changes(spark, loaded):
        if by_song is not None:
            touched = refresh.touched_songs(loaded, after, **by_song)
            got = refresh.refresh_song_catalog(views.song_catalog(loaded), after, touched)
            assert rows(got) == rows(views.song_catalog(after)), name
        touched = refresh.touched_collaborations(loaded, after, **by_collab)
        got = refresh.refresh_collaboration_catalog(views.collaboration_catalog(loaded), after, touched)
        assert rows(got) == rows(views.collaboration_catalog(after)), name


def test_refresh_reduces_links_before_the_roll_up(spark, loaded):
    touched = spark.createDataFrame([(1,)], "SongID long")
    plan = refresh.refresh_song_catalog(views.song_catalog(loaded), loaded, touched)._jdf.queryExecution().optimizedPlan().toString()
    new = plan.split("Union", 1)[1]
    roll_ups = [part for part in new.split("Aggregate [_key") if "collect_list" in part]
    assert roll_ups and all("LeftSemi" in new[new.index(part):] for part in roll_ups)


# ------------------------------------------------------------------ versions

class Failing(dict):
    """Tables of which one fails while it is written."""


def broken(df):
    return df.select(*[F.raise_error(F.lit("stop")).cast(f.dataType).alias(f.name) if i == 0 else F.col(f.name)
                       for i, f in enumerate(df.schema.fields)])


def test_unchanged_tables_are_referenced(spark, loaded):
    path = tempfile.mkdtemp(prefix="rk-ver-", dir="/tmp")
    assert len(publish(loaded, path)) == 14
    first = read_version(spark, path)
    ids = spark.createDataFrame([(1,)], "CollaborationID long")
    change = remove.delete_collaborations(first, ids)
    written = publish(change.tables, path, base=first)
    assert sorted(written) == ["Collaboration", "Collaboration_Contributor", "RecordLabel_Collaboration"]
    newest = read_tables(spark, path)
    assert newest.number == 2 and newest.entries["Person"]["path"] == first.entries["Person"]["path"]
    assert newest["Collaboration"].count() == loaded["Collaboration"].count() - 1
    assert newest.entries["Collaboration"]["row_count"] == newest["Collaboration"].count()
    # the version a job reads is never written over
    assert read_tables(spark, path, version=1)["Collaboration"].count() == loaded["Collaboration"].count()
    assert [v for v, _, _ in published.manifests(spark, path)] == [1, 2]


def test_failure_half_way_leaves_the_old_version(spark, loaded):
    path = tempfile.mkdtemp(prefix="rk-ver-", dir="/tmp")
    publish(loaded, path)
    names = list(loaded)
    bad = {**loaded, names[5]: broken(loaded[names[5]])}
    with pytest.raises(Exception, match="stop"):
        publish(bad, path)
    now = read_version(spark, path)
    assert now.number == 1
    for name in names:
        assert rows(now[name]) == rows(loaded[name])
    with pytest.raises(FileNotFoundError):
        read_version(spark, path, 2)


def test_two_jobs_with_one_number(spark, loaded, monkeypatch):
    """A job that finds its number taken by a lesser id raises, and readers keep the other one."""
    path = tempfile.mkdtemp(prefix="rk-ver-", dir="/tmp")
    t = {"Song": loaded["Song"]}
    publish(t, path)
    real = published.manifests
    calls = []

    def late(spark_, path_):
        calls.append(1)
        return [] if len(calls) == 1 else real(spark_, path_)  # does not see version 1 yet

    class Id:
        hex = "f" * 40

    monkeypatch.setattr(published, "manifests", late)
    monkeypatch.setattr(published.uuid, "uuid4", lambda: Id)
    with pytest.raises(RuntimeError, match="another job"):
        publish({"Song": loaded["Song"].limit(1)}, path)
    monkeypatch.undo()
    assert read_version(spark, path)["Song"].count() == loaded["Song"].count()


# ------------------------------------------------------------------ trigrams

def test_trigram_search_equals_the_scan(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcAB ,é%_") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "ab", "Abc", "ABCABC", "abcab", "x" * 50000 + "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    index = trigrams.write_postings(df, "id", "text", tempfile.mkdtemp(prefix="rk-tri-", dir="/tmp") + "/i")
    for term in ["", "a", "ab", "abc", "ABCA", "b, c", "é%_", "zzzz", "aaa", "c c c"]:
        want = sorted(i for i, x in enumerate(texts) if x is not None and term.lower() in x.lower())
        assert sorted(r[0] for r in trigrams.contains(df, "id", "text", term, index).select("id").collect()) == want
        if len(term) >= 3:
            possible = {r[0] for r in trigrams.candidates(index, "id", term).collect()}
            assert set(want) <= possible
            assert len(possible) <= sum(x is not None and all(g in x.lower() for g in trigrams.grams_of(term)) for x in texts)
    assert "PushedFilters: [In(gram" in trigrams.candidates(index, "id", "abcd")._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ intake

def test_malformed_lines_keep_their_text_and_file(spark):
    path = tempfile.mkdtemp(prefix="rk-bad-", dir="/tmp")
    good = {"seq": 1, "NIF": " P1 ", "Name": "A", "Roles": "Artist"}
    lines = [json.dumps(good), '{"seq": 2, "NIF": "P2', '{"seq": "two", "NIF": "P3", "Name": "B", "Roles": "Artist"}', "[1, 2",
             json.dumps({"seq": 4, "NIF": "P4", "Roles": "Artist"})]
    with open(f"{path}/a.json", "w") as f:
        f.write("\n".join(lines) + "\n")
    valid, bad = read_requests(spark, path, "contributor")
    assert [(r.seq, r.NIF, r.Name) for r in valid.collect()] == [(1, "P1", "A")]
    assert sorted((r.seq or 0, r.reason, r.file, r.line or "") for r in bad.collect()) == sorted([
        (0, "malformed line", "a.json", lines[1]), (0, "malformed line", "a.json", lines[2]),
        (0, "malformed line", "a.json", lines[3]), (4, "Missing required fields: Name", "a.json", "")])


def test_label_lists_are_resolved_once(spark, loaded):
    import datetime as dt
    req = spark.createDataFrame([(1, "X", dt.date(2024, 1, 1), None, None, 999, "Nova Tunes, Nowhere, Sunset Beats", "P001"),
                                 (2, "Y", dt.date(2024, 1, 1), None, None, None, "Nova Tunes, Nowhere", "P001"),
                                 (3, "Z", dt.date(2024, 1, 1), None, None, 1, "Nova Tunes, Nowhere, Sunset Beats", "P001")],
                                "seq BIGINT, CollaborationName STRING, StartDate DATE, EndDate DATE, Description STRING, "
                                "SongID BIGINT, RecordLabels STRING, Contributors STRING")
    out = ingest.create_collaborations(loaded, req)
    assert sorted((r.seq, r.reason) for r in out.rejects.collect()) == [
        (1, "Song not found"), (2, "needs two labels"), (3, "unknown label Nowhere")]
    assert [tuple(r)[:2] for r in out.reports["label_links"].collect()] == [(2, 3)]
