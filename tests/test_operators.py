"""Edge cases of single operators on small inputs."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rosterkit.functions import contains_ci
from rosterkit.operators import ids, ingest, records, remove, search, update, views


def col(df, c):
    return sorted(r[0] for r in df.select(c).collect())


# ------------------------------------------------------------------ lists

def test_split_list_keeps_and_drops_empty(spark):
    req = spark.createDataFrame([(1, " Pop ,Dance "), (2, "Pop,,Dance"), (3, "Pop,Pop"), (4, None)],
                                "seq BIGINT, Genres STRING")
    raw = ingest.split_list(req, "Genres", "Genre", ["seq"])
    assert sorted(map(tuple, raw.collect())) == [
        (1, "Dance"), (1, "Pop"), (2, ""), (2, "Dance"), (2, "Pop"), (3, "Pop"), (3, "Pop")]
    clean = ingest.split_list(req, "Genres", "Genre", ["seq"], drop_empty=True, dedupe=True)
    assert sorted(map(tuple, clean.collect())) == [
        (1, "Dance"), (1, "Pop"), (2, "Dance"), (2, "Pop"), (3, "Pop")]


def test_assign_roles_unknown_and_case(spark, loaded):
    req = spark.createDataFrame([(1, 7, "Artist, Dancer"), (2, 8, "producer")],
                                "seq BIGINT, ContributorID BIGINT, Roles STRING")
    roles, rej = ingest.assign_roles(loaded, req)
    assert [tuple(r) for r in roles["Artist"].collect()] == [(7, "Artist_7")]
    assert col(roles["Producer"], "Contributor_ContributorID") == [8]
    assert [r.reason for r in rej.collect()] == ["unknown role Dancer"]


# ------------------------------------------------------------------ ids

def test_assign_ids_gap_free_in_order(spark):
    seqs = list(range(1000))
    random.Random(7).shuffle(seqs)
    batch = spark.createDataFrame([(s * 3, f"r{s}") for s in seqs], "seq BIGINT, v STRING").repartition(7)
    out = ids.assign_ids(batch, "id", ["seq"], 41, num_partitions=5)
    got = sorted((r.seq, r.id) for r in out.collect())
    assert [i for _, i in got] == list(range(42, 1042))


def test_assign_ids_after_table_max(spark, loaded):
    batch = spark.createDataFrame([(5,), (2,)], "seq BIGINT")
    out = ids.assign_ids(batch, "SongID", ["seq"], ids.max_id(loaded["Song"], "SongID"))
    assert sorted((r.seq, r.SongID) for r in out.collect()) == [(2, 10), (5, 11)]


# ------------------------------------------------------------------ identity resolution

REQ = "seq BIGINT, NIF STRING, Name STRING, DateOfBirth DATE, Email STRING, PhoneNumber STRING"


def test_classify_contributors(spark, loaded):
    d = dt.date
    req = spark.createDataFrame([
        (1, "P001", "Someone", None, None, None),
        (2, "P100", "New One", d(2000, 1, 1), None, None),
        (3, "P100", "Other", None, None, None),
    ], REQ)
    out = {r.seq: (r.Outcome, r.ExistingID, r.NewID)
           for r in ingest.classify_requests(loaded, req, "contributor").collect()}
    assert out[1] == ("EXISTING", 1, None)
    assert out[2] == ("NEW", None, 10)
    assert out[3] == ("EXISTING", 10, None)


def test_classify_employees_attach_conflict_and_empty_email(spark, loaded):
    p = {r.NIF: r for r in loaded["Person"].collect()}
    b, h = p["P002"], p["P008"]
    person = loaded["Person"].where("NIF = 'P003'").withColumn("Email", F.lit(None).cast("string"))
    t = dict(loaded)
    t["Person"] = loaded["Person"].where("NIF <> 'P003'").unionByName(person)
    c = p["P003"]
    req = spark.createDataFrame([
        (1, "P002", b.Name, b.DateOfBirth, b.Email, b.PhoneNumber),
        (2, "P008", h.Name + " X", h.DateOfBirth, h.Email, h.PhoneNumber),
        (3, "P003", c.Name, c.DateOfBirth, "", c.PhoneNumber),
    ], REQ)
    out = {r.seq: r.Outcome for r in ingest.classify_requests(t, req, "employee",
                                                              assign_new_ids=False).collect()}
    assert out == {1: "ATTACH", 2: "CONFLICT", 3: "ATTACH"}


def test_conflict_policy(spark, loaded):
    h = loaded["Person"].where("NIF = 'P008'").first()
    req = spark.createDataFrame([
        (1, "P008", "Hank New", h.DateOfBirth, h.Email, h.PhoneNumber, "Analyst", None,
         Decimal("1000.00"), dt.date(2024, 1, 1), 1, "overwrite")],
        REQ + ", JobTitle STRING, Department STRING, Salary DECIMAL(10,2), HireDate DATE, "
              "RecordLabelID INT, policy STRING")
    out = ingest.apply_requests(loaded, req, "employee")
    assert [tuple(r) for r in out.reports["resolutions"].collect()] == [
        (1, "P008", "overwrite", "Hank New")]
    assert out.tables["Person"].where("NIF = 'P008'").first().Name == "Hank New"
    assert col(out.tables["Employee"].where("Person_NIF = 'P008'"), "EmployeeID") == [6]


# ------------------------------------------------------------------ search

def test_contains_is_literal_and_case_insensitive(spark):
    df = spark.createDataFrame([("50% Off",), ("A_B",), ("AxB",), (None,)], "v STRING")
    assert col(df.where(contains_ci("v", "50%")), "v") == ["50% Off"]
    assert col(df.where(contains_ci("v", "a_b")), "v") == ["A_B"]
    assert col(df.where(contains_ci("v", "a_b", pattern=True)), "v") == ["AxB", "A_B"] or \
        col(df.where(contains_ci("v", "a_b", pattern=True)), "v") == ["A_B", "AxB"]


def test_search_unset_parameters_and_item_border(loaded):
    assert search.search_songs(loaded).count() == views.song_catalog(loaded).count()
    assert col(search.search_songs(loaded, genre="e, p"), "SongID") == [1]
    assert col(search.search_songs(loaded, genre_exact="Pop"), "SongID") == [1]
    assert col(search.search_songs(loaded, min_duration=200, max_duration=215), "SongID") == [1, 9]
    assert col(search.search_contributors(loaded, label="harmony"), "ContributorID") == [1]


# ------------------------------------------------------------------ updates

def test_update_persons_rejects(spark, loaded):
    req = spark.createDataFrame([(1, "P001", "A"), (2, "P001", "B"), (3, "P999", "C"), (4, "P002", None)],
                                "seq BIGINT, NIF STRING, Name STRING")
    out = update.update_persons(loaded, req)
    assert sorted((r.key, r.reason) for r in out.rejects.collect()) == [
        ("P001", "duplicate NIF in batch"), ("P001", "duplicate NIF in batch"),
        ("P002", "Name must not be NULL"), ("P999", "Person not found")]


def test_rekey_collision_and_carry(spark, loaded):
    m = spark.createDataFrame([(1, "P001", "P002"), (2, "P003", "Q003")],
                              "seq BIGINT, OldNIF STRING, NewNIF STRING")
    out = update.rekey_persons(loaded, m)
    assert [r.reason for r in out.rejects.collect()] == ["NIF already in use"]
    assert col(out.tables["Contributor"].where("ContributorID = 3"), "Person_NIF") == ["Q003"]
    assert "P003" not in col(out.tables["Person"], "NIF")


def test_update_songs_null_list_clears(spark, loaded):
    req = spark.createDataFrame([(1, 1, "Echoes", 215, None, "Rock, Rock", None)],
                                "seq BIGINT, SongID BIGINT, Title STRING, Duration INT, "
                                "ReleaseDate DATE, Genres STRING, Contributors STRING")
    t = update.update_songs(loaded, req).tables
    assert [tuple(r) for r in t["Song_Genre"].where("Song_SongID = 1").collect()] == [(1, "Rock")]
    assert t["Contributor_Song"].where("Song_SongID = 1").count() == 0


def test_collaboration_label_pairs(spark, loaded):
    req = spark.createDataFrame([
        (1, "New A", dt.date(2024, 1, 1), None, None, None, "Nova Tunes, Sunset Beats, SilverNote Music",
         "P001, P002"),
        (2, "New B", dt.date(2024, 1, 1), None, None, None, "Nova Tunes", None),
        (3, "Bad dates", dt.date(2024, 2, 1), dt.date(2024, 1, 1), None, None, None, None)],
        "seq BIGINT, CollaborationName STRING, StartDate DATE, EndDate DATE, Description STRING, "
        "SongID BIGINT, RecordLabels STRING, Contributors STRING")
    out = ingest.create_collaborations(loaded, req)
    pairs = sorted(tuple(r) for r in out.reports["label_links"].collect())
    assert pairs == [(2, 3, 8), (2, 5, 8)]
    reasons = sorted(r.reason for r in out.rejects.collect())
    assert reasons == ["EndDate before StartDate", "needs two labels"]


# ------------------------------------------------------------------ deletes

def test_delete_closure_cascade_and_restrict(spark, loaded):
    keys = spark.createDataFrame([(5,)], "SongID BIGINT")
    new_t, deleted, blocked = remove.delete_closure(loaded, {"Song": keys})
    assert new_t["Song_Genre"].where("Song_SongID = 5").count() == 0
    assert new_t["Contributor_Song"].where("Song_SongID = 5").count() == 0
    assert [tuple(r) for r in blocked().collect()] == [("Song", "5", "Collaboration")]


def test_delete_unknown_ids_rejected(spark, loaded):
    out = remove.delete_collaborations(loaded, spark.createDataFrame([(1,), (99,)], "CollaborationID BIGINT"))
    assert [r.key for r in out.rejects.collect()] == ["99"]
    assert 1 not in col(out.tables["Collaboration"], "CollaborationID")


# ------------------------------------------------------------------ records

def test_records(loaded):
    r = {x.CollaborationID: x for x in
         records.to_records(views.collaboration_catalog(loaded), "collaboration").collect()}
    assert r[1].StartDate == "2024-05-01" and r[1].RecordLabels == ["Nova Tunes"]
    assert r[2].RecordLabels == [] and r[2].EndDate is None


# ------------------------------------------------------------------ skew

def test_join_to_unique_splits_hot_keys(spark):
    from rosterkit.operators.joins import hot_keys, join_to_unique
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("v"))
    uniq = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    hot = {r.k: r._buckets for r in hot_keys(big, ["k"], 200).collect()}
    assert hot == {1: 6}                       # 1000 + 60 rows on key 1, 6 buckets of 200
    for how in ("inner", "left"):
        got = sorted(map(tuple, join_to_unique(big, uniq, "k", how, hot_rows=200).select("k", "v", "w").collect()),
                     key=lambda r: (r[1], r[0]))
        want = sorted(map(tuple, big.join(uniq, "k", how).select("k", "v", "w").collect()),
                      key=lambda r: (r[1], r[0]))
        assert got == want


def test_song_catalog_with_hot_song(spark, loaded):
    t = dict(loaded)
    extra = spark.range(100, 700).select(
        F.col("id").alias("CollaborationID"), F.concat(F.lit("C"), F.col("id").cast("string"))
        .alias("CollaborationName"), F.lit(dt.date(2024, 1, 1)).alias("StartDate"),
        F.lit(None).cast("date").alias("EndDate"), F.lit(None).cast("string").alias("Description"),
        F.lit(2).cast("bigint").alias("Song_SongID"))
    t["Collaboration"] = loaded["Collaboration"].unionByName(extra)
    spark.conf.set("rosterkit.skew.hotRows", "50")
    try:
        rows = views.song_catalog(t).where("SongID = 2").collect()
    finally:
        spark.conf.unset("rosterkit.skew.hotRows")
    assert len(rows) == 601
    assert {r.Genres for r in rows} == {"Acoustic, Indie"}


def test_employee_records_salary_text(loaded):
    r = {x.EmployeeID: x for x in
         records.to_records(views.employee_directory(loaded), "employee").collect()}
    assert r[1].SalaryText == "75000.00" and r[1].HireDate == "2023-01-15"


# ------------------------------------------------------------------ creates and updates

LABEL_REQ = "seq BIGINT, Name STRING, Location STRING, Website STRING, Email STRING, PhoneNumber STRING"


def test_create_labels_rejects(spark, loaded):
    req = spark.createDataFrame([
        (1, "New One", None, "https://n1", "a@x", "+1"),
        (2, "Nova Tunes", None, "https://n2", "b@x", "+2"),      # name already stored
        (3, "Twin", None, "https://n3", "c@x", "+3"),
        (4, "Twin", None, "https://n4", "d@x", "+4"),            # repeats seq 3
        (5, "No Mail", None, "https://n5", "", "+5")], LABEL_REQ)  # required field missing
    out = ingest.create_labels(loaded, req)
    assert sorted((r.RecordLabelID, r.Name) for r in out.reports["created"].collect()) == [
        (6, "New One"), (7, "Twin")]
    assert sorted((r.seq, r.reason) for r in out.rejects.collect()) == [
        (2, "Name already exists"), (4, "duplicate Name in batch"),
        (5, "Missing required fields: Email")]


def test_create_songs_links_and_unknown_nifs(spark, loaded):
    req = spark.createDataFrame([(1, "Tune", 100, None, "Pop, ,Pop", "P001, P404")],
                                "seq BIGINT, Title STRING, Duration INT, ReleaseDate DATE, "
                                "Genres STRING, Contributors STRING")
    out = ingest.create_songs(loaded, req, as_of=dt.date(2024, 1, 1))
    assert [tuple(r) for r in out.reports["genres"].collect()] == [(10, "Pop")]
    assert [tuple(r) for r in out.reports["links"].collect()] == [(1, 10, dt.date(2024, 1, 1))]
    assert [r.reason for r in out.rejects.collect()] == ["unknown NIF P404"]


def test_update_contributor_rekey_and_roles(spark, loaded):
    req = spark.createDataFrame([(1, 2, "Q002", "Bruno Mars", "Producer")],
                                "seq BIGINT, ContributorID BIGINT, NIF STRING, Name STRING, Roles STRING")
    t = update.update_contributors(loaded, req).tables
    assert col(t["Contributor"].where("ContributorID = 2"), "Person_NIF") == ["Q002"]
    assert "Q002" in col(t["Person"], "NIF") and "P002" not in col(t["Person"], "NIF")
    assert 2 not in col(t["Artist"], "Contributor_ContributorID")
    assert 2 in col(t["Producer"], "Contributor_ContributorID")
    assert 2 not in col(t["Artist_Genre"], "Artist_ContributorID")


def test_update_employees_rejects(spark, loaded):
    req = spark.createDataFrame([
        (1, 1, "Boss", None, Decimal("1.00"), dt.date(2024, 1, 1), 1),
        (2, 2, "Boss", None, Decimal("-5.00"), dt.date(2024, 1, 1), 1),
        (3, 3, "Boss", None, Decimal("5.00"), dt.date(2024, 1, 1), 99),
        (4, 42, "Boss", None, Decimal("5.00"), dt.date(2024, 1, 1), 1)],
        "seq BIGINT, EmployeeID BIGINT, JobTitle STRING, Department STRING, Salary DECIMAL(10,2), "
        "HireDate DATE, RecordLabelID INT")
    out = update.update_employees(loaded, req)
    assert sorted(r.reason for r in out.rejects.collect()) == [
        "Employee not found", "RecordLabel not found", "Salary must not be negative"]
    e = {r.EmployeeID: r for r in out.tables["Employee"].collect()}
    assert e[1].JobTitle == "Boss" and e[1].Salary == Decimal("1.00")
    assert e[2].JobTitle == "Sound Engineer"


def test_assign_ids_stable_across_actions(spark):
    batch = spark.range(500).select((F.col("id") * 7 % 500).alias("seq")).repartition(5)
    out = ids.assign_ids(batch, "id", ["seq"], 0, num_partitions=4)
    first = sorted(map(tuple, out.collect()))
    assert first == sorted(map(tuple, out.collect()))
    assert [i for _, i in sorted(first)] == list(range(1, 501))


def test_scale_settings():
    from rosterkit.plans import scale_settings
    s = scale_settings(100 * 2 ** 40, 8000)
    assert s["spark.sql.shuffle.partitions"] == "409600"
    assert scale_settings(10 ** 6, 8)["spark.sql.shuffle.partitions"] == "16"


def test_padded_keys_are_never_cut(spark):
    from rosterkit.functions.text import padded_key
    keys = [7, 1234567, 12345678, 123456789, 1234567890]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k bigint").select(
        padded_key("P", "k")).collect()]
    assert got == ["P0000007", "P1234567", "P12345678", "P123456789", "P1234567890"]
