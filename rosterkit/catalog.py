"""The query catalogue: one entry per operator key, ``(spark, sf_dir) -> DataFrame``.

Each entry builds the roster tables over the driver tables of
``sf_dir`` (lazily), builds its request batch if it has one, runs the
library operator over the whole tables and selects the reported columns.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import deps, ingest, quality, refresh, remove, search, trigrams, update, views
from .operators.records import to_records
from .plans.session import ensure_checkpoint_dir
from .sources import batches, publish, read_tables, read_version
from .sources.requests import read_requests
from .sources.star import read_driver, star_tables, stored_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn
    return wrap


def _t(spark, sf, **kw):
    return star_tables(spark, sf, **kw)


# ----------------------------------------------------------------------------- views

@query("dashboard_counts")
def q_dashboard_counts(spark, sf):
    return views.dashboard_counts(_t(spark, sf))


@query("label_catalog")
def q_label_catalog(spark, sf):
    return views.label_catalog(_t(spark, sf))


@query("label_dependency_counts")
def q_label_dependency_counts(spark, sf):
    return views.label_dependencies(_t(spark, sf))


@query("employee_directory")
def q_employee_directory(spark, sf):
    return views.employee_directory(_t(spark, sf))


@query("song_catalog")
def q_song_catalog(spark, sf):
    return views.song_catalog(_t(spark, sf))


@query("contributor_directory")
def q_contributor_directory(spark, sf):
    return views.contributor_directory(_t(spark, sf))


@query("collaboration_catalog")
def q_collaboration_catalog(spark, sf):
    return views.collaboration_catalog(_t(spark, sf))


# ----------------------------------------------------------------------------- search

@query("label_search")
def q_label_search(spark, sf):
    return search.search_labels(_t(spark, sf), name="nation_1", location="a")


@query("employee_search")
def q_employee_search(spark, sf):
    return search.search_employees(_t(spark, sf), department="build", job_title="man", nif="1")


@query("employee_salary_label")
def q_employee_salary_label(spark, sf):
    return search.search_employees(_t(spark, sf), min_salary=5000, label="_2")


@query("song_search")
def q_song_search(spark, sf):
    return search.search_songs(_t(spark, sf), title="ring", genre="promo", min_duration=50,
                               max_duration=300)


@query("song_duration_range")
def q_song_duration_range(spark, sf):
    return search.search_songs(_t(spark, sf), min_duration=100, max_duration=200)


@query("contributor_search")
def q_contributor_search(spark, sf):
    return search.search_contributors(_t(spark, sf), role="producer", nif="3")


@query("collaboration_search")
def q_collaboration_search(spark, sf):
    return search.search_collaborations(_t(spark, sf), name="urgent", label="nation_7")


@query("collaborations_on_date")
def q_collaborations_on_date(spark, sf):
    return search.search_collaborations(_t(spark, sf), start=_dt.date(1998, 10, 3))


@query("search_no_filters")
def q_search_no_filters(spark, sf):
    return search.search_collaborations(_t(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query("lookup_songs")
def q_lookup_songs(spark, sf):
    keys = batches.ids_where(read_driver(spark, sf)["part"], "p_partkey", 97, 5)
    return search.lookup_songs(_t(spark, sf), keys, "p_partkey")


@query("lookup_labels")
def q_lookup_labels(spark, sf):
    keys = batches.ids_where(read_driver(spark, sf)["supplier"], "s_suppkey", 4, 1, "s_nationkey")
    return search.lookup(views.label_catalog(_t(spark, sf)), "RecordLabelID", keys, "s_nationkey")


@query("lookup_employees")
def q_lookup_employees(spark, sf):
    keys = batches.ids_where(read_driver(spark, sf)["customer"], "c_custkey", 30, 0)
    return search.lookup(views.employee_directory(_t(spark, sf)), "EmployeeID", keys, "c_custkey")


@query("lookup_contributors")
def q_lookup_contributors(spark, sf):
    keys = batches.ids_where(read_driver(spark, sf)["supplier"], "s_suppkey", 7, 2)
    return search.lookup(views.contributor_directory(_t(spark, sf)), "ContributorID", keys, "s_suppkey")


@query("lookup_collaborations")
def q_lookup_collaborations(spark, sf):
    keys = batches.ids_where(read_driver(spark, sf)["orders"], "o_orderkey", 97, 5)
    return search.lookup_collaborations(_t(spark, sf), keys, "o_orderkey")


@query("person_lookup")
def q_person_lookup(spark, sf):
    d = read_driver(spark, sf)
    nifs = batches.ids_where(d["customer"], "c_custkey", 30, 0).select(
        batches.nif_of(F.col("c_custkey")).alias("NIF"))
    return search.lookup_persons(_t(spark, sf), nifs)


# ----------------------------------------------------------------------------- dependencies

@query("song_dependency_counts")
def q_song_dependency_counts(spark, sf):
    return deps.song_dependencies(_t(spark, sf))


@query("contributor_dependency_counts")
def q_contributor_dependency_counts(spark, sf):
    return deps.contributor_dependencies(_t(spark, sf))


@query("employee_dependency_counts")
def q_employee_dependency_counts(spark, sf):
    return deps.employee_dependencies(_t(spark, sf))


@query("labels_delete_blocked")
def q_labels_delete_blocked(spark, sf):
    t = _t(spark, sf)
    _, blocked = deps.split_deletable(t, batches.ids_where(t["RecordLabel"], "RecordLabelID", 10, 3))
    return blocked


@query("collaboration_label_members")
def q_collaboration_label_members(spark, sf):
    return deps.collaboration_label_members(_t(spark, sf)["RecordLabel_Collaboration"])


# ----------------------------------------------------------------------------- purges

def _songs_updated(spark, sf, t=None):
    """The tables after an update that clears the contributor lists of some songs."""
    t = t or _t(spark, sf)
    return update.update_songs(t, batches.song_updates(t), as_of=_dt.date(2024, 1, 1)).tables


@query("orphan_songs")
def q_orphan_songs(spark, sf):
    return remove.orphan_songs(_songs_updated(spark, sf))[0]


@query("orphan_songs_blocked")
def q_orphan_songs_blocked(spark, sf):
    return remove.purge_orphan_songs(_songs_updated(spark, sf)).reports["blocked"]


@query("underpopulated_collaborations")
def q_underpopulated_collaborations(spark, sf):
    return remove.purge_small_collaborations(_t(spark, sf)).reports["purged"]


@query("underlabelled_collaborations")
def q_underlabelled_collaborations(spark, sf):
    t = _t(spark, sf)
    return remove.purge_underlabelled(t, links=t["RLC_raw"]).reports["purged"]


# ----------------------------------------------------------------------------- deletes

@query("delete_labels_strict")
def q_delete_labels_strict(spark, sf):
    t = _t(spark, sf)
    created = ingest.create_labels(t, batches.label_creates(read_driver(spark, sf))).tables
    ids = batches.ids_where(created["RecordLabel"], "RecordLabelID", 10, 3)
    return remove.delete_labels(created, ids, mode="strict").tables["RecordLabel"].select(
        "RecordLabelID", "Name")


def _label_cascade(spark, sf):
    t = _t(spark, sf)
    return remove.delete_labels(t, batches.ids_where(t["RecordLabel"], "RecordLabelID", 10, 3),
                                mode="cascade").tables


@query("delete_labels_persons")
def q_delete_labels_persons(spark, sf):
    return _label_cascade(spark, sf)["Person"].select("NIF")


@query("delete_labels_collaborations")
def q_delete_labels_collaborations(spark, sf):
    return _label_cascade(spark, sf)["Collaboration"].select("CollaborationID")


@query("delete_songs_collaborations")
def q_delete_songs_collaborations(spark, sf):
    t = _t(spark, sf)
    out = remove.delete_songs(t, batches.ids_where(t["Song"], "SongID", 50, 7))
    return out.tables["Collaboration"].select("CollaborationID")


def _contrib_delete(spark, sf):
    t = _t(spark, sf)
    return remove.delete_contributors(t, batches.ids_where(t["Contributor"], "ContributorID", 10, 5))


@query("delete_contributors_collaborations")
def q_delete_contributors_collaborations(spark, sf):
    return _contrib_delete(spark, sf).tables["Collaboration"].select("CollaborationID")


@query("delete_contributors_songs")
def q_delete_contributors_songs(spark, sf):
    t = _t(spark, sf)
    most = t["Contributor"].where(F.col("ContributorID") % 10 != 5).select("ContributorID")
    return remove.delete_contributors(t, most).reports["songs"]


@query("delete_contributors_persons")
def q_delete_contributors_persons(spark, sf):
    return _contrib_delete(spark, sf).tables["Person"].select("NIF")


@query("delete_employees_persons")
def q_delete_employees_persons(spark, sf):
    t = _t(spark, sf)
    out = remove.delete_employees(t, batches.ids_where(t["Employee"], "EmployeeID", 20, 6))
    return out.tables["Person"].select("NIF")


@query("delete_collaborations_links")
def q_delete_collaborations_links(spark, sf):
    t = _t(spark, sf)
    out = remove.delete_collaborations(t, batches.ids_where(t["Collaboration"], "CollaborationID", 100, 9))
    return out.tables["Collaboration_Contributor"].select("Collaboration_CollaborationID",
                                                          "Contributor_ContributorID")


# ----------------------------------------------------------------------------- tokens and requests

@query("split_genre_tokens")
def q_split_genre_tokens(spark, sf):
    return ingest.split_list(batches.genre_lists(read_driver(spark, sf)), "Genres", "Genre", ["SongID"])


@query("resolve_contributor_tokens")
def q_resolve_contributor_tokens(spark, sf):
    items = ingest.split_list(batches.nif_lists(read_driver(spark, sf)), "Contributors", "NIF", ["seq"])
    known, _ = ingest.resolve_nifs(_t(spark, sf), items)
    return known.select("seq", "NIF", "ContributorID")


@query("request_validation")
def q_request_validation(spark, sf):
    req = batches.person_requests(read_driver(spark, sf))
    # the endpoint's own check: Name and Email
    return ingest.validate_requests(req, "label", strict_not_null=False).select("seq", "Missing")


@query("request_validation_strict")
def q_request_validation_strict(spark, sf):
    req = batches.person_requests(read_driver(spark, sf))
    return ingest.validate_requests(req, "label").select("seq", "Missing")


@query("create_labels")
def q_create_labels(spark, sf):
    t = _t(spark, sf)
    out = ingest.create_labels(t, batches.label_creates(read_driver(spark, sf)))
    return out.tables["RecordLabel"].select("RecordLabelID", "Name")


def _song_create(spark, sf):
    return ingest.create_songs(_t(spark, sf), batches.song_creates(read_driver(spark, sf)),
                               as_of=_dt.date(2024, 1, 1))


@query("create_songs")
def q_create_songs(spark, sf):
    return _song_create(spark, sf).reports["created"].select("SongID", "Title", "Duration")


@query("create_songs_links")
def q_create_songs_links(spark, sf):
    return _song_create(spark, sf).reports["links"]


@query("contributor_requests_classified")
def q_contributor_requests_classified(spark, sf):
    c = ingest.classify_requests(_t(spark, sf), batches.contributor_requests(read_driver(spark, sf)),
                                 "contributor")
    return c.select("seq", "NIF", "Outcome", "ExistingID")


@query("employee_requests_classified")
def q_employee_requests_classified(spark, sf):
    c = ingest.classify_requests(_t(spark, sf), batches.employee_requests(read_driver(spark, sf)),
                                 "employee")
    return c.select("seq", "NIF", "Outcome", "ExistingID")


@query("attach_contributors")
def q_attach_contributors(spark, sf):
    t = _t(spark, sf)
    c = ingest.classify_requests(t, batches.contributor_requests(read_driver(spark, sf)), "contributor")
    return ingest.attach(t, c, "contributor").reports["created"]


@query("contributor_conflicts")
def q_contributor_conflicts(spark, sf):
    t = _t(spark, sf)
    c = ingest.classify_requests(t, batches.contributor_requests(read_driver(spark, sf)), "contributor",
                                 assign_new_ids=False)
    return ingest.conflict_report(t, c).select("seq", "NIF", "ExistingName", "IncomingName",
                                               "ExistingEmail", "IncomingEmail")


@query("apply_conflict_policy")
def q_apply_conflict_policy(spark, sf):
    out = ingest.apply_requests(_t(spark, sf), batches.employee_requests(read_driver(spark, sf)),
                                "employee")
    return out.reports["resolutions"]


@query("assign_artist_roles")
def q_assign_artist_roles(spark, sf):
    roles, _ = ingest.assign_roles(_t(spark, sf), batches.role_requests(read_driver(spark, sf)))
    return roles["Artist"]


@query("create_collaborations_links")
def q_create_collaborations_links(spark, sf):
    out = ingest.create_collaborations(_t(spark, sf), batches.collaboration_creates(read_driver(spark, sf)))
    return out.reports["contributor_links"]


# ----------------------------------------------------------------------------- updates

def _person_update(spark, sf):
    return update.update_persons(_t(spark, sf), batches.person_updates(read_driver(spark, sf)))


@query("update_persons")
def q_update_persons(spark, sf):
    return _person_update(spark, sf).tables["Person"].select("NIF", "Name", "Email")


@query("update_persons_rejects")
def q_update_persons_rejects(spark, sf):
    return _person_update(spark, sf).rejects.select(F.col("key").alias("NIF"),
                                                    F.col("reason").alias("Reason"))


@query("update_labels")
def q_update_labels(spark, sf):
    t = _t(spark, sf)
    return update.update_labels(t, batches.label_updates(t)).tables["RecordLabel"].select(
        "RecordLabelID", "Name", "Location")


@query("update_songs_genres")
def q_update_songs_genres(spark, sf):
    t = _t(spark, sf)
    return update.update_songs(t, batches.song_updates(t), as_of=_dt.date(2024, 1, 1)).tables["Song_Genre"]


@query("update_contributor_roles")
def q_update_contributor_roles(spark, sf):
    t = _t(spark, sf)
    return update.update_contributors(t, batches.contributor_role_updates(t)).tables["Producer"]


@query("update_employees")
def q_update_employees(spark, sf):
    t = _t(spark, sf)
    return update.update_employees(t, batches.employee_updates(t)).tables["Employee"].select(
        "EmployeeID", "JobTitle", "Salary")


@query("rekey_persons")
def q_rekey_persons(spark, sf):
    out = update.rekey_persons(_t(spark, sf), batches.nif_changes(read_driver(spark, sf)))
    nt = out.tables
    c = nt["Contributor"].select(F.col("Person_NIF").alias("NIF"), "ContributorID")
    e = nt["Employee"].select(F.col("Person_NIF").alias("NIF"), "EmployeeID")
    return out.reports["keys"].join(c, "NIF", "left").join(e, "NIF", "left").select(
        "OldNIF", "NIF", "ContributorID", "EmployeeID")


@query("update_collaborations_contributors")
def q_update_collaborations_contributors(spark, sf):
    t = _t(spark, sf)
    out = update.update_collaborations(t, batches.collaboration_updates(t))
    return out.tables["Collaboration_Contributor"]


# ----------------------------------------------------------------------------- verdicts

@query("rekey_chains")
def q_rekey_chains(spark, sf):
    return update.rekey_persons(_t(spark, sf), batches.nif_chains(read_driver(spark, sf))).reports["keys"]


@query("create_labels_conflicts")
def q_create_labels_conflicts(spark, sf):
    out = ingest.create_labels(_t(spark, sf), batches.label_conflicts(read_driver(spark, sf)))
    return out.reports["created"].select("RecordLabelID", "Name", "Email")


@query("create_labels_conflicts_rejects")
def q_create_labels_conflicts_rejects(spark, sf):
    out = ingest.create_labels(_t(spark, sf), batches.label_conflicts(read_driver(spark, sf)))
    return out.rejects.select("seq", "reason")


@query("update_persons_emails")
def q_update_persons_emails(spark, sf):
    out = update.update_persons(_t(spark, sf), batches.email_moves(read_driver(spark, sf)))
    return out.tables["Person"].select("NIF", "Email")


@query("employee_requests_refused")
def q_employee_requests_refused(spark, sf):
    t = _t(spark, sf)
    out = ingest.apply_requests(t, batches.faulty_employee_requests(read_driver(spark, sf), t), "employee")
    return out.rejects.select("seq", "reason")


@query("update_contributors_keys")
def q_update_contributors_keys(spark, sf):
    t = _t(spark, sf)
    nt = update.update_contributors(t, batches.contributor_key_updates(t)).tables
    producer = nt["Producer"].select(F.col("Contributor_ContributorID").alias("ContributorID"), F.lit(True).alias("_p"))
    return nt["Contributor"].join(nt["Person"].select(F.col("NIF").alias("Person_NIF"), "Name"), "Person_NIF").join(
        producer, "ContributorID", "left").select("ContributorID", F.col("Person_NIF").alias("NIF"), "Name",
                                                  F.coalesce("_p", F.lit(False)).alias("IsProducer"))


# ----------------------------------------------------------------------------- what follows a change

@query("purge_after_updates")
def q_purge_after_updates(spark, sf):
    base = stored_tables(spark, _t(spark, sf), ("Song", "Collaboration", "Collaboration_Contributor", "Contributor_Song",
                                                "RecordLabel_Collaboration"))
    t = _songs_updated(spark, sf, base)
    thin = batches.thinned_collaborations(t)
    t = update.update_collaborations(t, thin).tables
    songs = batches.song_updates(base).select("SongID")
    return remove.purge_after(t, thin.select("CollaborationID"), songs).reports["purged"].select("table", "id")


@query("song_catalog_refreshed")
def q_song_catalog_refreshed(spark, sf):
    t = _t(spark, sf)
    requests = batches.song_updates(t)
    after = update.update_songs(t, requests, as_of=_dt.date(2024, 1, 1)).tables
    touched = refresh.touched_songs(t, after, songs=requests)
    return refresh.refresh_song_catalog(views.song_catalog(t), after, touched)


@query("collaboration_catalog_refreshed")
def q_collaboration_catalog_refreshed(spark, sf):
    t = stored_tables(spark, _t(spark, sf), ("Collaboration", "Collaboration_Contributor", "RecordLabel_Collaboration"))
    requests = batches.collaboration_updates(t)
    after = update.update_collaborations(t, requests).tables
    touched = refresh.touched_collaborations(t, after, collaborations=requests)
    return refresh.refresh_collaboration_catalog(views.collaboration_catalog(t), after, touched)


# ----------------------------------------------------------------------------- stored forms

def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("published_employee_directory")
def q_published_employee_directory(spark, sf):
    """Two versions: the tables, then an update of which only the changed table is written."""
    path, t = _folder(spark, "published"), _t(spark, sf)
    publish({k: t[k] for k in ("RecordLabel", "Person", "Employee")}, path)
    first = read_version(spark, path)
    publish(update.update_employees(first, batches.employee_updates(first)).tables, path, base=first)
    return views.employee_directory(read_tables(spark, path))


@query("song_title_trigrams")
def q_song_title_trigrams(spark, sf):
    songs = _t(spark, sf)["Song"]
    index = trigrams.write_postings(songs, "SongID", "Title", _folder(spark, "trigrams"))
    return trigrams.contains(songs, "SongID", "Title", "ring", index)


@query("contributor_list_trigrams")
def q_contributor_list_trigrams(spark, sf):
    """A term across an item border of the rolled-up list."""
    # the view is stored: the index and the search read it, neither rolls the lists up again
    view = views.song_lists(_t(spark, sf)).select("SongID", "Contributors")
    path = _folder(spark, "song-lists")
    view.write.parquet(path)
    lists = spark.read.schema(view.schema).parquet(path)
    index = trigrams.write_postings(lists, "SongID", "Contributors", _folder(spark, "trigrams"))
    return trigrams.contains(lists, "SongID", "Contributors", "3, customer", index).select("SongID")


@query("request_intake_rejects")
def q_request_intake_rejects(spark, sf):
    path = _folder(spark, "intake")
    batches.request_lines(read_driver(spark, sf)).write.text(path)
    return read_requests(spark, path, "contributor")[1].select("seq", "reason", "line")


@query("contributors_sorted")
def q_contributors_sorted(spark, sf):
    return search.search_contributors(_t(spark, sf), sort=True)


# ----------------------------------------------------------------------------- quality checks

@query("qc_pk_duplicates")
def q_qc_pk_duplicates(spark, sf):
    return quality.duplicate_keys(read_driver(spark, sf)["lineitem"], ["l_orderkey", "l_linenumber"])


@query("qc_unique_values")
def q_qc_unique_values(spark, sf):
    return quality.unique_violations(read_driver(spark, sf)["part"], "p_name")


@query("qc_fk_song_genre")
def q_qc_fk_song_genre(spark, sf):
    # genre rows that a delete of songs without its cascade would leave behind
    t = _t(spark, sf)
    songs = remove.delete_songs(t, batches.ids_where(t["Song"], "SongID", 50, 7)).tables["Song"]
    return quality.fk_violations(t["Song_Genre"], songs, ["Song_SongID"], ["SongID"])


@query("qc_not_null")
def q_qc_not_null(spark, sf):
    return quality.not_null_violations(_t(spark, sf)["Person"], ["NIF"], ["Email", "PhoneNumber"])


@query("qc_date_order")
def q_qc_date_order(spark, sf):
    d = read_driver(spark, sf)
    j = d["orders"].select("o_orderkey", "o_orderdate").join(
        d["lineitem"].select("l_orderkey", "l_linenumber", "l_shipdate"),
        F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.date_order_violations(j, "o_orderdate", "l_shipdate").select("o_orderkey",
                                                                                 "l_linenumber")


@query("qc_salary")
def q_qc_salary(spark, sf):
    return quality.check_violations(read_driver(spark, sf)["customer"], "c_acctbal >= 0").select(
        "c_custkey", "c_acctbal")


@query("qc_self_link")
def q_qc_self_link(spark, sf):
    return quality.check_violations(_t(spark, sf)["RLC_raw"],
                                    "RecordLabel_RecordLabelID1 <> RecordLabel_RecordLabelID2")


@query("qc_text_length")
def q_qc_text_length(spark, sf):
    return quality.length_violations(_t(spark, sf)["Collaboration"], "CollaborationName", 24).select(
        "CollaborationID", "n")


# ----------------------------------------------------------------------------- records

@query("collaboration_records")
def q_collaboration_records(spark, sf):
    r = to_records(views.collaboration_catalog(_t(spark, sf)), "collaboration")
    return r.select("CollaborationID", "StartDate", "EndDate",
                    F.array_join("Contributors", "|").alias("Contributors"),
                    F.size("RecordLabels").cast("bigint").alias("LabelCount"))


@query("employee_records")
def q_employee_records(spark, sf):
    return to_records(views.employee_directory(_t(spark, sf)), "employee").drop("Salary")


@query("contributor_records")
def q_contributor_records(spark, sf):
    return to_records(views.contributor_directory(_t(spark, sf)), "contributor")


@query("song_records")
def q_song_records(spark, sf):
    return to_records(views.song_catalog(_t(spark, sf)), "song")


@query("label_records")
def q_label_records(spark, sf):
    return to_records(views.label_catalog(_t(spark, sf)), "label")
