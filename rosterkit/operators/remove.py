"""Set-based deletes and purge rules (DL-1 … DL-7, PG-1 … PG-4).

A delete request is a DataFrame of keys, not one id.  Every step is a
semi or anti join against de-duplicated key sets (the map side drops
repeated keys before the shuffle), so a parent with a huge share of
children never moves more than one key row per task.  Foreign-key rules
come from ``sources.schema``; cascades are followed in topological
order in one pass (the FK graph is acyclic).  Purges run over the final
state of a job, not after each row: as whole-table jobs, or
(``purge_after``) from the parents a change touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir
from ..sources.schema import FOREIGN_KEYS, TOPOLOGICAL_ORDER, foreign_keys_of, pk
from . import deps
from ..sources.lazy import LazyTables
from .changes import ChangeSet, empty_rejects, lazy_reports, rejects, union_all, with_tables
from .joins import join_to_unique

Tables = dict[str, DataFrame]


# --------------------------------------------------------------------------- closure

def delete_closure(t: Tables, deletes: dict[str, DataFrame]):
    """DL-7: apply delete rules to sets of deleted keys.

    ``deletes`` maps a table to a DataFrame holding its key columns.
    Returns (new tables, deleted keys per table, blocked) where
    ``blocked()`` lists restrict references that would survive: rows of a
    child that still point at a deleted parent (table, key, child).
    Which tables are affected follows from the FK graph alone; each
    table's deleted keys and new version are built only when read, so a
    caller that needs one table does not plan fourteen.
    """
    spark = next(iter(deletes.values())).sparkSession
    affected: list[str] = []
    for table in TOPOLOGICAL_ORDER:
        if table in t and (table in deletes or any(
                fk.on_delete == "cascade" and fk.parent in affected
                for fk in foreign_keys_of(table))):
            affected.append(table)
    cache: dict[str, DataFrame] = {}

    def parent_keys_of(fk):
        return deleted_keys(fk.parent).select(
            *[F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns)])

    def deleted_keys(table: str) -> DataFrame:
        if table in cache:
            return cache[table]
        key = pk(table)
        parts = []
        if table in deletes:
            parts.append(deletes[table].select(*key))
        for fk in foreign_keys_of(table):
            if fk.on_delete != "cascade" or fk.parent not in affected:
                continue
            child = t[table].select(*dict.fromkeys(key + list(fk.columns)))
            if set(fk.columns) >= set(key):
                # at most one child row per parent (the FK is the key): no hot parent
                parts.append(child.join(parent_keys_of(fk), list(fk.columns), "left_semi")
                             .select(*key))
            else:
                # a parent holding a huge share of the child rows is split (joins.join_to_unique)
                parts.append(join_to_unique(child, parent_keys_of(fk), list(fk.columns), "left_semi")
                             .select(*key))
        cache[table] = union_all(parts).distinct()
        return cache[table]

    def new_version(name: str) -> DataFrame:
        if name not in affected:
            return t[name]
        return t[name].join(deleted_keys(name), pk(name), "left_anti")

    def blocked() -> DataFrame:
        out = []
        for fk in FOREIGN_KEYS:
            if fk.on_delete != "restrict" or fk.parent not in affected or fk.child not in t:
                continue
            refs = t[fk.child].join(parent_keys_of(fk), list(fk.columns), "left_semi")
            if fk.child in affected:
                refs = refs.join(deleted_keys(fk.child), pk(fk.child), "left_anti")
            out.append(refs.select(
                F.lit(fk.parent).alias("table"),
                F.concat_ws(",", *[F.col(c).cast("string") for c in fk.columns]).alias("key"),
                F.lit(fk.child).alias("child")))
        if out:
            return union_all(out)
        return spark.createDataFrame([], "table STRING, key STRING, child STRING")

    new_t = LazyTables({name: (lambda name=name: new_version(name)) for name in t})
    deleted = LazyTables({name: (lambda name=name: deleted_keys(name)) for name in affected})
    return new_t, deleted, blocked


def _ids(ids: DataFrame, col: str, as_col: str) -> DataFrame:
    return ids.select(F.col(col).alias(as_col)).distinct()


def _unused_persons(t: Tables, nifs: DataFrame) -> DataFrame:
    """NIFs (column NIF) that neither an employee nor a contributor uses."""
    return (nifs.select("NIF").distinct()
            .join(t["Employee"].select(F.col("Person_NIF").alias("NIF")).distinct(), "NIF", "left_anti")
            .join(t["Contributor"].select(F.col("Person_NIF").alias("NIF")).distinct(), "NIF",
                  "left_anti"))


# --------------------------------------------------------------------------- labels

def delete_labels(t: Tables, ids: DataFrame, mode: str = "strict", ids_col: str = "RecordLabelID",
                  side: str = "id2") -> ChangeSet:
    """DL-1 (strict) and DL-2 (cascade) label deletes.

    strict: labels with employees or ID2-side links are kept and reported
    (``reports['blocked']`` with their counts); links on the ID1 side
    cascade.  cascade: employees of the labels go, then their persons if
    no longer used, then every collaboration linked to a label on either
    side (with its links), then the labels.
    """
    spark = ids.sparkSession
    req = _ids(ids, ids_col, "RecordLabelID")
    known = req.join(t["RecordLabel"].select("RecordLabelID"), "RecordLabelID", "left_semi")
    not_found = rejects(req.join(known, "RecordLabelID", "left_anti"), "RecordLabel",
                        "RecordLabelID", "RecordLabel not found")
    if mode == "strict":
        deletable, blocked = deps.split_deletable(t, known, side=side)
        new_t, _, _ = delete_closure(t, {"RecordLabel": deletable})
        rej = union_all([not_found, rejects(blocked, "RecordLabel", "RecordLabelID",
                                            "RecordLabel has dependencies")])
        return ChangeSet(new_t, rej, {"blocked": blocked, "deleted": deletable})
    if mode != "cascade":
        raise ValueError(f"mode must be 'strict' or 'cascade', not {mode!r}")

    # a label employing a huge share of the staff is split (joins.join_to_unique)
    emp = join_to_unique(t["Employee"], known.select(F.col("RecordLabelID").alias(
        "RecordLabel_RecordLabelID")), "RecordLabel_RecordLabelID", "left_semi")
    links = t["RecordLabel_Collaboration"]
    # JN-8: an OR over two key columns becomes one equi semi join on the
    # unpivoted columns (no nested-loop join).
    touching = links.select(
        "Collaboration_CollaborationID",
        F.explode(F.array("RecordLabel_RecordLabelID1", "RecordLabel_RecordLabelID2"))
        .alias("RecordLabelID"))
    touching = join_to_unique(touching, known, "RecordLabelID", "left_semi")
    collabs = touching.select(F.col("Collaboration_CollaborationID").alias("CollaborationID")).distinct()
    after_emp = with_tables(t, Employee=t["Employee"].join(
        emp.select("EmployeeID"), "EmployeeID", "left_anti"))
    persons = _unused_persons(after_emp, emp.select(F.col("Person_NIF").alias("NIF")))
    new_t, deleted, blocked = delete_closure(t, {
        "RecordLabel": known, "Employee": emp.select("EmployeeID"), "Person": persons,
        "Collaboration": collabs})
    return ChangeSet(new_t, not_found.unionByName(empty_rejects(spark)),
                     lazy_reports(deleted_collaborations=collabs, deleted_persons=persons,
                                  blocked=blocked))


# --------------------------------------------------------------------------- songs

def delete_songs(t: Tables, ids: DataFrame, ids_col: str = "SongID") -> ChangeSet:
    """DL-3: delete the songs' collaborations (and their links), then the songs."""
    req = _ids(ids, ids_col, "SongID")
    known = req.join(t["Song"].select("SongID"), "SongID", "left_semi")
    not_found = rejects(req.join(known, "SongID", "left_anti"), "Song", "SongID", "Song not found")
    collabs = join_to_unique(t["Collaboration"].select("CollaborationID", "Song_SongID"),
                             known.select(F.col("SongID").alias("Song_SongID")), "Song_SongID",
                             "left_semi").select("CollaborationID")
    new_t, _, blocked = delete_closure(t, {"Song": known, "Collaboration": collabs})
    return ChangeSet(new_t, not_found, lazy_reports(deleted_collaborations=collabs, blocked=blocked))


# --------------------------------------------------------------------------- contributors

def delete_contributors(t: Tables, ids: DataFrame, ids_col: str = "ContributorID") -> ChangeSet:
    """DL-4: remove contributors with their links and roles.

    Collaborations they touched that keep at most one contributor are
    deleted; songs they touched that keep no contributor are deleted
    unless a surviving collaboration still uses them (then 'blocked',
    FK restrict).  Persons left without employee or contributor go.
    ``reports['songs']``: every song with Status kept / blocked / deleted.
    """
    req = _ids(ids, ids_col, "ContributorID")
    known = req.join(t["Contributor"].select("ContributorID"), "ContributorID", "left_semi")
    not_found = rejects(req.join(known, "ContributorID", "left_anti"), "Contributor",
                        "ContributorID", "Contributor not found")
    by_contrib = known.select(F.col("ContributorID").alias("Contributor_ContributorID"))

    # one skew-safe flag join per link table (a deleted contributor may hold a
    # huge share of the links); the semi and anti parts are filters on the flag
    flag = by_contrib.withColumn("_gone", F.lit(True))
    cc = join_to_unique(t["Collaboration_Contributor"], flag, "Contributor_ContributorID", "left")
    gone_cc = F.col("_gone").isNotNull()
    touched_c = cc.where(gone_cc).select(
        F.col("Collaboration_CollaborationID").alias("CollaborationID")).distinct()
    remaining_cc = cc.where(~gone_cc).drop("_gone")
    left_per_c = (remaining_cc.join(touched_c.select(
        F.col("CollaborationID").alias("Collaboration_CollaborationID")),
        "Collaboration_CollaborationID", "left_semi")
        .groupBy(F.col("Collaboration_CollaborationID").alias("CollaborationID"))
        .agg(F.count(F.lit(1)).alias("_left")))
    del_collabs = (touched_c.join(left_per_c, "CollaborationID", "left")
                   .where(F.coalesce(F.col("_left"), F.lit(0)) <= 1).select("CollaborationID"))

    cs = join_to_unique(t["Contributor_Song"], flag, "Contributor_ContributorID", "left")
    gone_cs = F.col("_gone").isNotNull()
    touched_s = cs.where(gone_cs).select(F.col("Song_SongID").alias("SongID")).distinct()
    still_linked = cs.where(~gone_cs).select(F.col("Song_SongID").alias("SongID")).distinct()
    empty_songs = touched_s.join(still_linked, "SongID", "left_anti")
    surviving_k = t["Collaboration"].join(del_collabs, "CollaborationID", "left_anti")
    used = surviving_k.where(F.col("Song_SongID").isNotNull()).select(
        F.col("Song_SongID").alias("SongID")).distinct()
    blocked_songs = empty_songs.join(used, "SongID", "left_semi")
    del_songs = empty_songs.join(used, "SongID", "left_anti")

    nifs = t["Contributor"].join(known, "ContributorID", "left_semi").select(
        F.col("Person_NIF").alias("NIF"))
    after = with_tables(t, Contributor=t["Contributor"].join(known, "ContributorID", "left_anti"))
    persons = _unused_persons(after, nifs)

    links_cc = cc.where(gone_cc).select("Collaboration_CollaborationID", "Contributor_ContributorID")
    links_cs = cs.where(gone_cs).select("Contributor_ContributorID", "Song_SongID")
    new_t, _, blocked = delete_closure(t, {
        "Contributor": known, "Collaboration_Contributor": links_cc, "Contributor_Song": links_cs,
        "Collaboration": del_collabs, "Song": del_songs, "Person": persons})

    status = (t["Song"].select("SongID")
              .join(blocked_songs.withColumn("_b", F.lit(True)), "SongID", "left")
              .join(del_songs.withColumn("_d", F.lit(True)), "SongID", "left")
              .select("SongID", F.when(F.col("_b"), "blocked").when(F.col("_d"), "deleted")
                      .otherwise("kept").alias("Status")))
    rej = not_found.unionByName(rejects(blocked_songs, "Song", "SongID",
                                        "Song still used by a collaboration", seq="-"))
    return ChangeSet(new_t, rej, lazy_reports(songs=status, deleted_collaborations=del_collabs,
                                              deleted_persons=persons, blocked=blocked))


# --------------------------------------------------------------------------- employees

def delete_employees(t: Tables, ids: DataFrame, ids_col: str = "EmployeeID") -> ChangeSet:
    """DL-5: delete employees, then their persons if no longer used."""
    req = _ids(ids, ids_col, "EmployeeID")
    emp = t["Employee"].join(req, "EmployeeID", "left_semi")
    not_found = rejects(req.join(emp.select("EmployeeID"), "EmployeeID", "left_anti"), "Employee",
                        "EmployeeID", "Employee not found")
    after = with_tables(t, Employee=t["Employee"].join(req, "EmployeeID", "left_anti"))
    persons = _unused_persons(after, emp.select(F.col("Person_NIF").alias("NIF")))
    new_t, _, _ = delete_closure(t, {"Employee": emp.select("EmployeeID"), "Person": persons})
    return ChangeSet(new_t, not_found, {"deleted_persons": persons})


# --------------------------------------------------------------------------- collaborations

def delete_collaborations(t: Tables, ids: DataFrame, ids_col: str = "CollaborationID") -> ChangeSet:
    """DL-6: delete collaborations; their label and contributor links cascade."""
    req = _ids(ids, ids_col, "CollaborationID")
    known = req.join(t["Collaboration"].select("CollaborationID"), "CollaborationID", "left_semi")
    not_found = rejects(req.join(known, "CollaborationID", "left_anti"), "Collaboration",
                        "CollaborationID", "Collaboration not found")
    new_t, _, _ = delete_closure(t, {"Collaboration": known})
    return ChangeSet(new_t, not_found, {})


# --------------------------------------------------------------------------- purges

def orphan_songs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(songs without contributor links, those of them a collaboration uses)."""
    linked = t["Contributor_Song"].select(F.col("Song_SongID").alias("SongID")).distinct()
    orphans = t["Song"].select("SongID").join(linked, "SongID", "left_anti")
    used = t["Collaboration"].where(F.col("Song_SongID").isNotNull()).select(
        F.col("Song_SongID").alias("SongID")).distinct()
    return orphans, orphans.join(used, "SongID", "left_semi")


def purge_orphan_songs(t: Tables, on_blocked: str = "reject") -> ChangeSet:
    """PG-1: delete songs without contributors.

    Songs still used by a collaboration cannot go (FK restrict); with
    ``on_blocked='reject'`` they are listed in rejects, with ``'skip'``
    they are only kept.
    """
    orphans, blocked = orphan_songs(t)
    deletable = orphans.join(blocked, "SongID", "left_anti")
    new_t, _, _ = delete_closure(t, {"Song": deletable})
    rej = (rejects(blocked, "Song", "SongID", "Song still used by a collaboration", seq="-")
           if on_blocked == "reject" else empty_rejects(t["Song"].sparkSession))
    return ChangeSet(new_t, rej, {"orphans": orphans, "blocked": blocked, "deleted": deletable})


def small_collaborations(t: Tables, min_contributors: int = 2) -> DataFrame:
    """(CollaborationID, n) with fewer than ``min_contributors`` contributors (0 included)."""
    counts = t["Collaboration_Contributor"].groupBy(
        F.col("Collaboration_CollaborationID").alias("CollaborationID")).agg(
        F.count("Contributor_ContributorID").alias("n"))
    return (t["Collaboration"].select("CollaborationID").join(counts, "CollaborationID", "left")
            .select("CollaborationID", F.coalesce("n", F.lit(0)).alias("n"))
            .where(F.col("n") < min_contributors))


def purge_small_collaborations(t: Tables, min_contributors: int = 2) -> ChangeSet:
    """PG-2: delete collaborations with fewer than two contributors."""
    small = small_collaborations(t, min_contributors)
    new_t, _, _ = delete_closure(t, {"Collaboration": small.select("CollaborationID")})
    return ChangeSet(new_t, empty_rejects(small.sparkSession), {"purged": small})


def underlabelled_collaborations(links: DataFrame, min_labels: int = 2) -> DataFrame:
    """(CollaborationID, n distinct labels over both columns) with n < ``min_labels``.

    Collaborations without any link row are not listed (as in the rule).
    """
    members = deps.collaboration_label_members(links)
    return (members.groupBy("CollaborationID").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") < min_labels))


def purge_underlabelled(t: Tables, links: DataFrame | None = None, min_labels: int = 2) -> ChangeSet:
    """PG-3: delete collaborations whose links name fewer than two labels."""
    few = underlabelled_collaborations(links if links is not None
                                       else t["RecordLabel_Collaboration"], min_labels)
    new_t, _, _ = delete_closure(t, {"Collaboration": few.select("CollaborationID")})
    return ChangeSet(new_t, empty_rejects(few.sparkSession), {"purged": few})


def purge_unused_persons(t: Tables, nifs: DataFrame | None = None, nif_col: str = "NIF") -> ChangeSet:
    """PG-4: delete persons with neither an employee nor a contributor record."""
    cand = t["Person"].select("NIF") if nifs is None else nifs.select(F.col(nif_col).alias("NIF"))
    unused = _unused_persons(t, cand).join(t["Person"].select("NIF"), "NIF", "left_semi")
    new_t, _, _ = delete_closure(t, {"Person": unused})
    return ChangeSet(new_t, empty_rejects(unused.sparkSession), {"purged": unused})


def purge_after(t: Tables, collaborations: DataFrame | None = None, songs: DataFrame | None = None,
                min_contributors: int = 2, min_labels: int = 2) -> ChangeSet:
    """PG-1 … PG-3 run to their fixed point from the parents a change touched.

    ``collaborations`` (CollaborationID) and ``songs`` (SongID) are the
    parents whose links the change removed or replaced; no other parent is
    judged, and link tables are read for these parents only.  A purged
    collaboration frees its song, which is then judged as well; a purged
    song frees nothing (a song that a collaboration uses is blocked), so
    collaborations first, then songs is the fixed point that the rules reach
    by firing on each other's deletes.  Reports: ``purged`` (table, id, rule)
    and ``blocked`` songs.
    """
    spark = next(iter(x for x in (collaborations, songs) if x is not None)).sparkSession
    empty = spark.createDataFrame([], "id long")
    k = empty if collaborations is None else _ids(collaborations, "CollaborationID", "id")
    k = t["Collaboration"].select(F.col("CollaborationID").alias("id"), "Song_SongID").join(k, "id", "left_semi")
    ensure_checkpoint_dir(spark)
    # written once: plain semi joins with what is kept are two shuffles, which AQE splits at a hot key, and do not
    # read the changed link tables a second time to count their keys
    k = k.checkpoint(eager=True)
    keys = k.select("id")

    def links_of(table: str) -> DataFrame:
        return t[table].withColumnRenamed("Collaboration_CollaborationID", "id").join(keys, "id", "left_semi")

    people = links_of("Collaboration_Contributor").groupBy("id").agg(F.count("Contributor_ContributorID").alias("_people"))
    labels = links_of("RecordLabel_Collaboration").select("id", F.explode(F.array(
        "RecordLabel_RecordLabelID1", "RecordLabel_RecordLabelID2")).alias("_l")).distinct().groupBy("id").agg(
        F.count(F.lit(1)).alias("_labels"))
    judged = k.join(people, "id", "left").join(labels, "id", "left").select(
        "id", "Song_SongID", F.when(F.coalesce("_people", F.lit(0)) < min_contributors, "contributors")
        .when(F.col("_labels") < min_labels, "labels").alias("rule"))
    gone = judged.where("rule is not null")
    gone = gone.checkpoint(eager=True)  # read by the song rule, the closure and the report

    freed = gone.where("Song_SongID is not null").select(F.col("Song_SongID").alias("SongID"))
    touched = freed if songs is None else freed.unionByName(songs.select("SongID"))
    touched = t["Song"].select("SongID").join(touched.distinct(), "SongID", "left_semi")
    on_song = touched.withColumnRenamed("SongID", "Song_SongID").checkpoint(eager=True)
    linked = t["Contributor_Song"].select("Song_SongID").join(on_song, "Song_SongID", "left_semi").distinct()
    users = t["Collaboration"].select("Song_SongID", F.col("CollaborationID").alias("id")).join(
        on_song, "Song_SongID", "left_semi").join(gone.select("id"), "id", "left_anti").select("Song_SongID").distinct()
    orphans = on_song.join(linked, "Song_SongID", "left_anti")
    blocked = orphans.join(users, "Song_SongID", "left_semi").withColumnRenamed("Song_SongID", "SongID")
    dead = orphans.join(users, "Song_SongID", "left_anti").withColumnRenamed("Song_SongID", "SongID")
    new_t, _, _ = delete_closure(t, {"Collaboration": gone.select(F.col("id").alias("CollaborationID")), "Song": dead})
    purged = gone.select(F.lit("Collaboration").alias("table"), "id", "rule").unionByName(
        dead.select(F.lit("Song").alias("table"), F.col("SongID").alias("id"), F.lit("contributors").alias("rule")))
    return ChangeSet(new_t, rejects(blocked, "Song", "SongID", "Song still used by a collaboration", seq="-"),
                     {"purged": purged, "blocked": blocked})
