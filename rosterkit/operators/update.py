"""Bulk updates with child replacement and natural-key re-keying (UP-1 … UP-7).

An update batch overwrites whole rows: the target is left-joined to the
accepted requests on its key and each column takes the request value
when matched (NULL included, as the reference overwrites with NULL).
Requests for unknown keys and repeated keys are rejected first, then those
that would break a rule of the tables (``verdicts``): one verdict per
request, made once, before any table version is built, so a refused request
changes nothing at all.  Child lists are replaced by an anti join on the
changed parents plus a union of the new child rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir
from ..sources.schema import RULES, SCHEMAS
from .changes import ChangeSet, empty_rejects, rejects, union_all, with_tables
from .ingest import (_EMPLOYMENT, LABEL_UNIQUE, PERSON_UNIQUE, assign_roles, collaboration_children, collaboration_verdicts,
                     resolved_labels, same_columns, song_children, song_fault)
from .joins import join_to_unique
from .verdicts import claims_of, row_fault, screen_rows, settle, unknown_parents

Tables = dict[str, DataFrame]


def _screen(target: DataFrame, req: DataFrame, key: str, req_key: str, entity: str,
            not_found: str) -> tuple[DataFrame, DataFrame]:
    """(accepted requests, rejects): repeated keys, then unknown keys.

    A key that a large share of the batch repeats is counted on the map
    side and joined back over buckets (``joins.join_to_unique``).
    """
    counts = req.groupBy(req_key).agg(F.count(F.lit(1)).alias("_n"))
    known = target.select(F.col(key).alias(req_key)).distinct().withColumn("_known", F.lit(True))
    marks = counts.join(known, req_key, "left")
    j = join_to_unique(req, marks, req_key, "left")
    reason = F.when(F.col("_n") > 1, F.lit(f"duplicate {req_key} in batch")).when(
        F.col("_known").isNull(), F.lit(not_found))
    return (j.where(reason.isNull()).drop("_n", "_known"),
            rejects(j.where(reason.isNotNull()), entity, req_key, reason))


def _with_current(target: DataFrame, req: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Requests with the row's present values as ``_now_<column>`` (one request per key here)."""
    now = target.select(key, *[F.col(c).alias(f"_now_{c}") for c in columns])
    return req.join(now, key)


def _unique_settled(target: DataFrame, req: DataFrame, key: str, columns: dict[str, str], entity: str,
                    reject_key: str) -> tuple[DataFrame, DataFrame]:
    """(requests, rejects): unique values after the update, of the touched rows and values only.

    ``req`` carries ``_now_<column>`` for each unique column of ``columns``
    (table column to request column); a value given up by an accepted
    request is free for the others.
    """
    order = "seq" if "seq" in req.columns else key
    claims = claims_of(req, columns, {c: f"_now_{c}" for c in columns}, order)
    owners = req.select(key, F.col(order).alias("seq"), *[
        (F.col(f"_now_{c}").isNotNull() & ~F.col(f"_now_{c}").eqNullSafe(F.col(src))).alias(f"_gives_{c}")
        for c, src in columns.items()])
    kept, rej = settle(req, claims, target, key, list(columns), entity, reject_key, owners, order)
    return kept.drop(*[f"_now_{c}" for c in columns]), rej


def overwrite(target: DataFrame, accepted: DataFrame, key: str, columns: dict[str, str],
              req_key: str | None = None) -> DataFrame:
    """Target rows with ``columns`` (target col → request col) taken from matched requests."""
    rk = req_key or key
    r = accepted.select(F.col(rk).alias("_uk"), F.lit(True).alias("_hit"),
                        *[F.col(src).alias(f"_u_{dst}") for dst, src in columns.items()])
    j = target.join(r, F.col(key) == F.col("_uk"), "left")
    out = [F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).cast(dt).alias(c)
           if c in columns else F.col(c)
           for c, dt in ((f.name, f.dataType) for f in target.schema.fields)]
    return j.select(*out)


# --------------------------------------------------------------------------- persons

_PERSON = {"Name": "Name", "DateOfBirth": "DateOfBirth", "Email": "Email", "PhoneNumber": "PhoneNumber"}


def update_persons(t: Tables, req: DataFrame, nif_col: str = "NIF") -> ChangeSet:
    """UP-1: overwrite all four person fields (NULL too).

    A NULL or over-long field and an e-mail or phone number that another
    person keeps, or that an earlier request takes, refuse the request.
    """
    unique = {c: c for c in PERSON_UNIQUE if c in req.columns}
    req = req.select(*req.columns, *[F.lit(None).cast(SCHEMAS["Person"][c].dataType).alias(c)
                                     for c in _PERSON if c not in req.columns])
    accepted, rej = _screen(t["Person"], req, "NIF", nif_col, "person", "Person not found")
    accepted, faults = screen_rows(accepted, row_fault(accepted, "Person", _PERSON), "person", nif_col)
    rej = rej.unionByName(faults)
    if unique:
        asked = _with_current(t["Person"], accepted if nif_col == "NIF" else accepted.withColumnRenamed(nif_col, "NIF"),
                              "NIF", list(unique))
        accepted, taken = _unique_settled(t["Person"], asked, "NIF", unique, "person", "NIF")
        accepted = accepted if nif_col == "NIF" else accepted.withColumnRenamed("NIF", nif_col)
        rej = rej.unionByName(taken)
    person = overwrite(t["Person"], accepted, "NIF", _PERSON, nif_col)
    return ChangeSet(with_tables(t, Person=person), rej, {"updated": accepted})


# --------------------------------------------------------------------------- labels

def update_labels(t: Tables, req: DataFrame) -> ChangeSet:
    """UP-2: overwrite every label field by RecordLabelID; rules and unique values as in UP-1."""
    accepted, rej = _screen(t["RecordLabel"], req, "RecordLabelID", "RecordLabelID", "label",
                            "RecordLabel not found")
    cols = {c: c for c in ("Name", "Location", "Website", "Email", "PhoneNumber") if c in req.columns}
    accepted, faults = screen_rows(accepted, row_fault(accepted, "RecordLabel", cols), "label", "RecordLabelID")
    unique = {c: c for c in LABEL_UNIQUE if c in cols}
    rej = rej.unionByName(faults)
    if unique:
        asked = _with_current(t["RecordLabel"], accepted, "RecordLabelID", list(unique))
        accepted, taken = _unique_settled(t["RecordLabel"], asked, "RecordLabelID", unique, "label", "RecordLabelID")
        rej = rej.unionByName(taken)
    return ChangeSet(with_tables(t, RecordLabel=overwrite(t["RecordLabel"], accepted,
                                                          "RecordLabelID", cols)), rej, {})


# --------------------------------------------------------------------------- songs

def update_songs(t: Tables, req: DataFrame, as_of=None) -> ChangeSet:
    """UP-3: overwrite songs and replace their genre rows and contributor links.

    A NULL list clears that child list of the song.
    """
    accepted, rej = _screen(t["Song"], req, "SongID", "SongID", "song", "Song not found")
    cols = {c: c for c in ("Title", "Duration", "ReleaseDate") if c in req.columns}
    accepted, faults = screen_rows(accepted, song_fault(accepted), "song", "SongID")
    rej = rej.unionByName(faults)
    song = overwrite(t["Song"], accepted, "SongID", cols)
    changed = accepted.select(F.col("SongID").alias("Song_SongID")).distinct()
    genres, links, link_rej = song_children(t, accepted, as_of)
    new_t = with_tables(
        t, Song=song,
        Song_Genre=join_to_unique(t["Song_Genre"], changed, "Song_SongID", "left_anti")
        .unionByName(genres),
        Contributor_Song=join_to_unique(t["Contributor_Song"], changed, "Song_SongID", "left_anti")
        .unionByName(links))
    return ChangeSet(new_t, rej.unionByName(link_rej), {"updated": accepted})


# --------------------------------------------------------------------------- re-key

NIF_LENGTH = RULES["Person"].max_length["NIF"]


def _carry(t: Tables, moves: DataFrame) -> Tables:
    """The tables after the accepted moves (OldNIF, NewNIF), one per person at most."""
    mp = moves.select(F.col("OldNIF").alias("_old"), F.col("NewNIF").alias("_new"))

    def carry(df: DataFrame, col: str) -> DataFrame:
        j = df.join(mp, F.col(col) == F.col("_old"), "left")
        return j.select(*[F.coalesce(F.col("_new"), F.col(c)).alias(c) if c == col else F.col(c)
                          for c in df.columns])

    return with_tables(t, Person=carry(t["Person"], "NIF"), Contributor=carry(t["Contributor"], "Person_NIF"),
                       Employee=carry(t["Employee"], "Person_NIF"))


def rekey_persons(t: Tables, mapping: DataFrame, old_col: str = "OldNIF",
                  new_col: str = "NewNIF") -> ChangeSet:
    """UP-6: change person keys and carry them to Contributor and Employee.

    All accepted moves take effect at once, so chains and swaps work.
    Refused are unknown and repeated old keys, over-long new keys, a new key
    that an earlier request takes, and a new key whose holder keeps it: it
    has no move, or its move is refused (followed to a fixed point by
    ``verdicts.judge``; without a ``seq`` column requests go by old key).
    ``reports['keys']`` maps every person's old NIF to its NIF after the job.
    """
    m = mapping.select(F.col(old_col).alias("OldNIF"), F.col(new_col).alias("NewNIF"),
                       *([F.col("seq")] if "seq" in mapping.columns else []))
    m = m.where(F.col("OldNIF") != F.col("NewNIF"))
    accepted, rej = _screen(t["Person"], m, "NIF", "OldNIF", "person", "Person not found")
    accepted, faults = screen_rows(accepted, F.when(
        F.length("NewNIF") > NIF_LENGTH, F.lit(f"NewNIF longer than {NIF_LENGTH}")), "person", "NewNIF")
    order = "seq" if "seq" in accepted.columns else "OldNIF"
    claims = claims_of(accepted, {"NIF": "NewNIF"}, seq=order)
    owners = accepted.select(F.col("OldNIF").alias("NIF"), F.col(order).alias("seq"), F.lit(True).alias("_gives_NIF"))
    accepted, taken = settle(accepted, claims, t["Person"], "NIF", ["NIF"], "person", "NewNIF", owners, order)
    mp = accepted.select(F.col("OldNIF").alias("_old"), F.col("NewNIF").alias("_new"))
    keys = (t["Person"].select(F.col("NIF").alias("OldNIF"))
            .join(mp, F.col("OldNIF") == F.col("_old"), "left")
            .select("OldNIF", F.coalesce(F.col("_new"), F.col("OldNIF")).alias("NIF")))
    return ChangeSet(_carry(t, accepted), union_all([rej, faults, taken]), {"keys": keys, "moved": accepted})


def _person_part(t: Tables, req: DataFrame, target: str, id_col: str,
                 entity: str) -> tuple[Tables, DataFrame, DataFrame]:
    """(tables, requests, rejects): the person's row rules, its unique values and a new NIF in one verdict.

    A refused request is left out of what is returned, so nothing of it is
    written; then accepted keys are carried and the persons overwritten.
    """
    fields = [c for c in _PERSON if c in req.columns]
    rekey = "NIF" in req.columns
    if not fields and not rekey:
        return t, req, empty_rejects(req.sparkSession)
    unique = {c: c for c in PERSON_UNIQUE if c in fields}
    # a person's NIF as it is, joined once
    now = t[target].select(id_col, F.col("Person_NIF").alias("_now_NIF"))
    asked = req.join(now, id_col)
    fault = F.lit(None).cast("string")
    if fields:
        asked = asked.select(*asked.columns, *[F.lit(None).cast(SCHEMAS["Person"][c].dataType).alias(c)
                                               for c in _PERSON if c not in fields])
        fault = row_fault(asked, "Person", _PERSON)
    if rekey:
        # a NULL NIF leaves the key as it is
        asked = asked.withColumn("_nif", F.coalesce("NIF", "_now_NIF"))
        fault = F.coalesce(fault, F.when(F.length("_nif") > NIF_LENGTH,
                                         F.lit(f"NIF longer than {NIF_LENGTH}")))
    asked, rej = screen_rows(asked, fault, entity, id_col)
    slots = {**({"NIF": "_nif"} if rekey else {}), **unique}
    if slots:
        if unique:
            asked = asked.join(t["Person"].select(F.col("NIF").alias("_now_NIF"), *[
                F.col(c).alias(f"_now_{c}") for c in unique]), "_now_NIF")
        claims = claims_of(asked, slots, {c: f"_now_{c}" for c in slots})
        owners = asked.select(F.col("_now_NIF").alias("NIF"), "seq", *[
            (F.col(f"_now_{c}").isNotNull() & ~F.col(f"_now_{c}").eqNullSafe(F.col(src))).alias(f"_gives_{c}")
            for c, src in slots.items()])
        asked, taken = settle(asked, claims, t["Person"], "NIF", list(slots), entity, id_col, owners)
        rej = rej.unionByName(taken)
        # read by every part of the change
        ensure_checkpoint_dir(asked.sparkSession)
        asked = asked.checkpoint(eager=True)
    if fields:
        t = with_tables(t, Person=overwrite(t["Person"], asked.select(F.col("_now_NIF").alias("NIF"), *_PERSON), "NIF", _PERSON))
    if rekey:
        t = _carry(t, asked.where("_nif <> _now_NIF").select(F.col("_now_NIF").alias("OldNIF"), F.col("_nif").alias("NewNIF")))
    return t, asked.drop("_nif", "_now_NIF", *[f"_now_{c}" for c in unique]), rej


# --------------------------------------------------------------------------- contributors

def update_contributors(t: Tables, req: DataFrame, reset_stage_name: bool = False) -> ChangeSet:
    """UP-4: update the person, optionally re-key the NIF, replace the roles.

    Roles not in the new list are removed; an Artist row whose role stays
    keeps its stage name unless ``reset_stage_name``.  A NULL Roles value
    removes every role, as the reference does; without a Roles column the
    roles stay.  A request refused for its key or its person changes
    neither person nor roles.
    """
    accepted, rej = _screen(t["Contributor"], req, "ContributorID", "ContributorID", "contributor",
                            "Contributor not found")
    t2, accepted, prej = _person_part(t, accepted, "Contributor", "ContributorID", "contributor")
    rej_all = [rej, prej]
    if "Roles" in accepted.columns:
        with_roles = accepted.withColumn("Roles", F.coalesce("Roles", F.lit("")))
        roles, role_rej = assign_roles(t2, with_roles.select("seq", "ContributorID", "Roles"))
        rej_all.append(role_rej)
        changed = with_roles.select(F.col("ContributorID").alias("Contributor_ContributorID")).distinct()
        for role, rows in roles.items():
            kept = t2[role].join(changed, "Contributor_ContributorID", "left_anti")
            if role == "Artist" and not reset_stage_name:
                rows = rows.alias("n").join(
                    t2["Artist"].select("Contributor_ContributorID", F.col("StageName").alias("_old")),
                    "Contributor_ContributorID", "left").select(
                    "Contributor_ContributorID", F.coalesce("_old", "StageName").alias("StageName"))
            t2 = with_tables(t2, **{role: kept.unionByName(rows)})
        # genres of artists whose artist role is removed cascade away
        artists = t2["Artist"].select(F.col("Contributor_ContributorID").alias("Artist_ContributorID"))
        t2 = with_tables(t2, Artist_Genre=join_to_unique(t2["Artist_Genre"], artists,
                                                         "Artist_ContributorID", "left_semi"))
    return ChangeSet(t2, union_all(rej_all), {"updated": accepted})


# --------------------------------------------------------------------------- employees

def update_employees(t: Tables, req: DataFrame) -> ChangeSet:
    """UP-5: update the person, optionally re-key the NIF, overwrite employment fields.

    A request that names an unknown label, breaks a rule of the employment
    columns (NULL, negative salary, length) or is refused for its key or its
    person changes nothing.
    """
    accepted, rej = _screen(t["Employee"], req, "EmployeeID", "EmployeeID", "employee",
                            "Employee not found")
    rej_all = [rej]
    cols = {dst: src for dst, src in _EMPLOYMENT.items() if src in accepted.columns}
    accepted, faults = screen_rows(accepted, row_fault(accepted, "Employee", cols), "employee", "EmployeeID")
    rej_all.append(faults)
    if "RecordLabelID" in accepted.columns:
        accepted, unknown = unknown_parents(accepted, t["RecordLabel"], "RecordLabelID", "RecordLabelID", "employee",
                                            "EmployeeID", "RecordLabel not found")
        rej_all.append(unknown)
    t2, accepted, prej = _person_part(t, accepted, "Employee", "EmployeeID", "employee")
    rej_all.append(prej)
    emp = overwrite(t2["Employee"], accepted, "EmployeeID", cols)
    return ChangeSet(with_tables(t2, Employee=emp), union_all(rej_all), {"updated": accepted})


# --------------------------------------------------------------------------- collaborations

def update_collaborations(t: Tables, req: DataFrame) -> ChangeSet:
    """UP-7: overwrite collaborations and replace their label and contributor links.

    Repeated and unknown keys, wrong dates, an unknown song, a NULL or
    over-long value in a column with such a rule or a list of fewer than two
    known labels reject the whole request.  The verdict is one narrow row
    per request, written once; every table version reads it.
    """
    labels = resolved_labels(t, req)
    counts = req.groupBy("CollaborationID").agg(F.count(F.lit(1)).alias("_n"))
    known = t["Collaboration"].select("CollaborationID", F.lit(True).alias("_known"))
    asked = join_to_unique(req, counts.join(known, "CollaborationID", "left"), "CollaborationID", "left")
    keyed = F.when(F.col("_n") > 1, F.lit("duplicate CollaborationID in batch")).when(
        F.col("_known").isNull(), F.lit("Collaboration not found"))
    verdict = collaboration_verdicts(t, asked, labels, keyed).checkpoint(eager=True)
    refused = rejects(req.join(verdict.where("reason is not null"), "seq"), "collaboration", "CollaborationID", "reason")
    accepted = req.join(verdict.where("reason is null").select("seq"), "seq", "left_semi")
    cols = {c: c for c in ("CollaborationName", "StartDate", "EndDate", "Description")
            if c in accepted.columns}
    if "SongID" in accepted.columns:
        cols["Song_SongID"] = "SongID"
    k = overwrite(t["Collaboration"], accepted, "CollaborationID", cols)
    changed = accepted.select(F.col("CollaborationID").alias("Collaboration_CollaborationID"))
    label_links, contrib_links, child_rej = collaboration_children(t, accepted, labels)
    new_t = with_tables(
        t, Collaboration=k,
        RecordLabel_Collaboration=join_to_unique(
            t["RecordLabel_Collaboration"], changed, "Collaboration_CollaborationID", "left_anti")
        .unionByName(label_links),
        Collaboration_Contributor=join_to_unique(
            t["Collaboration_Contributor"], changed, "Collaboration_CollaborationID", "left_anti")
        .unionByName(contrib_links))
    return ChangeSet(new_t, refused.unionByName(child_rej), {"updated": accepted})
