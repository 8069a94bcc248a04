"""Bulk create and identity resolution (WR-2 … WR-10, SRC-2 checks, JN-10).

A request batch is a DataFrame with a ``seq`` column giving the order in
which the reference would have applied the requests one by one.  All
work is joins and grouped aggregates over the whole batch; new ids come
from ``ids.assign_ids`` (no single-partition window).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import tokens
from ..functions.text import same_or_empty
from ..plans.session import ensure_checkpoint_dir
from ..sources.schema import RULES, SCHEMAS
from .changes import ChangeSet, empty_rejects, rejects, union_all, with_tables
from .ids import assign_ids, max_id
from .joins import join_to_unique
from .verdicts import claims_of, row_fault, screen_rows, settle, unknown_parents

Tables = dict[str, DataFrame]

# Fields each create request must carry (empty text counts
# as missing), and the role names a contributor may take, in list order.
REQUIRED_FIELDS: dict[str, tuple[str, ...]] = {
    "label": ("Name", "Email"),
    "song": ("Title", "Duration"),
    "contributor": ("NIF", "Name", "Roles"),
    "employee": ("NIF", "Name", "JobTitle", "Salary", "HireDate", "RecordLabelID"),
    "collaboration": ("CollaborationName", "StartDate"),
    "person": ("NIF",),
}
ROLES = ("Artist", "Producer", "Songwriter")

_PERSON_FIELDS = ("Name", "DateOfBirth", "Email", "PhoneNumber")


# --------------------------------------------------------------------------- validation

def _missing(c: str, dtype: str) -> Column:
    col = F.col(c)
    if dtype == "string":
        return col.isNull() | (F.trim(col) == "")
    if dtype.startswith("decimal") or dtype in ("int", "bigint", "double"):
        # a label id of zero counts as missing; a salary of zero is a value (decision C-12)
        return col.isNull() | (col == 0) if c == "RecordLabelID" else col.isNull()
    return col.isNull()


def validate_requests(req: DataFrame, entity: str, required: tuple[str, ...] | None = None,
                      strict_not_null: bool = True) -> DataFrame:
    """Add ``Missing``: comma list of required fields that are absent, else NULL.

    ``strict_not_null`` also requires every NOT NULL column of the label
    table (the reference's own check names only Name and Email, and its
    table then refuses the row).
    """
    fields = list(required or REQUIRED_FIELDS[entity])
    if strict_not_null and entity == "label":
        fields += [f for f in RULES["RecordLabel"].not_null if f not in fields]
    types = dict(req.dtypes)
    flags = [F.when(_missing(f, types[f]), F.lit(f)) for f in fields if f in types]
    absent = [F.lit(f) for f in fields if f not in types]
    return req.withColumn("Missing", F.nullif(F.concat_ws(", ", *flags, *absent), F.lit("")))


def split_valid(req: DataFrame, entity: str, extra: tuple[str, ...] = (), **kw) -> tuple[DataFrame, DataFrame]:
    """SRC-2: (valid requests with NIF/name fields trimmed, rejects with the ``extra`` columns)."""
    checked = validate_requests(req, entity, **kw)
    bad = rejects(checked.where(F.col("Missing").isNotNull()), entity, "seq",
                  F.concat(F.lit("Missing required fields: "), F.col("Missing")), extra=extra)
    good = checked.where(F.col("Missing").isNull()).drop("Missing")
    for c in ("NIF", "Name", "JobTitle"):
        if c in good.columns:
            good = good.withColumn(c, F.trim(c))
    return good, bad


# --------------------------------------------------------------------------- list tokens

def split_list(req: DataFrame, list_col: str, out_col: str, keep: list[str],
               drop_empty: bool = False, dedupe: bool = False, with_position: bool = False) -> DataFrame:
    """SC-6/SC-7: one row per trimmed list item (empty items kept unless dropped)."""
    if with_position:
        out = req.select(*keep, F.posexplode(tokens(list_col)).alias("_pos", out_col))
    else:
        out = req.select(*keep, F.explode(tokens(list_col)).alias(out_col))
    if drop_empty:
        out = out.where(F.col(out_col) != "")
    if dedupe:
        if with_position:
            first = out.groupBy(*keep, out_col).agg(F.min("_pos").alias("_pos"))
            out = first
        else:
            out = out.dropDuplicates(keep + [out_col])
    return out


def resolve_nifs(t: Tables, items: DataFrame, nif_col: str = "NIF") -> tuple[DataFrame, DataFrame]:
    """JN-10: NIF tokens → ContributorID (inner join); unknown NIFs separately."""
    c = t["Contributor"].select(F.col("Person_NIF").alias(nif_col), "ContributorID")
    # a NIF named by a huge share of the list items is split (joins.join_to_unique)
    known = join_to_unique(items, c, nif_col)
    unknown = join_to_unique(items, c.select(nif_col), nif_col, "left_anti")
    return known, unknown


def resolve_labels(t: Tables, items: DataFrame, name_col: str = "LabelName") -> tuple[DataFrame, DataFrame]:
    """JN-10: label-name tokens → RecordLabelID; unknown names separately."""
    rl = t["RecordLabel"].select(F.col("Name").alias(name_col), "RecordLabelID")
    return (join_to_unique(items, rl, name_col),
            join_to_unique(items, rl.select(name_col), name_col, "left_anti"))


def _accept(req: DataFrame, rej: DataFrame) -> DataFrame:
    return req.join(rej.select("seq").distinct(), "seq", "left_anti")


def same_columns(table: str, req: DataFrame) -> dict[str, str]:
    """Columns of ``table`` that the request carries under the same name."""
    return {f.name: f.name for f in SCHEMAS[table].fields if f.name in req.columns}


# --------------------------------------------------------------------------- labels

LABEL_UNIQUE = ("Name", "Website", "Email", "PhoneNumber")


def create_labels(t: Tables, req: DataFrame, strict_not_null: bool = True) -> ChangeSet:
    """WR-2: insert labels with new ids after the current maximum (by seq).

    A unique value goes to the first request, by seq, that is not refused;
    a refused request refuses no later one (``verdicts.judge``).
    """
    good, bad = split_valid(req, "label", strict_not_null=strict_not_null)
    good, faults = screen_rows(good, row_fault(good, "RecordLabel", same_columns("RecordLabel", good)), "label", "seq")
    claims = claims_of(good, {c: c for c in LABEL_UNIQUE})
    accepted, uniq = settle(good, claims, t["RecordLabel"], "RecordLabelID", list(LABEL_UNIQUE), "label", "seq")
    created = assign_ids(accepted, "RecordLabelID", ["seq"], max_id(t["RecordLabel"], "RecordLabelID"))
    rows = created.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS["RecordLabel"].fields])
    return ChangeSet(with_tables(t, RecordLabel=t["RecordLabel"].unionByName(rows)),
                     union_all([bad, faults, uniq]), {"created": rows})


# --------------------------------------------------------------------------- songs

def song_children(t: Tables, songs: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(Song_Genre rows, Contributor_Song rows, unknown-NIF rejects) of song requests.

    ``songs`` holds seq, SongID, Genres, Contributors.  Empty genre items
    are dropped and repeats de-duplicated; unknown NIFs are left out and
    reported.
    """
    genres = split_list(songs, "Genres", "Genre", ["SongID"], drop_empty=True, dedupe=True).select(
        F.col("SongID").alias("Song_SongID"), "Genre")
    nifs = split_list(songs, "Contributors", "NIF", ["seq", "SongID"], drop_empty=True, dedupe=True)
    known, unknown = resolve_nifs(t, nifs)
    links = known.select(F.col("ContributorID").alias("Contributor_ContributorID"),
                         F.col("SongID").alias("Song_SongID"),
                         _as_of(as_of).alias("Date")).dropDuplicates(
        ["Contributor_ContributorID", "Song_SongID"])
    rej = rejects(unknown, "song", "NIF", F.concat(F.lit("unknown NIF "), F.col("NIF")))
    return genres, links, rej


def song_fault(req: DataFrame) -> Column:
    """The first rule a song request breaks: its own columns, then the length of each genre."""
    most = RULES["Song_Genre"].max_length["Genre"]
    genre = F.when(F.exists(tokens("Genres"), lambda g: F.length(g) > most), F.lit(f"Genre longer than {most}")) \
        if "Genres" in req.columns else F.lit(None).cast("string")
    own = {c: src for c, src in same_columns("Song", req).items() if c != "SongID"}
    return F.coalesce(row_fault(req, "Song", own), genre)


def create_songs(t: Tables, req: DataFrame, as_of=None) -> ChangeSet:
    """WR-3: insert songs, their genres (list) and contributor links (NIF list).

    Links are dated ``as_of`` (default: today).  ``reports['created']``
    holds the new Song rows, ``reports['links']`` the new links.
    """
    good, bad = split_valid(req, "song")
    good, faults = screen_rows(good, song_fault(good), "song", "seq")
    bad = bad.unionByName(faults)
    created = assign_ids(good, "SongID", ["seq"], max_id(t["Song"], "SongID"))
    songs = created.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS["Song"].fields])
    genres, links, rej = song_children(t, created, as_of)
    new_t = with_tables(t, Song=t["Song"].unionByName(songs),
                        Song_Genre=t["Song_Genre"].unionByName(genres),
                        Contributor_Song=t["Contributor_Song"].unionByName(links))
    return ChangeSet(new_t, union_all([bad, rej]), {"created": songs, "genres": genres, "links": links})


def _as_of(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    d = as_of if isinstance(as_of, _dt.date) else _dt.date.fromisoformat(str(as_of))
    return F.lit(d)


# --------------------------------------------------------------------------- identity resolution

_TARGET = {"contributor": ("Contributor", "ContributorID"), "employee": ("Employee", "EmployeeID")}


def _stored_outcomes(t: Tables, req: DataFrame, entity: str) -> DataFrame:
    """Requests with ``_stored`` (outcome against the stored tables only),
    ``FieldsDiffer``, ``ExistingID`` and the stored person fields ``_p_*``."""
    table, id_col = _TARGET[entity]
    p = t["Person"].select(F.col("NIF").alias("NIF"), F.lit(True).alias("_known"),
                           *[F.col(c).alias(f"_p_{c}") for c in _PERSON_FIELDS])
    target = t[table].select(F.col("Person_NIF").alias("NIF"), F.col(id_col).alias("ExistingID"))
    # one row per known NIF: the stored person and its role record, if any
    # (a role record always belongs to a stored person, FK restrict)
    known = p.join(target, "NIF", "left")
    # a NIF repeated by a huge share of the batch is spread over buckets
    r = join_to_unique(req, known, "NIF", "left")
    same = None
    for c in _PERSON_FIELDS:
        eq = same_or_empty(F.col(f"_p_{c}"), F.col(c)) if c in req.columns else F.lit(True)
        same = eq if same is None else same & eq
    stored = (F.when(F.col("_known").isNull(), "NEW")
              .when(F.col("ExistingID").isNotNull(), "EXISTING")
              .when(same, "ATTACH")
              .otherwise("CONFLICT"))
    return r.withColumn("_stored", stored).withColumn(
        "FieldsDiffer", F.when(F.col("_known").isNull(), F.lit(False)).otherwise(~same))


def _batch_outcomes(t: Tables, r: DataFrame, entity: str, assign_new_ids: bool) -> DataFrame:
    """Apply the within-batch rule to ``_stored`` and (optionally) assign new ids.

    The batch is read four times from here on, so it is written once (the
    stored tables it was joined to are not read again).
    """
    table, id_col = _TARGET[entity]
    ensure_checkpoint_dir(r.sparkSession)
    r = r.drop("_known", *[f"_p_{c}" for c in _PERSON_FIELDS]).checkpoint(eager=True)
    creators = (r.where(F.col("_stored").isin("NEW", "ATTACH"))
                .groupBy(F.col("NIF").alias("_cnif")).agg(F.min("seq").alias("_creator")))
    r = join_to_unique(r, creators.withColumnRenamed("_cnif", "NIF"), "NIF", "left")
    outcome = (F.when(F.col("_creator").isNotNull() & (F.col("seq") > F.col("_creator")), "EXISTING")
               .otherwise(F.col("_stored")))
    r = r.withColumn("Outcome", outcome)
    r = r.drop("_stored")
    if not assign_new_ids:
        return r.drop("_creator")
    first = r.where(F.col("seq") == F.col("_creator"))
    new_ids = assign_ids(first.select("seq"), "NewID", ["seq"], max_id(t[table], id_col))
    by_nif = first.select("seq", "NIF").join(new_ids, "seq").select(
        F.col("NIF").alias("_nnif"), "NewID")
    r = join_to_unique(r, by_nif.withColumnRenamed("_nnif", "NIF"), "NIF", "left")
    return (r.withColumn("ExistingID", F.when(
        (F.col("Outcome") == "EXISTING") & F.col("ExistingID").isNull(), F.col("NewID"))
        .otherwise(F.col("ExistingID")))
        .withColumn("NewID", F.when(F.col("seq") == F.col("_creator"), F.col("NewID")))
        .drop("_creator"))


def classify_requests(t: Tables, req: DataFrame, entity: str = "contributor",
                      assign_new_ids: bool = True, attach_when: Column | None = None) -> DataFrame:
    """WR-4/WR-5: Outcome per request: NEW, EXISTING, ATTACH or CONFLICT.

    Against the stored tables: person unknown → NEW; role record already
    there → EXISTING (its id in ExistingID); person fields equal (NULL
    and '' alike, dates as text) → ATTACH; otherwise CONFLICT.  Within
    the batch the first NEW/ATTACH request per NIF (by seq) creates the
    record; later requests for that NIF become EXISTING with the new id.
    The creator per NIF is a grouped ``min(seq)`` (partial on the map
    side), not a window over a possibly huge NIF group.
    ``FieldsDiffer`` tells whether incoming and stored fields differ.
    ``attach_when`` (a predicate on the request) turns CONFLICT into
    ATTACH, the ``keep`` policy of WR-8.
    """
    r = _stored_outcomes(t, req, entity)
    if attach_when is not None:
        r = r.withColumn("_stored", F.when(
            (F.col("_stored") == "CONFLICT") & F.coalesce(attach_when, F.lit(False)), "ATTACH")
            .otherwise(F.col("_stored")))
    return _batch_outcomes(t, r, entity, assign_new_ids)


def conflict_report(t: Tables, classified: DataFrame) -> DataFrame:
    """WR-7: stored and incoming person fields side by side for CONFLICT requests."""
    p = t["Person"].select("NIF", *[F.col(c).alias(f"Existing{c}") for c in _PERSON_FIELDS])
    c = classified.where(F.col("Outcome") == "CONFLICT")
    return c.join(p, "NIF").select(
        "seq", "NIF", *[x for c_ in _PERSON_FIELDS for x in
                        (F.col(f"Existing{c_}"), F.col(c_).alias(f"Incoming{c_}"))])


def assign_roles(t: Tables, req: DataFrame, id_col: str = "ContributorID",
                 roles_col: str = "Roles") -> tuple[dict[str, DataFrame], DataFrame]:
    """WR-9: role list → rows of Artist / Producer / Songwriter for each contributor.

    Role names match case-insensitively; unknown names are left out and
    reported; an artist gets the default stage name ``Artist_<id>``.
    Returns ({table: rows}, rejects).
    """
    items = split_list(req, roles_col, "_role", ["seq", id_col] if "seq" in req.columns else [id_col],
                       drop_empty=True)
    canon = F.coalesce(*[F.when(F.lower("_role") == r.lower(), F.lit(r)) for r in ROLES])
    items = items.withColumn("_canon", canon)
    out = {}
    for role in ROLES:
        rows = items.where(F.col("_canon") == role).select(
            F.col(id_col).cast("bigint").alias("Contributor_ContributorID")).distinct()
        if role == "Artist":
            rows = rows.withColumn("StageName", F.concat(
                F.lit("Artist_"), F.col("Contributor_ContributorID").cast("string")))
        out[role] = rows
    rej = rejects(items.where(F.col("_canon").isNull()), "contributor", "_role",
                  F.concat(F.lit("unknown role "), F.col("_role")))
    return out, rej


_EMPLOYMENT = {"JobTitle": "JobTitle", "Department": "Department", "Salary": "Salary", "HireDate": "HireDate",
               "RecordLabel_RecordLabelID": "RecordLabelID"}
PERSON_UNIQUE = ("Email", "PhoneNumber")


def _rule_rejects(t: Tables, req: DataFrame, entity: str, new_person: Column,
                  writes: Column) -> tuple[DataFrame, DataFrame]:
    """(requests, rejects): row rules of the records a request would write, and its label.

    ``new_person`` marks requests that write the person's fields, ``writes``
    those that write a role record; other requests pass.
    """
    person = row_fault(req, "Person", same_columns("Person", req)) if "Name" in req.columns \
        else F.lit("Name must not be NULL")
    fault = F.when(new_person, person)
    if entity == "employee":
        own = {c: src for c, src in _EMPLOYMENT.items() if src in req.columns}
        fault = F.coalesce(fault, F.when(writes, row_fault(req, "Employee", own)))
    req, rej = screen_rows(req, fault, entity, "NIF")
    if entity == "employee" and "RecordLabelID" in req.columns:
        asked = req.withColumn("_label", F.when(writes, F.col("RecordLabelID")))
        asked, unknown = unknown_parents(asked, t["RecordLabel"], "_label", "RecordLabelID", entity, "NIF",
                                         "RecordLabel not found")
        return asked.drop("_label"), rej.unionByName(unknown)
    return req, rej


def _person_claims(req: DataFrame) -> dict[str, str]:
    return {c: c for c in PERSON_UNIQUE if c in req.columns}


def attach(t: Tables, classified: DataFrame, entity: str = "contributor",
           outcomes=("NEW", "ATTACH"), checked: bool = False) -> ChangeSet:
    """WR-6: create the role record (and the person for NEW) of each creator.

    A creator that breaks a row rule, names an unknown label or claims a
    taken e-mail or phone number is refused and writes nothing, and so are
    the requests that were to follow it; ``checked=True`` leaves the checks
    out (``apply_requests`` has made them before the creators were chosen).
    """
    table, id_col = _TARGET[entity]
    creators = classified.where(F.col("Outcome").isin(*outcomes) & F.col("NewID").isNotNull())
    refused = empty_rejects(classified.sparkSession)
    if not checked:
        asked = creators
        creators, refused = _rule_rejects(t, creators, entity, F.col("Outcome") == "NEW", F.lit(True))
        slots = _person_claims(creators)
        if slots:
            claims = claims_of(creators.where("Outcome = 'NEW'"), slots)
            creators, taken = settle(creators, claims, t["Person"], "NIF", list(slots), entity, "NIF")
            refused = refused.unionByName(taken)
        lost = asked.join(refused.select("seq"), "seq", "left_semi").select(F.col("NewID").alias("ExistingID"))
        followers = classified.where((F.col("Outcome") == "EXISTING")).join(lost, "ExistingID", "left_semi")
        refused = refused.unionByName(rejects(followers, entity, "NIF", F.lit("the request that creates the record is refused")))
    new_persons = creators.where(F.col("Outcome") == "NEW").select(
        "NIF", *[F.col(c) if c in creators.columns else F.lit(None) for c in _PERSON_FIELDS])
    new_persons = new_persons.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                                       for f in SCHEMAS["Person"].fields])
    changed = {"Person": t["Person"].unionByName(new_persons)}
    if entity == "contributor":
        rows = creators.select(F.col("NewID").alias("ContributorID"), F.col("NIF").alias("Person_NIF"))
        changed["Contributor"] = t["Contributor"].unionByName(rows)
        if "Roles" in creators.columns:
            roles, rej = assign_roles(t, creators.select("seq", F.col("NewID").alias("ContributorID"),
                                                         "Roles"))
            refused = refused.unionByName(rej)
            for role, r in roles.items():
                changed[role] = t[role].unionByName(r)
    else:
        rows = creators.select(
            F.col("NewID").alias("EmployeeID"), "JobTitle", "Department", "Salary", "HireDate",
            F.col("RecordLabelID").alias("RecordLabel_RecordLabelID"), F.col("NIF").alias("Person_NIF"))
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                             for f in SCHEMAS["Employee"].fields])
        changed["Employee"] = t["Employee"].unionByName(rows)
    return ChangeSet(with_tables(t, **changed), refused, {"created": rows, "persons": new_persons})


def _screened(t: Tables, r: DataFrame, entity: str, writes: Column) -> tuple[DataFrame, DataFrame]:
    """(requests, rejects): one verdict per request before anything is written.

    Row rules first.  The person of a NIF is written by the first request
    that may write it; if its e-mail or phone number is taken it is refused
    and the next request for that NIF takes its place, until no request is
    refused.
    """
    writer = ((F.col("_stored") == "NEW") | ((F.col("_stored") == "CONFLICT") & (F.lower("_policy") == "overwrite"))) & writes
    ensure_checkpoint_dir(r.sparkSession)
    r = r.checkpoint(eager=True)  # the joins to the stored tables run once
    r, rej = _rule_rejects(t, r, entity, writer, writes & F.col("_stored").isin("NEW", "ATTACH", "CONFLICT"))
    slots = _person_claims(r)
    if not slots:
        return r, rej
    all_rejects = [rej]
    while True:
        first = r.where(writer).groupBy("NIF").agg(F.min("seq").alias("_first"))
        writers = r.join(first.select(F.col("_first").alias("seq")), "seq", "left_semi")
        claims = claims_of(writers, slots, {c: f"_p_{c}" for c in slots})
        owners = writers.select("NIF", "seq", *[
            (F.col(f"_p_{c}").isNotNull() & ~F.col(f"_p_{c}").eqNullSafe(F.col(c))).alias(f"_gives_{c}") for c in slots])
        # the judgement may refuse writers only; the rest of the batch stays
        kept, taken = settle(writers, claims, t["Person"], "NIF", list(slots), entity, "NIF", owners)
        if kept is writers:
            return r, union_all(all_rejects)
        taken = taken.checkpoint(eager=True)
        if taken.isEmpty():
            return r, union_all(all_rejects)
        all_rejects.append(taken)
        r = r.join(taken.select("seq"), "seq", "left_anti").checkpoint(eager=True)


def apply_requests(t: Tables, req: DataFrame, entity: str = "contributor",
                   policy_col: str = "policy") -> ChangeSet:
    """WR-8: resolve requests, applying each CONFLICT request's policy.

    ``keep`` attaches to the stored person unchanged, ``overwrite``
    updates the person with the incoming fields and then attaches,
    ``cancel`` writes nothing.  A request that would break a rule of the
    tables (NOT NULL, check, length, unknown label, taken e-mail or phone
    number) is refused before the creator of its NIF is chosen and changes
    nothing.  ``reports['resolutions']``: seq, NIF, Policy and PersonName
    (the name the record ends up attached to; NULL when cancelled).
    """
    from .update import overwrite  # local import: update builds on ingest

    r = _stored_outcomes(t, req, entity).withColumn("_policy", F.lower(F.col(policy_col)))
    pol = F.col("_policy")
    conflict = F.col("_stored") == "CONFLICT"
    # cancelled conflicts and conflicts without a policy write nothing
    chosen = F.coalesce(pol.isin("keep", "overwrite"), F.lit(False))
    r, refused = _screened(t, r, entity, ~conflict | chosen)
    resolutions = r.where(conflict).select(
        "seq", "NIF", pol.alias("Policy"),
        F.when(pol == "keep", F.col("_p_Name")).when(pol == "overwrite", F.col("Name"))
        .alias("PersonName"))
    # a repeated NIF: the first overwrite by seq is the one that is written
    fields = [c for c in _PERSON_FIELDS if c in r.columns]
    written = r.where(conflict & (pol == "overwrite")).groupBy("NIF").agg(
        F.min(F.struct("seq", *fields)).alias("_o")).select("NIF", "_o.*")
    person = overwrite(t["Person"], written.select("NIF", *[
        F.col(c) if c in fields else F.lit(None).alias(c) for c in _PERSON_FIELDS]), "NIF",
        {c: c for c in _PERSON_FIELDS})
    # keep / overwrite conflicts attach (after the update the fields agree)
    live = r.where(~conflict | chosen).withColumn(
        "_stored", F.when(conflict, F.lit("ATTACH")).otherwise(F.col("_stored"))).drop("_policy")
    final = _batch_outcomes(t, live, entity, assign_new_ids=True)
    change = attach(with_tables(t, Person=person), final, entity, checked=True)
    change.rejects = union_all([refused, change.rejects])
    change.reports["resolutions"] = resolutions
    change.reports["classified"] = final
    return change


# --------------------------------------------------------------------------- collaborations

def resolved_labels(t: Tables, req: DataFrame) -> DataFrame | None:
    """(seq, LabelName, pos, RecordLabelID or NULL): the label lists of a batch, resolved once and kept.

    None if the batch has no label list.  The table holds one row per list
    item; what follows (the verdict, the links, the rejects) reads it
    instead of resolving the names again.
    """
    if "RecordLabels" not in req.columns:
        return None
    names = split_list(req, "RecordLabels", "LabelName", ["seq"], drop_empty=True, dedupe=True, with_position=True)
    known = t["RecordLabel"].select(F.col("Name").alias("LabelName"), "RecordLabelID")
    ensure_checkpoint_dir(req.sparkSession)
    return join_to_unique(names, known, "LabelName", "left").select("seq", "LabelName", "_pos", "RecordLabelID").checkpoint(
        eager=True)


def collaboration_verdicts(t: Tables, req: DataFrame, labels: DataFrame | None, fault: Column | None = None) -> DataFrame:
    """(seq, reason): one row per request, the first reason that refuses it or NULL.

    Row rules (``fault``: reasons that come before them), an unknown song,
    or labels of which fewer than two are known.
    """
    columns = {c: c for c in ("CollaborationName", "StartDate", "EndDate") if c in req.columns}
    reasons = [fault] if fault is not None else []
    reasons.append(row_fault(req, "Collaboration", columns))
    v = req
    if "SongID" in req.columns:
        v = join_to_unique(v, t["Song"].select("SongID", F.lit(True).alias("_song")), "SongID", "left")
        reasons.append(F.when(F.col("SongID").isNotNull() & F.col("_song").isNull(), F.lit("Song not found")))
    if labels is not None:
        few = labels.groupBy("seq").agg(F.count("RecordLabelID").alias("_labels"))
        v = v.join(few, "seq", "left")
        reasons.append(F.when(F.col("_labels") < 2, F.lit("needs two labels")))
    return v.select("seq", F.coalesce(*reasons).alias("reason"))


def collaboration_children(t: Tables, collabs: DataFrame,
                           labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(label links, contributor links, rejects) of collaboration requests.

    ``collabs`` holds seq, CollaborationID, RecordLabels (names),
    Contributors (NIFs); ``labels`` is what ``resolved_labels`` gives.
    Label links are ordered pairs (first listed label, each other label); a
    list naming fewer than two known labels gives no link and a reject.
    """
    keys = collabs.select("seq", "CollaborationID")
    links = t["RecordLabel_Collaboration"].limit(0).select(
        "RecordLabel_RecordLabelID1", "RecordLabel_RecordLabelID2", "Collaboration_CollaborationID")
    rej = empty_rejects(collabs.sparkSession)
    labels = resolved_labels(t, collabs) if labels is None else labels
    if labels is not None:
        known = labels.where("RecordLabelID is not null")
        first = known.groupBy("seq").agg(F.min(F.struct("_pos", "RecordLabelID")).alias("_first"),
                                         F.count(F.lit(1)).alias("_n"))
        # a list is bounded by its request, so no seq is hot
        links = known.join(first, "seq").where(F.col("RecordLabelID") != F.col("_first.RecordLabelID")).join(keys, "seq").select(
            F.col("_first.RecordLabelID").alias("RecordLabel_RecordLabelID1"),
            F.col("RecordLabelID").alias("RecordLabel_RecordLabelID2"),
            F.col("CollaborationID").alias("Collaboration_CollaborationID")).distinct()
        rej = union_all([
            rejects(first.where("_n < 2").join(keys, "seq"), "collaboration", "CollaborationID", F.lit("needs two labels")),
            rejects(labels.where("RecordLabelID is null").join(keys, "seq", "left_semi"), "collaboration", "LabelName",
                    F.concat(F.lit("unknown label "), F.col("LabelName")))])
    nifs = split_list(collabs, "Contributors", "NIF", ["seq", "CollaborationID"], drop_empty=True,
                      dedupe=True)
    known_c, unknown_c = resolve_nifs(t, nifs)
    contrib_links = known_c.select(
        F.col("CollaborationID").alias("Collaboration_CollaborationID"),
        F.col("ContributorID").alias("Contributor_ContributorID")).distinct()
    rej = rej.unionByName(rejects(unknown_c, "collaboration", "NIF", F.concat(F.lit("unknown NIF "), F.col("NIF"))))
    return links, contrib_links, rej


def create_collaborations(t: Tables, req: DataFrame) -> ChangeSet:
    """WR-10: insert collaborations with label links (names) and contributor links (NIFs).

    Wrong dates, an over-long name, an unknown song or a list of fewer than
    two known labels reject the whole request; a NULL or empty label list
    links no label.  The verdict is one narrow row per request; new ids are
    given to the accepted ``seq`` and joined back.
    """
    good, bad = split_valid(req, "collaboration")
    labels = resolved_labels(t, good)
    verdict = collaboration_verdicts(t, good, labels).checkpoint(eager=True)
    refused = rejects(verdict.where("reason is not null"), "collaboration", "seq", "reason")
    numbered = assign_ids(verdict.where("reason is null").select("seq"), "_id", ["seq"],
                          max_id(t["Collaboration"], "CollaborationID"))
    created = good.drop("CollaborationID").join(numbered.withColumnRenamed("_id", "CollaborationID"), "seq")
    rows = created.select(*[F.col(f.name if f.name != "Song_SongID" else "SongID").cast(f.dataType)
                            .alias(f.name) for f in SCHEMAS["Collaboration"].fields])
    label_links, contrib_links, rej = collaboration_children(t, created, labels)
    new_t = with_tables(
        t, Collaboration=t["Collaboration"].unionByName(rows),
        RecordLabel_Collaboration=t["RecordLabel_Collaboration"].unionByName(label_links),
        Collaboration_Contributor=t["Collaboration_Contributor"].unionByName(contrib_links))
    return ChangeSet(new_t, union_all([bad, refused, rej]),
                     {"created": rows, "label_links": label_links, "contributor_links": contrib_links})
