"""Request batches over the driver tables (input builders for the query catalogue).

Each builder only produces rows in a request schema of ``FIXTURES.md``
§3 (or a key set for a delete or lookup); none does any of the
operator's work.  The operators take any batch of that schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded_key
from .star import nif_of

Tables = dict[str, DataFrame]


def known_seq(key) -> Column:
    """Even sequence numbers: requests about the person with this key."""
    return key.cast("bigint") * 2


def new_seq(key) -> Column:
    """Odd sequence numbers: requests about a person not stored yet (NIF prefix ``N``)."""
    return key.cast("bigint") * 2 + 1


def person_requests(d: dict[str, DataFrame]) -> DataFrame:
    """seq, NIF, Name, DateOfBirth, Email, PhoneNumber.

    Half the customers re-submitted (every third one with a changed name,
    a missing e-mail sent as ''), plus unknown people with new NIFs.
    """
    c = d["customer"]
    ck = F.col("c_custkey")
    known = c.where(ck % 4 < 2).select(
        known_seq(ck).alias("seq"), nif_of(ck).alias("NIF"),
        F.when(ck % 3 == 0, F.concat("c_name", F.lit(" II"))).otherwise(F.col("c_name")).alias("Name"),
        F.date_add(F.lit("1960-01-01").cast("date"), (ck % 12000).cast("int")).alias("DateOfBirth"),
        F.when(ck % 7 != 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
                                     F.lit("@example.com"))).otherwise(F.lit("")).alias("Email"),
        F.when(ck % 11 != 0, padded_key("+1-555-", ck)).alias("PhoneNumber"))
    new = c.where(ck % 40 == 1).select(
        new_seq(ck).alias("seq"), padded_key("N", ck).alias("NIF"),
        F.concat(F.lit("New "), F.col("c_name")).alias("Name"),
        F.lit("1999-01-01").cast("date").alias("DateOfBirth"),
        F.lit(None).cast("string").alias("Email"), F.lit(None).cast("string").alias("PhoneNumber"))
    return known.unionByName(new)


def contributor_requests(d: dict[str, DataFrame]) -> DataFrame:
    return person_requests(d).withColumn("Roles", F.lit("Artist"))


def employee_requests(d: dict[str, DataFrame]) -> DataFrame:
    """Person requests with employment fields and a conflict policy per request."""
    c = d["customer"].select("c_custkey", "c_nationkey", "c_mktsegment")
    r = person_requests(d)
    r = r.withColumn("_ck", F.shiftright("seq", 1))
    j = r.join(c, F.col("_ck") == F.col("c_custkey"))
    return j.select(
        *[x for x in r.columns if x != "_ck"],
        F.lit("Analyst").alias("JobTitle"), F.col("c_mktsegment").alias("Department"),
        F.lit(1000).cast("decimal(10,2)").alias("Salary"),
        F.lit("2024-01-01").cast("date").alias("HireDate"),
        F.col("c_nationkey").alias("RecordLabelID"),
        F.when(F.col("seq") % 3 == 0, "keep").when(F.col("seq") % 3 == 1, "overwrite")
        .otherwise("cancel").alias("policy"))


def person_updates(d: dict[str, DataFrame]) -> DataFrame:
    """seq, NIF, Name: renamed known people plus NIFs nobody holds."""
    c = d["customer"]
    ck = F.col("c_custkey")
    known = c.where(ck % 25 == 2).select(known_seq(ck).alias("seq"), nif_of(ck).alias("NIF"),
                                         F.concat("c_name", F.lit(" Jr")).alias("Name"))
    unknown = c.where(ck % 500 == 0).select(new_seq(ck).alias("seq"),
                                            padded_key("N", ck).alias("NIF"),
                                            F.lit("Nobody").alias("Name"))
    return known.unionByName(unknown)


def label_creates(d: dict[str, DataFrame]) -> DataFrame:
    s = d["supplier"]
    sk = F.col("s_suppkey")
    return s.where(sk % 10 == 1).select(
        sk.alias("seq"), F.concat(F.lit("Label "), F.col("s_name")).alias("Name"),
        F.lit(None).cast("string").alias("Location"),
        F.concat(F.lit("https://label-"), sk.cast("string"), F.lit(".example")).alias("Website"),
        F.concat(F.lit("label-"), sk.cast("string"), F.lit("@example.com")).alias("Email"),
        padded_key("+44-9", sk, 8).alias("PhoneNumber"))


def song_creates(d: dict[str, DataFrame]) -> DataFrame:
    p = d["part"]
    pk = F.col("p_partkey")
    return p.where(pk % 20 == 3).select(
        pk.alias("seq"), F.concat(F.lit("Remix "), F.col("p_name")).alias("Title"),
        (F.col("p_size") * 10).alias("Duration"), F.lit(None).cast("date").alias("ReleaseDate"),
        F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand")).alias("Genres"),
        F.concat(nif_of(pk % 150), F.lit(", "), nif_of(pk % 150 + 1)).alias("Contributors"))


def role_requests(d: dict[str, DataFrame]) -> DataFrame:
    sk = F.col("s_suppkey")
    return d["supplier"].select(
        sk.alias("seq"), sk.alias("ContributorID"),
        F.when(sk % 3 == 0, "Artist, Producer").when(sk % 3 == 1, " Dancer,Artist")
        .otherwise("Songwriter").alias("Roles"))


def collaboration_creates(d: dict[str, DataFrame]) -> DataFrame:
    o = d["orders"]
    ok = F.col("o_orderkey")
    return o.where(ok % 50 == 2).select(
        ok.alias("seq"), F.concat(F.lit("New "), ok.cast("string")).alias("CollaborationName"),
        F.col("o_orderdate").cast("date").alias("StartDate"), F.lit(None).cast("date").alias("EndDate"),
        F.lit(None).cast("string").alias("Description"), F.lit(None).cast("bigint").alias("SongID"),
        F.lit(None).cast("string").alias("RecordLabels"),
        F.concat(nif_of(ok % 120), F.lit(","), nif_of(ok % 120 + 1)).alias("Contributors"))


def label_updates(t: Tables) -> DataFrame:
    rl = t["RecordLabel"]
    return rl.where(F.col("RecordLabelID") % 5 == 0).select(
        F.col("RecordLabelID").cast("bigint").alias("seq"), "RecordLabelID",
        F.concat("Name", F.lit(" Ltd")).alias("Name"), F.lit(None).cast("string").alias("Location"),
        "Website", "Email", "PhoneNumber")


def song_updates(t: Tables) -> DataFrame:
    s = t["Song"]
    return s.where(F.col("SongID") % 30 == 4).select(
        F.col("SongID").alias("seq"), "SongID", "Title", "Duration", "ReleaseDate",
        F.lit("Live").alias("Genres"), F.lit(None).cast("string").alias("Contributors"))


def contributor_role_updates(t: Tables) -> DataFrame:
    c = t["Contributor"]
    cid = F.col("ContributorID")
    return c.where(cid % 4 == 1).select(
        cid.alias("seq"), cid.alias("ContributorID"),
        F.when(cid % 8 == 1, "Producer").otherwise("Songwriter").alias("Roles"))


def employee_updates(t: Tables) -> DataFrame:
    e = t["Employee"]
    return e.where(F.col("EmployeeID") % 10 == 0).select(
        F.col("EmployeeID").alias("seq"), "EmployeeID", "JobTitle", "Department",
        (F.col("Salary") + 100).cast("decimal(10,2)").alias("Salary"), "HireDate",
        F.col("RecordLabel_RecordLabelID").alias("RecordLabelID"))


def nif_changes(d: dict[str, DataFrame]) -> DataFrame:
    ck = F.col("c_custkey")
    return d["customer"].where(ck % 9 == 0).select(
        ck.alias("seq"), nif_of(ck).alias("OldNIF"),
        F.concat(F.lit("Q"), F.substring(nif_of(ck), 2, 1 << 20)).alias("NewNIF"))


def collaboration_updates(t: Tables) -> DataFrame:
    k = t["Collaboration"]
    return k.where(F.col("CollaborationID") % 40 == 6).select(
        F.col("CollaborationID").alias("seq"), "CollaborationID", "CollaborationName", "StartDate",
        "EndDate", "Description", F.col("Song_SongID").alias("SongID"),
        F.lit(None).cast("string").alias("RecordLabels"),
        F.lit(", ".join(f"P{i:07d}" for i in (0, 1, 2))).alias("Contributors"))


def genre_lists(d: dict[str, DataFrame]) -> DataFrame:
    p = d["part"]
    return p.select(F.col("p_partkey").alias("SongID"),
                    F.concat("p_type", F.lit(" , "), "p_brand", F.lit(",,"), "p_type").alias("Genres"))


def nif_lists(d: dict[str, DataFrame]) -> DataFrame:
    sk = F.col("s_suppkey")
    return d["supplier"].select(sk.alias("seq"), F.concat(
        nif_of(sk), F.lit(", "), nif_of(sk + 7), F.lit(",X9")).alias("Contributors"))


def ids_where(df: DataFrame, col: str, modulo: int, rest: int, out: str | None = None) -> DataFrame:
    """A delete or lookup key set: column ``out`` (``col``) of the rows with ``col % modulo == rest``."""
    return df.where(F.col(col) % modulo == rest).select(out or col)


def nif_chains(d: dict[str, DataFrame]) -> DataFrame:
    """seq, OldNIF, NewNIF: chains that end in a free or in a held key, swaps, keys asked for twice."""
    ck = F.col("c_custkey")
    r, block = ck % 9, F.floor(ck / 9)
    new = (F.when(r < 2, nif_of(ck + 1))
           .when(r == 2, F.when(block % 2 == 0, padded_key("Q", ck)).otherwise(nif_of(ck + 1)))
           .when(r == 5, nif_of(ck + 1)).when(r == 6, nif_of(ck - 1))
           .when(r == 7, padded_key("Z", F.floor(block / 2))))
    return d["customer"].select(ck.alias("seq"), nif_of(ck).alias("OldNIF"), new.alias("NewNIF")).where("NewNIF is not null")


def label_conflicts(d: dict[str, DataFrame]) -> DataFrame:
    """Label requests in groups of five: neighbours share a name or an e-mail in turn.

    In every third group the first request asks for a stored name.
    """
    s, n = d["supplier"], d["nation"]
    sk = F.col("s_suppkey")
    g, p = F.floor(sk / 5), sk % 5
    stored = n.select(F.col("n_nationkey").alias("_n"), "n_name")
    j = s.select(sk, g.alias("g"), p.alias("p")).join(stored, F.col("g") % 25 == F.col("_n"), "left")
    part = F.concat(F.col("g").cast("string"), F.lit("-"))
    return j.select(
        F.col("s_suppkey").alias("seq"),
        F.when((F.col("g") % 3 == 0) & (F.col("p") == 0) & F.col("n_name").isNotNull(), F.col("n_name")).otherwise(
            F.concat(F.lit("Name "), part, F.floor(F.col("p") / 2).cast("string"))).alias("Name"),
        F.lit(None).cast("string").alias("Location"), F.lit(None).cast("string").alias("Website"),
        F.concat(part, F.floor((F.col("p") + 1) / 2).cast("string"), F.lit("@mail.example")).alias("Email"),
        padded_key("+49-", F.col("s_suppkey"), 8).alias("PhoneNumber"))


def email_moves(d: dict[str, DataFrame]) -> DataFrame:
    """seq, NIF, Name, Email: of ten people the first four each ask for the next one's e-mail.

    In every second ten the fourth asks for a new one, so all four move;
    else the fifth keeps the e-mail, and who waits for it is refused.
    """
    c = d["customer"]
    nxt = c.select((F.col("c_custkey") - 1).alias("_k"), F.concat(F.lower(F.replace(
        "c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("_next"))
    ck = F.col("c_custkey")
    j = c.where(ck % 10 < 4).join(nxt, ck == F.col("_k"))
    fresh = F.concat(F.lit("fresh"), ck.cast("string"), F.lit("@example.com"))
    return j.select(ck.alias("seq"), nif_of(ck).alias("NIF"), F.col("c_name").alias("Name"),
                    F.when((ck % 10 == 3) & (F.floor(ck / 10) % 2 == 1), fresh).otherwise(F.col("_next")).alias("Email"))


def faulty_employee_requests(d: dict[str, DataFrame], t: Tables) -> DataFrame:
    """Employee requests of which some break a rule: salary, length, label, an e-mail already held."""
    r = employee_requests(d)
    held = t["Person"].select(F.concat(F.lit("N"), F.substring("NIF", 2, 1 << 20)).alias("NIF"), F.col("Email").alias("_held"))
    j = r.join(held, "NIF", "left")
    seq = F.col("seq")
    swapped = {"Salary": F.when(seq % 7 == 0, F.lit(-5)).otherwise(F.col("Salary")).cast("decimal(10,2)"),
               "JobTitle": F.when(seq % 11 == 0, F.repeat(F.lit("x"), F.lit(101))).otherwise(F.col("JobTitle")),
               "RecordLabelID": F.when(seq % 5 == 0, F.lit(99999)).otherwise(F.col("RecordLabelID")),
               "Email": F.coalesce("_held", "Email")}
    return j.select(*[swapped[c].alias(c) if c in swapped else F.col(c) for c in r.columns])


def contributor_key_updates(t: Tables) -> DataFrame:
    """Contributor updates with a new NIF, free or held by a person who keeps it, a name and roles."""
    cid = F.col("ContributorID")
    return t["Contributor"].where(cid % 4 == 1).select(
        cid.alias("seq"), cid.alias("ContributorID"),
        F.when(cid % 8 == 1, padded_key("Q", cid)).otherwise(nif_of(cid + 1)).alias("NIF"),
        F.concat(F.lit("Renamed "), cid.cast("string")).alias("Name"), F.lit("Producer").alias("Roles"))


def thinned_collaborations(t: Tables) -> DataFrame:
    """Collaboration updates that leave one contributor."""
    return collaboration_updates(t).withColumn("Contributors", F.lit("P0000001"))


def request_lines(d: dict[str, DataFrame]) -> DataFrame:
    """Contributor requests as JSON lines; some are cut, some carry a text for a number."""
    ck = F.col("c_custkey")
    line = F.to_json(F.struct(ck.alias("seq"), nif_of(ck).alias("NIF"), F.when(ck % 6 != 0, F.col("c_name")).alias("Name"),
                              F.lit("Artist").alias("Roles")))
    cut = F.concat(F.lit('{"seq": '), ck.cast("string"), F.lit(', "NIF": "P'))
    odd = F.concat(F.lit('{"seq": "no number", "NIF": "'), nif_of(ck), F.lit('"}'))
    return d["customer"].select(F.when(ck % 10 == 3, cut).when(ck % 10 == 7, odd).otherwise(line).alias("value"))
