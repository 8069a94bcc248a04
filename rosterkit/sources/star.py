"""Build the roster tables from the driver's order/line-item star schema.

This is an input builder: it only produces rows in the roster schema
(labels from nations, people from customers, contributors from
suppliers, songs from parts, collaborations from orders, links from line
items).  All operators work on any data of that schema; none relies on
how these rows are made.

Every table is a lazy DataFrame, so a query only scans the driver tables
its plan needs, with column pruning down to the Parquet reader.

With the session setting ``rosterkit.star.store=true`` each table is
written once per session, on first use, as Parquet under
``spark.checkpoint.dir`` and read back from there.  Later queries then
read stored roster tables, as they would on a cluster that keeps its
roster as tables (``read_tables``), instead of recomputing the line-item
aggregates and joins in every query.  The written copy also cuts the
lineage, so a lost executor does not recompute the builder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import padded_key
from ..plans.session import ensure_checkpoint_dir
from .lazy import LazyTables
from .schema import SCHEMAS

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
TASK_ROWS = 1_000_000
CONF_STORE = "rosterkit.star.store"  # "true": write each built table once per session


def read_driver(spark: SparkSession, sf_dir: str) -> LazyTables:
    """The driver tables, each read (footer, schema) on first use; kept per session."""
    memo = spark.__dict__.setdefault("_rosterkit_driver", {})
    if sf_dir not in memo:
        memo[sf_dir] = LazyTables({t: (lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
                                   for t in DRIVER_TABLES})
    return memo[sf_dir]


def _days(start: str, col) -> F.Column:
    return F.date_add(F.lit(start).cast("date"), col.cast("int"))


def nif_of(col) -> F.Column:
    return padded_key("P", col)


def tasks_for(table: DataFrame) -> int:
    """How many tasks the rows of a stored table are dealt out to: ``TASK_ROWS`` a task at most, as a rule.

    AQE joins small shuffle partitions by their compressed bytes, which says
    little of the rows, and of the memory of the sorts and hash tables over
    them, that one task then holds.  A number given to ``repartition`` stays.
    The rows are counted from the file footers.
    """
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // TASK_ROWS))


def star_tables(spark: SparkSession, sf_dir: str, *, raw_links: bool = False,
                fresh: bool = False) -> LazyTables:
    """The roster tables over the driver tables of ``sf_dir`` (built on first use).

    With ``raw_links=True`` the map also holds ``RLC_raw``: label links
    before the ID1 <> ID2 check, the input of the self-link checks.  The
    map is kept per session and folder, so later queries reuse the built
    plans (only plans: every query still reads and computes its data);
    ``fresh=True`` builds a new one.
    """
    memo = spark.__dict__.setdefault("_rosterkit_star", {})
    store = (spark.conf.get(CONF_STORE, "false") or "false").lower() == "true"
    if not fresh and (sf_dir, store) in memo:
        return memo[(sf_dir, store)]
    d = read_driver(spark, sf_dir)
    t: LazyTables

    def record_label():
        nation, region = d["nation"], d["region"]
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("RecordLabelID"),
            F.col("n_name").alias("Name"),
            F.col("r_name").alias("Location"),
            F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example")).alias("Website"),
            F.concat(F.lit("info@"), F.lower("n_name"), F.lit(".example")).alias("Email"),
            padded_key("+44-", F.col("n_nationkey")).alias("PhoneNumber"))

    ck = F.col("c_custkey")

    def person():
        return d["customer"].select(
            nif_of(ck).alias("NIF"),
            F.col("c_name").alias("Name"),
            _days("1960-01-01", ck % 12000).alias("DateOfBirth"),
            F.when(ck % 7 != 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
                                         F.lit("@example.com"))).alias("Email"),
            F.when(ck % 11 != 0, padded_key("+1-555-", ck)).alias("PhoneNumber"))

    sk = F.col("s_suppkey")

    def contributor():
        return d["supplier"].select(sk.alias("ContributorID"), nif_of(sk).alias("Person_NIF"))

    def employee():
        return d["customer"].where(ck % 2 == 0).select(
            ck.alias("EmployeeID"),
            F.when(ck % 6 == 0, "Engineer").when(ck % 6 == 2, "Manager").otherwise("Analyst")
            .alias("JobTitle"),
            F.col("c_mktsegment").alias("Department"),
            F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal"))
            .cast("decimal(10,2)").alias("Salary"),
            _days("2015-01-01", ck % 3000).alias("HireDate"),
            F.col("c_nationkey").alias("RecordLabel_RecordLabelID"),
            nif_of(ck).alias("Person_NIF"))

    def song():
        return d["part"].select(
            F.col("p_partkey").alias("SongID"),
            F.col("p_name").alias("Title"),
            (F.col("p_size") * 10).alias("Duration"),
            F.when(F.col("p_size") % 9 != 0, _days("2015-01-01", F.col("p_size"))).alias("ReleaseDate"))

    def song_genre():
        return d["part"].select(F.col("p_partkey").alias("Song_SongID"),
                                F.explode(F.array("p_type", "p_brand")).alias("Genre"))

    def contributor_song():
        return (d["lineitem"]
                .groupBy(F.col("l_suppkey").alias("Contributor_ContributorID"),
                         F.col("l_partkey").alias("Song_SongID"))
                .agg(F.min("l_shipdate").cast("date").alias("Date")))

    def collaboration():
        orders = d["orders"]
        first_part = d["lineitem"].groupBy("l_orderkey").agg(F.min("l_partkey").alias("Song_SongID"))
        start = F.col("o_orderdate").cast("date")
        return orders.join(first_part, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderkey").alias("CollaborationID"),
            F.concat(F.lit("Collab "), F.col("o_orderpriority"), F.lit(" "),
                     F.col("o_orderkey").cast("string")).alias("CollaborationName"),
            start.alias("StartDate"),
            F.when(F.col("o_orderstatus") == "F", F.date_add(start, 30)).alias("EndDate"),
            F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("Description"),
            F.col("Song_SongID"))

    def collaboration_contributor():
        # dealt out by both columns: a collaboration of very many lines is spread as well
        return d["lineitem"].select(
            F.col("l_orderkey").alias("Collaboration_CollaborationID"),
            F.col("l_suppkey").alias("Contributor_ContributorID")).repartition(
            tasks_for(d["lineitem"]), "Collaboration_CollaborationID", "Contributor_ContributorID").distinct()

    def rlc_raw():
        # both labels are looked up before the lines meet their order, so the lines are dealt out once, by order
        # ("merge": if the lines are counted first, AQE would send them to the orders' tasks, which may be one)
        lines = (d["lineitem"].select("l_orderkey", "l_suppkey")
                 .join(d["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
                 .select("l_orderkey", "s_nationkey"))
        orders = (d["orders"].select("o_orderkey", "o_custkey")
                  .join(d["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
                  .select("o_orderkey", "c_nationkey"))
        return (
            lines.repartition(tasks_for(d["lineitem"]), "l_orderkey")
            .join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("c_nationkey").alias("RecordLabel_RecordLabelID1"),
                    F.col("s_nationkey").alias("RecordLabel_RecordLabelID2"),
                    F.col("o_orderkey").alias("Collaboration_CollaborationID"))
            .distinct())

    def record_label_collaboration():
        return t["RLC_raw"].where(
            F.col("RecordLabel_RecordLabelID1") != F.col("RecordLabel_RecordLabelID2"))

    def artist():
        return d["supplier"].where(sk % 2 == 0).select(
            sk.alias("Contributor_ContributorID"),
            F.concat(F.lit("Artist_"), sk.cast("string")).alias("StageName"))

    def producer():
        return d["supplier"].where(sk % 3 == 0).select(sk.alias("Contributor_ContributorID"))

    def songwriter():
        return d["supplier"].where(sk % 5 == 0).select(sk.alias("Contributor_ContributorID"))

    def artist_genre():
        # Genres an artist has sung in: the genres of the songs linked to them.
        return (t["Contributor_Song"].join(t["Artist"].select("Contributor_ContributorID"),
                                           "Contributor_ContributorID", "left_semi")
                .join(t["Song_Genre"], "Song_SongID")
                .select(F.col("Contributor_ContributorID").alias("Artist_ContributorID"), "Genre")
                .distinct())

    builders = {
        "RecordLabel": record_label, "Person": person, "Song": song, "Contributor": contributor,
        "Songwriter": songwriter, "Producer": producer, "Artist": artist,
        "Collaboration": collaboration, "Collaboration_Contributor": collaboration_contributor,
        "Contributor_Song": contributor_song, "Song_Genre": song_genre, "Artist_Genre": artist_genre,
        "RecordLabel_Collaboration": record_label_collaboration, "Employee": employee,
    }
    conformed = {name: (lambda name=name, fn=fn: conform(fn(), name)) for name, fn in builders.items()}
    conformed["RLC_raw"] = rlc_raw
    if store:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/roster-{uuid.uuid4().hex}"
        conformed = {name: (lambda name=name, fn=fn: stored(spark, f"{folder}/{name}", name, fn))
                     for name, fn in conformed.items()}
    t = LazyTables(conformed)
    memo[(sf_dir, store)] = t
    return t


def stored(spark: SparkSession, path: str, name: str, build) -> DataFrame:
    """Write the built table to ``path`` (under the checkpoint folder); read it back."""
    df = build()
    df.write.mode("overwrite").parquet(path)
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(path)


def stored_tables(spark: SparkSession, t: LazyTables, names: tuple[str, ...]) -> LazyTables:
    """The map with the tables of ``names`` written on first use and read back: a job that reads a table many
    times (a change, then what follows it) reads it as stored, without building it from the line items each time."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/roster-{uuid.uuid4().hex}"
    builders = {name: (lambda name=name: t[name]) for name in t}
    builders |= {name: (lambda name=name: stored(spark, f"{folder}/{name}", name, lambda: t[name])) for name in names}
    return LazyTables(builders)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the table's columns in schema order, cast to the schema types."""
    schema = SCHEMAS[table]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
