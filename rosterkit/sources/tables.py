"""Typed table load (SRC-1) and versioned publish with a manifest (SNK-2).

A published roster is a folder::

    root/data/<table>/<write id>/...      one folder per written table version
    root/_manifests/version=<n>/<id>/...  one row per table: path, rows, schema

A version exists once its manifest does, and the manifest is written last, as
one file.  Tables that a job did not change are named by the new manifest, not
written again.  Data folders are new for every write, so no job overwrites
what another one reads.  Everything goes through Spark's own readers and
writers, so ``root`` may be in any store Spark reaches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .lazy import LazyTables
from .schema import SCHEMAS, TABLES

_MANIFEST = ("id string, table_name string, path string, format string, row_count long, table_schema string, "
             "n_tables int, version long")


class Version(LazyTables):
    """The tables of one published version, and where each of them is."""

    def __init__(self, number: int, entries: Mapping[str, Row], builders):
        super().__init__(builders)
        self.number, self.entries = number, dict(entries)


def _reader(spark: SparkSession, table: str, fmt: str, options: Mapping[str, str] | None = None):
    reader = spark.read.schema(SCHEMAS[table]).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader


def manifests(spark: SparkSession, path: str) -> list[tuple[int, str, list[Row]]]:
    """(version, id, rows) of the complete manifests under ``path``, oldest first.

    A manifest holds as many rows as it says it has tables; of two with one
    number (two jobs published at once) the lesser id counts.
    """
    try:
        rows = spark.read.schema(_MANIFEST).option("recursiveFileLookup", "false").parquet(f"{path}/_manifests").collect()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing.getCondition()):
            raise
        return []
    found: dict[tuple[int, str], list[Row]] = {}
    for r in rows:
        found.setdefault((r["version"], r["id"]), []).append(r)
    complete = sorted((v, i) for (v, i), rs in found.items() if len(rs) == rs[0]["n_tables"])
    first: dict[int, str] = {}
    for v, i in complete:
        first.setdefault(v, i)
    return [(v, i, found[v, i]) for v, i in first.items()]


def read_version(spark: SparkSession, path: str, version: int | None = None) -> Version:
    """The newest complete version under ``path``, or the numbered one."""
    known = [m for m in manifests(spark, path) if version in (None, m[0])]
    if not known:
        raise FileNotFoundError(f"no published version {'' if version is None else version} under {path}")
    number, _, rows = known[-1]
    entries = {r["table_name"]: r for r in rows}
    builders = {t: (lambda r=r, t=t: _reader(spark, t, r["format"]).load(r["path"])) for t, r in entries.items()}
    return Version(number, entries, builders)


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet", tables: Iterable[str] = TABLES,
                options: dict[str, str] | None = None, version: int | None = None) -> Mapping[str, DataFrame]:
    """Load the roster tables with their fixed schemas (SRC-1).

    A published folder (one with manifests) gives its newest complete
    version, or ``version``; any other folder is read as
    ``{path}/{table}``.  Schemas are given, never inferred, so CSV/JSON
    inputs get the same types as Parquet ones and no inference pass reads
    the data twice.
    """
    if manifests(spark, path):
        return read_version(spark, path, version)
    return {t: _reader(spark, t, fmt, options).load(f"{path}/{t}") for t in tables}


def publish(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", base: Version | None = None) -> list[str]:
    """Publish a new version of the roster under ``path`` (SNK-2); returns the tables that were written.

    ``base`` is the version the tables were derived from: a table that is
    still that version's DataFrame is referenced, not written.  A failure
    at any table leaves every earlier version as it was and readable; the
    folders it has written belong to no version.  If another job published
    the same number first, this one raises and its version does not count.
    """
    spark = next(iter(tables.values())).sparkSession
    write_id = uuid.uuid4().hex
    rows, written = [], []
    names = [t for t in TABLES if t in tables]
    for name in names:
        if base is not None and name in base.entries and tables[name] is base[name]:
            e = base.entries[name]
            rows.append((write_id, name, e["path"], e["format"], e["row_count"], e["table_schema"], len(names)))
            continue
        folder = f"{path}/data/{name}/{write_id}"
        df = tables[name].select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields])
        writer = df.write.format(fmt)
        (writer.option("header", "true") if fmt == "csv" else writer).save(folder)
        # read back: the count is of what readers will see
        n = _reader(spark, name, fmt).load(folder).count()
        rows.append((write_id, name, folder, fmt, n, SCHEMAS[name].json(), len(names)))
        written.append(name)
    number = max([m[0] for m in manifests(spark, path)], default=0) + 1
    manifest = spark.createDataFrame(rows, _MANIFEST.rsplit(", ", 1)[0])
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/_manifests/version={number}")
    winner = next(i for v, i, _ in manifests(spark, path) if v == number)
    if winner != write_id:
        raise RuntimeError(f"version {number} of {path} was published by another job; publish again on top of it")
    return written
