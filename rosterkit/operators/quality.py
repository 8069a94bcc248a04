"""Integrity checks (QC-1 … QC-7): each returns the violating rows.

The table rules of ``sources.schema`` become jobs: duplicates are a
grouped count (partial counts on the map side, so a hot key ships one
row per task), foreign keys an anti join against de-duplicated parent
keys, the rest plain filters that stay in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import RULES, foreign_keys_of
from .changes import union_all
from .joins import join_to_unique

Tables = dict[str, DataFrame]


def pk_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """QC-1: key values held by more than one row, with their count ``n``.

    Rows with a NULL key part are reported as well (n = their count).
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(
        (F.col("n") > 1) | F.greatest(*[F.col(k).isNull() for k in keys] + [F.lit(False)]))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """QC-1 without the NULL rule: key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unique_violations(df: DataFrame, col: str, nulls_distinct: bool = True,
                      value_name: str = "v") -> DataFrame:
    """QC-2: non-NULL values of ``col`` held by more than one row.

    With ``nulls_distinct=False`` several NULLs also count as a clash
    (engines that allow a single NULL in a unique column).
    """
    src = df.where(F.col(col).isNotNull()) if nulls_distinct else df
    return (src.groupBy(F.col(col).alias(value_name)).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def fk_violations(child: DataFrame, parent: DataFrame, columns: list[str],
                  parent_columns: list[str]) -> DataFrame:
    """QC-3: child rows with a non-NULL foreign key that has no parent row."""
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_columns, columns)]).distinct()
    nn = child
    for c in columns:
        nn = nn.where(F.col(c).isNotNull())
    # a foreign key value held by a huge share of the child rows is split
    return join_to_unique(nn, keys, columns, "left_anti")


def not_null_violations(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """QC-4: one row per (row key, NULL column) as ``ColumnName``."""
    names = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    return (df.select(*key, F.explode(F.filter(names, lambda x: x.isNotNull())).alias("ColumnName")))


def date_order_violations(df: DataFrame, start: str, end: str) -> DataFrame:
    """QC-5: rows whose ``end`` is before ``start`` (a NULL end passes)."""
    return df.where(F.col(end) < F.col(start))


def check_violations(df: DataFrame, predicate: str) -> DataFrame:
    """QC-6: rows for which a row check is false (NULL passes, as in SQL)."""
    return df.where(~F.coalesce(F.expr(predicate), F.lit(True)))


def length_violations(df: DataFrame, col: str, max_len: int, out: str = "n") -> DataFrame:
    """QC-7: rows whose text is longer than ``max_len``, with the length."""
    return df.withColumn(out, F.length(col).cast("bigint")).where(F.col(out) > max_len)


def _row_rules(table: str) -> list[tuple[str, str, F.Column]]:
    """(rule, detail, violation predicate) for the row-level rules of a table."""
    rules = RULES[table]
    out = [(f"not_null", c, F.col(c).isNull()) for c in rules.not_null]
    out += [(f"check:{chk.name}", chk.sql, ~F.coalesce(F.expr(chk.sql), F.lit(True)))
            for chk in rules.checks]
    out += [(f"length:{c}", str(n), F.coalesce(F.length(c) > n, F.lit(False)))
            for c, n in rules.max_length.items()]
    return out


def check_tables(t: Tables) -> DataFrame:
    """Every rule of every table: (table, rule, detail, n) per violated rule.

    Row-level rules (NOT NULL, checks, lengths) of a table are counted in
    one aggregate over one scan; keys, unique values and foreign keys need
    one grouped count or anti join each.
    """
    out = []
    for table, rules in RULES.items():
        if table not in t:
            continue
        df = t[table]
        keys = list(rules.pk)
        out.append(pk_violations(df, keys).select(
            F.lit(table).alias("table"), F.lit("pk").alias("rule"),
            F.concat_ws(",", *[F.col(k).cast("string") for k in keys]).alias("detail"), "n"))
        for (col,) in rules.unique:
            out.append(unique_violations(df, col).select(
                F.lit(table).alias("table"), F.lit(f"unique:{col}").alias("rule"),
                F.col("v").cast("string").alias("detail"), "n"))
        row_rules = _row_rules(table)
        if row_rules:
            counts = df.agg(*[F.count_if(pred).alias(f"_r{i}") for i, (_, _, pred) in
                              enumerate(row_rules)])
            stacked = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(detail).alias("detail"),
                                                   F.col(f"_r{i}").alias("n"))
                                          for i, (rule, detail, _) in enumerate(row_rules)]))
            out.append(counts.select(stacked.alias("_s")).select(
                F.lit(table).alias("table"), "_s.rule", "_s.detail", "_s.n").where(F.col("n") > 0))
        for fk in foreign_keys_of(table):
            if fk.parent not in t:
                continue
            out.append(fk_violations(df, t[fk.parent], list(fk.columns), list(fk.parent_columns))
                       .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0).select(
                           F.lit(table).alias("table"), F.lit(f"fk:{fk.parent}").alias("rule"),
                           F.lit(",".join(fk.columns)).alias("detail"), "n"))
    return union_all(out)


def enforce_rules(t: Tables, materialize: bool = False) -> tuple[Tables, DataFrame]:
    """Load-time rule enforcement: (tables holding only valid rows, rejects).

    Tables are cleaned parents first.  A row is rejected when a NOT NULL
    column is NULL, a row check fails, it repeats a primary key or unique
    value already taken by a kept row (the smallest row per key is kept,
    so the result does not depend on task order), or its foreign key
    points at no kept parent row.  ``rejects``: (table, rule, row) with
    the row as JSON.  ``materialize=True`` checkpoints each cleaned table
    (into ``spark.checkpoint.dir``) so children and rejects reuse it
    instead of recomputing the parent chain.
    """
    from ..sources.schema import TOPOLOGICAL_ORDER
    out = dict(t)
    rej = []

    def reject(df, table, rule):
        rej.append(df.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"),
                             F.to_json(F.struct(*df.columns)).alias("row")))

    for table in TOPOLOGICAL_ORDER:
        if table not in t or table not in RULES:
            continue
        rules, df = RULES[table], t[table]
        cols = df.columns
        for c in rules.not_null:
            reject(df.where(F.col(c).isNull()), table, f"not_null:{c}")
            df = df.where(F.col(c).isNotNull())
        for chk in rules.checks:
            bad = ~F.coalesce(F.expr(chk.sql), F.lit(True))
            reject(df.where(bad), table, f"check:{chk.name}")
            df = df.where(~bad)
        for fk in foreign_keys_of(table):
            if fk.parent not in out:
                continue
            orphans = fk_violations(df, out[fk.parent], list(fk.columns), list(fk.parent_columns))
            reject(orphans, table, f"fk:{fk.parent}")
            keys = out[fk.parent].select(*[F.col(p).alias(c) for p, c in
                                           zip(fk.parent_columns, fk.columns)]).distinct()
            nulls = None
            for c in fk.columns:
                cond = F.col(c).isNull()
                nulls = cond if nulls is None else nulls | cond
            df = df.where(nulls).unionByName(df.where(~nulls).join(keys, list(fk.columns), "left_semi"))
        for key, rule in [(list(rules.pk), "pk")] + [(list(u), f"unique:{','.join(u)}")
                                                     for u in rules.unique]:
            others = [c for c in cols if c not in key]
            src = df.where(F.col(key[0]).isNotNull()) if rule != "pk" else df
            keep = src.groupBy(*key).agg(F.min(F.struct(*others)).alias("_r")) if others else \
                src.select(*key).distinct()
            if others:
                keep = keep.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*cols)
            dropped = src.exceptAll(keep)
            reject(dropped, table, rule)
            df = (keep if rule == "pk" else
                  keep.unionByName(df.where(F.col(key[0]).isNull())))
        if materialize:
            from ..plans.session import ensure_checkpoint_dir
            ensure_checkpoint_dir(df.sparkSession)
            df = df.checkpoint(eager=True)
        out[table] = df
    return out, union_all(rej)
