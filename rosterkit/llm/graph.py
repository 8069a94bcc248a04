"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _stars(edges: DataFrame, scratch: Scratch, name: str | None) -> DataFrame:
    """Link every ``v`` of a node's links (u, v) to the least of u's links.

    With a ``name`` the least per node (a partial aggregate) is kept as a
    table, so the join back to the links is between two plain shuffles and
    a node with very many links is split by AQE.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = scratch.keep(least, f"{name}-least") if name else least
    linked = edges.join(least, "u").select(F.explode(F.array(
        F.struct(F.col("v").alias("a"), F.least("m", "u").alias("b")),
        F.struct(F.col("u").alias("a"), F.least("m", "u").alias("b")))).alias("e"))
    return linked.select("e.a", "e.b").where("a > b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node reachable.

    Self links and repeated links are allowed; NULL ends are left out.  Each
    round is written to the scratch folder; the links converge to stars in a
    number of rounds that grows with the logarithm of the longest path.
    """
    current = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = scratch.keep(current, f"{name}-0")
    seen, step = None, 0
    while True:
        state = current.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"),
                            F.expr("sum(cast(b as decimal(38,0)))").alias("s")).first()
        if (state["n"], state["x"], state["s"]) == seen:
            break
        seen, step = (state["n"], state["x"], state["s"]), step + 1
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = scratch.keep(_stars(both, scratch, f"{name}-{step}l"), f"{name}-{step}l")
        # after a large-star round a node's smaller neighbours are few
        small = _stars(large.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, None)
        current = scratch.keep(small, f"{name}-{step}")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
