"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The topology is a tree of regions, racks and shards with weights.  A row
descends it: at each level every child draws ln(u) / weight with u from a
hash of the row's key and the child's id, and the largest draw wins, so a
child gets rows in proportion to its weight.  Draws of different children
are independent: a changed weight moves rows only into or out of the
subtree it belongs to.

``regular(n)`` puts the first ``base`` shards in regions of ``racks`` racks
of ``per_rack`` shards and every further shard in a region of its own.  One
more shard therefore changes no older weight, and rows move only into it:
the law ``key``.  Adding shards to an existing region instead
(``Topology.with_weights``) moves rows inside that region as well, and
nowhere else.

Slots number the rows of a shard from 0 without a gap.  Rows are cut in
``BUCKETS`` hash buckets per shard, numbered inside their bucket, and the
bucket's offset comes from the counts of the buckets before it; the counts
are one row per shard and bucket, whatever the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_SHARDS = 40
RACKS = 2
PER_RACK = 4
#: hexadecimal digits of the key hash that make the bucket: 4096 buckets a shard
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Node:
    """A region, rack or shard: its id in the hash, weight, and children or shard number."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


@dataclass(frozen=True)
class Topology:
    regions: tuple[Node, ...]

    def with_weights(self, weights: dict[int, float]) -> Topology:
        """The same tree with other shard weights; inner weights are the sums of the children's."""
        def again(node: Node) -> Node:
            if node.shard >= 0:
                return replace(node, weight=weights.get(node.shard, node.weight))
            children = tuple(again(c) for c in node.children)
            return replace(node, children=children, weight=sum(c.weight for c in children))
        return Topology(tuple(again(r) for r in self.regions))


def regular(shards: int, base: int = BASE_SHARDS, racks: int = RACKS, per_rack: int = PER_RACK) -> Topology:
    def leaf(s: int) -> Node:
        return Node(f"s{s}", 1.0, (), s)

    def inner(name: str, children: list[Node]) -> Node:
        return Node(name, sum(c.weight for c in children), tuple(children))

    regions, first = [], min(base, shards)
    for r, start in enumerate(range(0, first, racks * per_rack)):
        own = range(start, min(first, start + racks * per_rack))
        split = [own[i:i + per_rack] for i in range(0, len(own), per_rack)]
        regions.append(inner(f"r{r}", [inner(f"r{r}k{k}", [leaf(s) for s in part]) for k, part in enumerate(split)]))
    for s in range(first, shards):
        regions.append(inner(f"x{s}", [inner(f"x{s}k0", [leaf(s)])]))
    return Topology(tuple(regions))


def _children(topology: Topology) -> tuple[Column, Column, int]:
    """(map of node number -> children, map of node number -> shard, depth); the root is node 0."""
    lists, leaves, depth = [], [], 0
    todo, count = [(0, topology.regions, 1)], 1
    while todo:
        number, nodes, level = todo.pop(0)
        depth, own = max(depth, level), []
        for n in nodes:
            own.append(F.struct(F.lit(n.name).alias("name"), F.lit(float(n.weight)).alias("weight"),
                                F.lit(count).alias("node")))
            if n.children:
                todo.append((count, n.children, level + 1))
            else:
                leaves += [F.lit(count), F.lit(n.shard)]
            count += 1
        lists += [F.lit(number), F.array(*own)]
    return F.create_map(*lists), F.create_map(*leaves), depth


def _winner(key: Column, children: Column) -> Column:
    """The child with the largest ln(u) / weight, u in (0, 1) from 52 bits of the hash of key and child."""
    def draw(c: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), c["name"])), 1, 13), 16, 10).cast("long")
        u = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((F.log(u) / c["weight"]).alias("draw"), (-c["node"]).alias("node"))
    return -F.array_max(F.transform(children, draw))["node"]


def place(df: DataFrame, key: Column, topology: Topology, into: str) -> DataFrame:
    """``df`` with the shard of ``key`` in column ``into``, one level after the other."""
    children, shard_of, depth = _children(topology)
    df = df.withColumn("_node", F.lit(0))
    for _ in range(depth):
        df = df.withColumn("_node", _winner(key, F.element_at(children, F.col("_node"))))
    return df.withColumn(into, F.element_at(shard_of, F.col("_node"))).drop("_node")


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def numbered(df: DataFrame, group: str, bucket: str, order: list[str], into: str) -> DataFrame:
    """``df`` with a gapless number from 0 per ``group``, by bucket and then ``order``.

    The windows hold one bucket each; the offsets are prefix sums over the
    bucket counts, one row per group and bucket (at most 16 ** BUCKET_DIGITS
    buckets times the groups), small enough to be broadcast.
    """
    counts = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(group, bucket).orderBy(*order)
    return df.withColumn("_inside", F.row_number().over(inside)).join(offsets, [group, bucket]) \
        .withColumn(into, (F.col("_from") + F.col("_inside") - 1).cast("long")).drop("_from", "_inside")


def shards(docs: DataFrame, count: int = BASE_SHARDS, id_col: str = "doc_id", text_col: str = "text",
           base: int = BASE_SHARDS) -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the UTF-8 length of the text plus 16 (a null text has no
    bytes and the CRC of the empty text).  A null id is a key of its own.
    Equal ids go to one shard; repeated rows get slots of their own.  The
    text itself is not shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"), _key(id_col).alias("_key"))
    df = df.withColumn("_bucket", F.substring(F.md5("_key"), 1, BUCKET_DIGITS))
    df = place(df, F.col("_key"), regular(count, base), "shard")
    df = place(df, F.col("_key"), regular(count + 1, base), "grown_shard")
    df = numbered(df, "shard", "_bucket", ["_id", "text_crc32", "size"], "slot")
    return df.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                     "grown_shard")


def sharded(docs: DataFrame, count: int = BASE_SHARDS, id_col: str = "doc_id", base: int = BASE_SHARDS,
            order: tuple[str, ...] = (), blocks: int = 0) -> DataFrame:
    """``docs`` with its ``shard`` and ``slot`` (columns of these names are replaced).

    Slots follow the hash of the key, or with ``order`` these columns: the
    first is a number from 0 to below ``blocks``, cut in as many ranges as
    there are hash buckets, and no range is numbered by more than one task.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    df = docs.select(*names).toDF(*[f"_c{i}" for i in range(len(names))])
    key, by = f"_c{names.index(id_col)}", [f"_c{names.index(c)}" for c in order]
    bucket = F.floor(F.col(by[0]) / F.lit(-(-max(blocks, 1) // 16 ** BUCKET_DIGITS))) if by \
        else F.substring(F.md5("_key"), 1, BUCKET_DIGITS)
    df = df.withColumn("_key", _key(key)).withColumn("_bucket", bucket)
    df = place(df, F.col("_key"), regular(count, base), "shard")
    df = df.withColumn("_row", F.xxhash64(*[F.col(f"_c{i}") for i in range(len(names))]))
    df = numbered(df, "shard", "_bucket", [*by, key, "_row"], "slot")
    return df.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], "shard", "slot")
