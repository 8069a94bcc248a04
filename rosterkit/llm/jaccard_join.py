"""N-gram Jaccard join: grouped prefix join on word shingles.

A document's set is its distinct three-word shingles.  With all sets in one
global order, two sets whose Jaccard similarity reaches the threshold share a
shingle among the first ``size - ceil(threshold * size) + 1`` of each (the
prefix).  The order is rare shingles first: tasks count the documents of each
shingle in a fixed number of hash buckets (``BUCKETS``), and shingles follow
their bucket's count, then their hash.  Any fixed order gives every pair, so
the counts only make the lists short.

1. Documents with the same set are one class.  Classes with the same prefix
   and size are one group: they have the same candidates.
2. Groups are joined on the shingles of their prefixes.  Group pairs are
   filtered by size and by position: after the first common shingle at places
   i and j no more than the lesser rest of both can be shared.
3. The members of the groups that are left are compared by parity bitmaps (the
   number of different bits is never more than the symmetric difference), and
   the full sets of what remains decide.

Filters leave out only pairs that can't reach the threshold.  A list of very
many groups is not expanded to all its pairs: its groups are joined to the
list's least one, then to the member of the largest component, and only groups
whose members still are in different components are joined to each other.  A
pair inside one component changes nothing, so the components are those of all
pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch
from .textops import SPACED, Words, as_long, gram_hashes, mix, row_slices

WORDS = 3
PERCENT = 90
BUCKETS = 1 << 20
SLICES = 64
BITS = 1024

_SALT = np.uint64(0x2545F4914F6CDD1D)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
LONGS = [f"_b{k}" for k in range(BITS // 64)]
#: the same bitmap of a quarter of the bits, for joins of many rows
FOLDED = LONGS[:len(LONGS) // 4]


# --------------------------------------------------------------------------- sets

def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, by row and hash; a text of fewer words is one shingle."""
    w = Words(column, SPACED, lower=True)
    hashes, count = w.hashes(), w.counts()
    grams = gram_hashes(hashes, words)
    inside = w.row[:len(grams)] == w.row[len(w.row) - len(grams):]
    row, value = w.row[:len(grams)][inside], grams[inside]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        whole = count[short].astype(np.uint64)
        for j in range(words - 1):
            has = count[short] > j
            whole[has] = mix(whole[has] * _FOLD + hashes[w.first[short[has]] + j] + np.uint64(j))
        row, value = np.r_[row, short], np.r_[value, whole]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def bucket_of(value: np.ndarray) -> np.ndarray:
    return (mix(value ^ _SALT) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def _count_rows(words: int):
    """Texts -> (slice, buckets, counts): the documents a bucket has in this task, without empty buckets."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in row_slices(whole, "_text"):
                _, value = shingle_sets(batch.column("_text"), words)
                total += np.bincount(bucket_of(value), minlength=BUCKETS)
        step = BUCKETS // SLICES
        at = [np.flatnonzero(total[k * step:(k + 1) * step]) + k * step for k in range(SLICES)]
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([a.astype(np.int32) for a in at], ints),
             pa.array([total[a] for a in at], longs)], names=["slice", "buckets", "counts"])
    return run


def _added(batches):
    """(slice, buckets, counts) of many tasks -> one row per slice, summed as they come."""
    step, sums = BUCKETS // SLICES, {}
    for batch in batches:
        for k, buckets, counts in zip(*(batch.column(c) for c in ("slice", "buckets", "counts")), strict=True):
            k = k.as_py()
            total = sums.setdefault(k, np.zeros(step, np.int64))
            at = buckets.values.to_numpy(zero_copy_only=False) - k * step
            total[at] += counts.values.to_numpy(zero_copy_only=False)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["slice", "counts"])


def bucket_counts(texts: DataFrame, words: int) -> np.ndarray:
    """Documents of the shingles of each bucket: ``BUCKETS`` numbers, whatever the size of the table."""
    found = texts.select("_text").mapInArrow(_count_rows(words), "slice int, buckets array<int>, counts array<long>") \
        .repartition(SLICES, "slice").mapInArrow(_added, "slice int, counts array<long>").collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in found:
        out[r["slice"] * (BUCKETS // SLICES):(r["slice"] + 1) * (BUCKETS // SLICES)] = r["counts"]
    return out


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size - (percent * size + 99) // 100 + 1


def _features(words: int, percent: int, rank: np.ndarray):
    """Texts -> id, size, 128-bit set hash, prefix in the global order, its hash, parity bitmap."""
    def run(batches):
        for whole in batches:
            for batch in row_slices(whole, "_text"):
                n = batch.num_rows
                row, value = shingle_sets(batch.column("_text"), words)
                size = np.bincount(row, minlength=n)
                begin = np.r_[0, np.cumsum(size)[:-1]]
                full = np.flatnonzero(size)
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(full):
                    one[full] = np.add.reduceat(mix(value), begin[full])
                    two[full] = np.add.reduceat(mix(value ^ _SALT), begin[full])
                bits = np.zeros((n, BITS), np.uint8)
                np.add.at(bits.reshape(-1), row * BITS + (value & np.uint64(BITS - 1)).astype(np.int64), 1)
                packed = np.packbits(bits & 1, axis=1).view(np.int64)
                # sorted by row and hash already: a stable sort by count keeps hashes in order
                order = np.lexsort((rank[bucket_of(value)], row))
                place = np.arange(len(row)) - begin[row]
                first = place < prefix_length(size, percent)[row]
                prefix, owner, place = value[order][first], row[first], place[first]
                offsets = np.searchsorted(owner, np.arange(n + 1))
                same = np.zeros(n, np.uint64)
                if len(full):
                    same[full] = np.add.reduceat(mix(prefix + _FOLD * (place + 1).astype(np.uint64)), offsets[:-1][full])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(size.astype(np.int64)), as_long(one), as_long(two), as_long(same),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), as_long(prefix)),
                     *[pa.array(np.ascontiguousarray(packed[:, k])) for k in range(len(LONGS))]],
                    names=["_id", "size", "_one", "_two", "_same", "_prefix", *LONGS])
    return run


def _set_rows(words: int):
    def run(batches):
        for whole in batches:
            for batch in row_slices(whole, "_text"):
                row, value = shingle_sets(batch.column("_text"), words)
                offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.ListArray.from_arrays(pa.array(offsets), as_long(value))],
                    names=["_id", "_set"])
    return run


# --------------------------------------------------------------------------- filters (all exact)

def _sizes_fit(x: str, y: str, percent: int) -> Column:
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _places_fit(x: str, y: str, percent: int) -> Column:
    """Can sets whose first common shingle is at these places share enough?"""
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    most = F.least(a - F.col(f"{x}.pos"), b - F.col(f"{y}.pos"))
    return F.lit(100 + percent) * most >= F.lit(percent) * (a + b)


def _folded() -> list[Column]:
    """The bitmap by fewer bits of the hash: shingles of several old bits in one new bit, again by parity."""
    return [reduce(lambda m, n: m.bitwiseXOR(n), [F.col(c) for c in LONGS[k::len(FOLDED)]]).alias(b)
            for k, b in enumerate(FOLDED)]


def _bits_fit(x: str, y: str, percent: int, longs: list[str] = LONGS) -> Column:
    """Different bits of the parity bitmaps are at most the different shingles."""
    apart = reduce(lambda m, n: m + n, [F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in longs])
    return F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col(f"{x}.size") + F.col(f"{y}.size"))


# --------------------------------------------------------------------------- the join

class _Join:
    """The tables of one run: classes, groups, the lists of the prefix shingles."""

    def __init__(self, texts: DataFrame, words: int, percent: int, scratch: Scratch):
        self.percent, self.scratch = percent, scratch
        rank = bucket_counts(texts, words)
        kinds = ", ".join(f"{b} long" for b in LONGS)
        self.features = scratch.keep(texts.mapInArrow(
            _features(words, percent, rank),
            f"_id long, size long, _one long, _two long, _same long, _prefix array<long>, {kinds}"), "features")
        full = self.features.where("size > 0 and _id is not null")
        key = ["size", "_one", "_two"]
        # the class keeps its least document; (size, _same) names the group
        self.classes = scratch.keep(full.groupBy(*key, "_same").agg(F.min("_id").alias("rep")), "classes")
        groups = self.classes.groupBy("size", "_same").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("members"))
        self.groups = scratch.keep(groups, "groups")
        lead = full.select("_id", "_prefix").join(
            self.groups.select(F.col("gid").alias("_id"), "size", "_same", "members"), "_id").dropDuplicates(["_id"])
        postings = lead.select(F.col("_id").alias("gid"), "size", F.posexplode("_prefix").alias("pos", "token")) \
            .select("token", "gid", "size", "pos", F.lit(1).alias("n"))
        # a group of several classes is a list of its own, its classes have all places in common
        own = lead.where("members > 1").select(F.xxhash64("size", "_same").alias("token"), F.col("_id").alias("gid"), "size",
                                               F.lit(0).alias("pos"), F.lit(2).alias("n"))
        postings = scratch.keep(postings.unionByName(own), "postings")
        # most shingles are in one list entry only: counted first, in rows of two numbers
        shared = scratch.keep(postings.groupBy("token").agg(F.sum("n").alias("n")).where("n > 1").drop("n"), "shared")
        self.lists = scratch.keep(postings.drop("n").join(shared, "token"), "lists")
        self.hubs = scratch.keep(self.lists.groupBy("token").agg(F.min(F.struct("gid", "size", "pos")).alias("hub")), "hubs")
        self.member = self.classes.join(self.groups.select("size", "_same", "gid"), ["size", "_same"]).select("gid", "rep")
        wanted = self.lists.select("gid").distinct()
        self.member = scratch.keep(self.member.join(wanted, "gid", "left_semi"), "member")
        reps = self.member.select(F.col("rep").alias("_id"))
        self.bitmaps = scratch.keep(full.select("_id", "size", *LONGS).join(reps, "_id", "left_semi")
                                    .dropDuplicates(["_id"]), "bitmaps")
        self.texts, self.words = texts, words

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that pass the bitmaps, then the full sets."""
        left = pairs.join(self.bitmaps.alias("x"), F.col("a") == F.col("x._id")).join(
            self.bitmaps.alias("y"), (F.col("b") == F.col("y._id")) & _sizes_fit("x", "y", self.percent)
            & _bits_fit("x", "y", self.percent)).select("a", "b")
        left = self.scratch.keep(left.distinct(), f"{name}-left")
        ends = left.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
        sets = self.scratch.keep(self.texts.join(ends, "_id", "left_semi").mapInArrow(
            _set_rows(self.words), "_id long, _set array<long>").dropDuplicates(["_id"]), f"{name}-sets")
        both = left.join(sets.select(F.col("_id").alias("a"), F.col("_set").alias("_x")), "a").join(
            sets.select(F.col("_id").alias("b"), F.col("_set").alias("_y")), "b").withColumn(
            "_both", F.size(F.array_intersect("_x", "_y")))
        return self.scratch.keep(both.where(
            F.lit(100 + self.percent) * F.col("_both") >= F.lit(self.percent) * (F.size("_x") + F.size("_y"))).select(
            "a", "b"), name)

    def parts(self, links: DataFrame, name: str) -> DataFrame:
        """(gid, part, lead, members): each group by the parts of components its members are known to be in.

        A part is named by a document its members reach in at most four
        links: pairs inside one part need no check.  Whole components are
        only made once, at the end.
        """
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(
            links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        near = self.scratch.keep(both.groupBy("node").agg(F.least(F.min("node"), F.min("to")).alias("part")), f"{name}-near")

        def moved_on(by: DataFrame) -> DataFrame:
            nxt = by.select(F.col("node").alias("part"), F.col("part").alias("further"))
            return by.join(nxt, "part", "left").select("node", F.coalesce("further", "part").alias("part"))

        closed = moved_on(self.scratch.keep(moved_on(near), f"{name}-moved"))
        self.placed = self.scratch.keep(self.member.join(closed, F.col("rep") == F.col("node"), "left").select(
            "gid", "rep", F.coalesce("part", "rep").alias("part")), f"{name}-placed")
        return self.scratch.keep(self.placed.groupBy("gid", "part").agg(
            F.min("rep").alias("lead"), F.count(F.lit(1)).alias("members")), f"{name}-parts")

    def mixed(self, parts: DataFrame, name: str, *more: Column) -> tuple[DataFrame, DataFrame]:
        """The entries of lists whose members are in several components, and one row per such list."""
        entries = self.lists.join(parts, "gid")
        several = self.scratch.keep(entries.groupBy("token").agg(
            F.min("part").alias("_low"), F.max("part").alias("_high"), *more).where("_low < _high").drop("_low", "_high"),
            f"{name}-mixed")
        return entries, several


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
           scratch: Scratch | None = None) -> DataFrame:
    """Per document: ``id_col``, ``n_shingles``, ``component_id``.

    ``component_id`` is the least id reachable over links of at least
    ``percent`` % Jaccard similarity.  Null, empty and blank texts have an
    empty set and link with nothing; a text of fewer words than a shingle is
    one shingle.  Repeated rows of an id each come back with the id's
    component; a null id takes part in no link and has a null component.
    Very long texts are whole sets; an empty table gives no row; other
    columns are not looked at, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard-join")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    j = _Join(texts, words, percent, scratch)

    # every group with the list's least group, and its own classes with their least
    hubs = j.lists.join(j.hubs, "token").select(F.struct("gid", "size", "pos").alias("x"), F.col("hub").alias("y")).where("x.gid <> y.gid") \
        .where(_sizes_fit("x", "y", percent) & _places_fit("x", "y", percent)).select(
            F.col("y.gid").alias("a"), F.col("x.gid").alias("b"))
    inside = j.member.where("gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    links = j.verified(hubs.union(inside).distinct(), "links-one")

    # lists still in several components: every other part with the largest one
    parts = j.parts(links, "one")
    entries, several = j.mixed(parts, "one", F.max(F.struct("members", "part", "lead", "size", "pos")).alias("y"))
    far = entries.join(several, "token").select(F.struct("lead", "part", "size", "pos").alias("x"), "y") \
        .where("x.part <> y.part").where(_sizes_fit("x", "y", percent) & _places_fit("x", "y", percent)).select(
            F.least("x.lead", "y.lead").alias("a"), F.greatest("x.lead", "y.lead").alias("b"))
    links = links.union(j.verified(far.distinct(), "links-two"))

    # what is left: groups of one list with members in different components
    parts = j.parts(links, "two")
    entries, several = j.mixed(parts, "two")
    rest = entries.join(several, "token").join(j.bitmaps.select(F.col("_id").alias("lead"), *_folded()), "lead")
    rest = scratch.keep(rest, "rest")
    alone = (F.col("x.members") == 1) & (F.col("y.members") == 1)
    pairs = rest.alias("x").join(rest.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.part") < F.col("y.part"))
                                 & _sizes_fit("x", "y", percent) & _places_fit("x", "y", percent)
                                 & (~alone | _bits_fit("x", "y", percent, FOLDED))).select(
        F.col("x.gid").alias("gx"), F.col("x.part").alias("px"), F.col("y.gid").alias("gy"), F.col("y.part").alias("py"))
    pairs = scratch.keep(pairs.distinct(), "group-pairs")
    expanded = pairs.join(j.placed.select(F.col("gid").alias("gx"), F.col("part").alias("px"), F.col("rep").alias("a")),
                          ["gx", "px"]).join(
        j.placed.select(F.col("gid").alias("gy"), F.col("part").alias("py"), F.col("rep").alias("b")), ["gy", "py"])
    links = links.union(j.verified(expanded.select("a", "b"), "links-three"))

    closed = components(links, scratch, "closed")
    key = ["size", "_one", "_two"]
    found = scratch.keep(j.classes.join(closed, F.col("rep") == F.col("node"), "left").select(
        *key, F.coalesce("component", "rep").alias("component_id")), "found")
    return j.features.select("_id", *key).join(found, key, "left").select(
        F.col("_id").alias(id_col), F.col("size").alias("n_shingles"),
        F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"))
