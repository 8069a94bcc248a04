"""MinHash near-dedup: fast similarity sketching, banding, exact verification.

A document's set is its distinct five-word shingles.  The sketch has ``BINS``
coordinates and is filled in rounds: in round i < BINS every element is
hashed to one bin with a value in [i, i+1); in round BINS + j every element
goes to bin j; each bin keeps its least value and a document stops after
the first round that leaves no bin empty.  Every coordinate is therefore
filled, equal coordinates have probability J, and the number of equal ones
is as concentrated as with independent functions.

Documents with the same set are one class and are sketched once.  The first
coordinates are cut in bands; classes that share a band are candidates.  A
candidate whose sketches (two bits of every coordinate) are far beyond the
threshold's distance is left out, every other one is confirmed on the full
sets in integers.  No pair list of a bucket is made at once:

1. each bucket member is checked against the bucket's least member;
2. in buckets that still hold several components, against the member that
   has the most links so far;
3. only pairs of one bucket whose components still differ are checked after
   that, each in the first band it shares.  A pair inside one component
   needs no check, so the components are those of checking every candidate
   pair.

A pair at the threshold shares a band with probability 1 - (1 - 0.75**rows)
** bands (with 40 bands of 4 rows all but 2.5 in ten million) and stays
within ``SIGMAS`` standard deviations of its sketch distance (all but about
three in a million).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch
from .textops import SPACED, Words, as_long, gram_hashes, mix, row_slices

WORDS = 5
PERCENT = 75
BANDS = 40
ROWS = 4
BINS = 1024
SIGMAS = 4.5

_SEED = 0x2545F4914F6CDD1D


def _odd(k: int) -> np.uint64:
    return np.uint64(_SEED * k & (1 << 64) - 1)


def _shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, distinct shingle hash), sorted; a shorter text is one shingle."""
    w = Words(column, SPACED, lower=True)
    h, n = w.hashes(), w.counts()
    grams = gram_hashes(h, words)
    whole = w.row[:len(grams)] == w.row[words - 1:] if len(grams) else np.zeros(0, bool)
    rows, values = [w.row[:len(grams)][whole]], [grams[whole]]
    for k in range(1, words):
        short = np.flatnonzero(n == k)
        if len(short):
            rows.append(short)
            at = w.first[short]
            parts = np.zeros(len(short), np.uint64)
            for j in range(k):
                parts = mix(parts * np.uint64(0x9E3779B97F4A7C15) + h[at + j] + np.uint64(k))
            values.append(parts)
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def sketch(row: np.ndarray, value: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """Fast similarity sketch of each row's elements (sorted by row): rows x bins."""
    table = np.full((rows, bins), np.iinfo(np.uint64).max, np.uint64)
    flat = table.reshape(-1)
    for i in range(2 * bins):
        if not len(row):
            break
        h = mix(value ^ _odd(2 * i + 1))
        low = (np.uint64(i) << np.uint64(48)) | (h & np.uint64((1 << 48) - 1))
        if i < bins:
            at = ((h >> np.uint64(48)) * np.uint64(bins)) >> np.uint64(16)
            np.minimum.at(flat, row * bins + at.astype(np.int64), low)
        else:
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            at = row[begin] * bins + (i - bins)
            flat[at] = np.minimum(flat[at], np.minimum.reduceat(low, begin))
        open_rows = (table == np.iinfo(np.uint64).max).any(axis=1)
        if not open_rows.all():
            still = open_rows[row]
            row, value = row[still], value[still]
    return table


def bands_of(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(table), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(table), _odd(b + 1), np.uint64)
        for j in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + table[:, b * rows + j])
        out[:, b] = h
    return out


def bits_of(table: np.ndarray) -> list[pa.Array]:
    """The two lowest bits of each coordinate: 64 low bits to a long column, then 64 high bits."""
    out = []
    for bit in (1, 2):
        packed = np.packbits((table & np.uint64(bit)) != 0, axis=1).view(np.int64)
        out += [pa.array(np.ascontiguousarray(packed[:, k])) for k in range(packed.shape[1])]
    return out


LOW, HIGH = ([f"_{p}{k}" for k in range(BINS // 64)] for p in ("l", "h"))
BITS = [*LOW, *HIGH]


def _features(words: int, bands: int, rows: int):
    def run(batches):
        for whole in batches:
            for batch in row_slices(whole, "_text"):
                n = batch.num_rows
                row, value = _shingles(batch.column("_text"), words)
                size = np.bincount(row, minlength=n)
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(row):
                    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    one[row[begin]] = np.add.reduceat(mix(value), begin)
                    two[row[begin]] = np.add.reduceat(mix(value ^ _odd(1)), begin)
                table = sketch(row, value, n, BINS)
                keys = bands_of(table, bands, rows)[size > 0]
                offsets = np.r_[0, np.cumsum(np.where(size > 0, bands, 0))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(size.astype(np.int64)), as_long(one), as_long(two),
                     pa.ListArray.from_arrays(pa.array(offsets), as_long(keys.reshape(-1))), *bits_of(table)],
                    names=["_id", "n_shingles", "_one", "_two", "_bands", *BITS])
    return run


def _set_rows(words: int):
    def run(batches):
        for whole in batches:
            for batch in row_slices(whole, "_text"):
                row, value = _shingles(batch.column("_text"), words)
                offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.ListArray.from_arrays(pa.array(offsets), as_long(value))],
                    names=["_id", "_set"])
    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share enough; the sets travel by shuffle."""
    left = sets.select(F.col("_id").alias("a"), F.col("_set").alias("_x"))
    right = sets.select(F.col("_id").alias("b"), F.col("_set").alias("_y"))
    both = pairs.join(right, "b").join(left, "a").withColumn(
        "_shared", F.size(F.array_intersect("_x", "_y")))
    return both.where(F.lit(100) * F.col("_shared") >= F.lit(percent) * (
        F.size("_x") + F.size("_y") - F.col("_shared"))).select("a", "b")


def _near(percent: int):
    """Could rows x and y be linked, by set sizes (exact) and sketch distance (``SIGMAS``)?"""
    j = percent / 100
    p = (1 - j) * 3 / 4  # a coordinate that differs differs in the two bits with probability 3/4
    far = BINS * p + SIGMAS * math.sqrt(BINS * p * (1 - p))

    def other(b: str):
        return F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))

    apart = reduce(lambda m, n: m + n, [F.bit_count(other(b).bitwiseOR(other(c))) for b, c in zip(LOW, HIGH, strict=True)])
    x, y = F.col("x.n_shingles"), F.col("y.n_shingles")
    return (F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)) & (apart <= F.lit(int(far)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = WORDS, percent: int = PERCENT, bands: int = BANDS,
                    rows: int = ROWS, scratch: Scratch | None = None) -> DataFrame:
    """Per document: ``id_col``, ``n_shingles``, ``component_id``, ``kept``, ``n_copies``.

    ``component_id`` is the least id reachable over links of at least
    ``percent`` % similarity; ``kept`` marks that document; ``n_copies``
    counts the documents with the same set.  Documents without words (null,
    empty or blank text) have an empty set, link with nothing and are kept.
    Repeated rows of an id each come back with the id's component.  Other
    columns of ``docs`` are not looked at, whatever their names.  A row
    with a null id takes part in no link and comes back with a null
    component, kept.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sketch_type = ", ".join(f"{b} long" for b in BITS)
    features = scratch.keep(texts.mapInArrow(
        _features(words, bands, rows),
        f"_id long, n_shingles long, _one long, _two long, _bands array<long>, {sketch_type}"), "features")

    key = ["n_shingles", "_one", "_two"]
    full = features.where("n_shingles > 0 and _id is not null")
    classes = scratch.keep(full.groupBy(*key).agg(
        F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n_copies")), "classes")
    # one row per class: its least document carries the sketch (repeated rows of it collapse)
    reps = full.join(classes.select("rep"), full["_id"] == F.col("rep"), "left_semi") \
        .dropDuplicates(["_id", *key])
    banded = reps.select("_id", F.explode("_bands").alias("band"))
    hubs = scratch.keep(banded.groupBy("band").agg(
        F.min("_id").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
        .select("band", "hub"), "hubs")
    members = scratch.keep(banded.join(hubs, "band"), "members")
    wanted = members.select("_id").distinct()
    sketches = scratch.keep(reps.drop("_one", "_two").join(wanted, "_id", "left_semi"), "sketches")
    sets = scratch.keep(texts.join(wanted, "_id", "left_semi").mapInArrow(
        _set_rows(words), "_id long, _set array<long>").dropDuplicates(["_id"]), "sets")

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), a < b, that size and sketch leave open."""
        return pairs.join(sketches.alias("x"), F.col("a") == F.col("x._id")) \
            .join(sketches.alias("y"), (F.col("b") == F.col("y._id")) & _near(percent)).select("a", "b")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.keep(_confirm(pairs, sets, percent), name)

    first = members.where("_id <> hub").select(F.col("hub").alias("a"), F.col("_id").alias("b")).distinct()
    links = confirmed(near(first), "links")
    placed = _placed(members.select("band", "_id"), links, scratch, "one")

    # buckets still in several components: against their best linked member
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"))
    ranked = placed.join(degree, F.col("_id") == F.col("node"), "left").select(
        "band", "part", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("_id")).alias("minus"),
                                 F.col("part").alias("part")).alias("rank"))
    best = scratch.keep(_mixed(ranked, F.max("rank").alias("best")).select(
        "band", (-F.col("best.minus")).alias("best"), F.col("best.part").alias("best_part")), "best")
    second = placed.join(best, "band").where("part <> best_part").select(
        F.least("_id", "best").alias("a"), F.greatest("_id", "best").alias("b")).distinct()
    links = links.union(confirmed(near(second), "links-two"))
    placed = _placed(members.select("band", "_id"), links, scratch, "two")

    # what is left: pairs of one bucket in different components
    mixed = scratch.keep(_mixed(placed), "mixed")
    split = scratch.keep(placed.join(mixed, "band").join(sketches, "_id"), "split")
    rest = split.alias("x").join(split.alias("y"), (F.col("x.band") == F.col("y.band"))
                                 & (F.col("x.part") < F.col("y.part")) & _near(percent)
                                 & (F.get(F.array_intersect("x._bands", "y._bands"), F.lit(0)) == F.col("x.band"))).select(
        F.least("x._id", "y._id").alias("a"), F.greatest("x._id", "y._id").alias("b")).distinct()
    links = links.union(confirmed(rest, "links-three"))
    closed = components(links, scratch, "closed")

    found = classes.join(closed, F.col("rep") == F.col("node"), "left").select(
        *key, "n_copies", F.coalesce("component", "rep").alias("component_id"))
    found = scratch.keep(found, "found")
    out = features.select("_id", *key).join(found, key, "left").select(
        F.col("_id").alias(id_col), "n_shingles",
        F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"),
        F.when(F.col("_id").isNotNull(), F.coalesce("n_copies", F.lit(1))).otherwise(F.lit(1)).alias("n_copies"))
    return out.select(id_col, "n_shingles", "component_id",
                      F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)).alias("kept"), "n_copies")


def _placed(members: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(band, _id, part): the bucket members with their component so far."""
    merged = components(links, scratch, name)
    return scratch.keep(members.join(merged, F.col("_id") == F.col("node"), "left").select(
        "band", "_id", F.coalesce("component", "_id").alias("part")), f"placed-{name}")


def _mixed(placed: DataFrame, *more) -> DataFrame:
    """The bands whose members are in several components."""
    found = placed.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), *more)
    return found.where("low < high").drop("low", "high")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each near-duplicate group, all columns: the one with the least id.

    Repeated rows of a kept id are one row; rows with a null id all stay.
    """
    names = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    key = f"_c{names.index(id_col)}"
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(
        F.col(id_col).cast("long").alias("_kept")).where("_kept is not null")
    one = rows.join(kept, F.col(key).cast("long") == F.col("_kept"), "left_semi").dropDuplicates([key])
    return one.unionByName(rows.where(F.col(key).isNull())).toDF(*names)
