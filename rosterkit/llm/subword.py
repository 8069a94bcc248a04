"""Hashed subword features of texts, and the sampling and split shared by the text classifiers."""

from __future__ import annotations

import copy
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import prefix_hashes, row_slices

#: (row of each feature, hash of each feature), in any order within a row
Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


class Letters:
    """The code points of a slice of texts, with row offsets and word borders."""

    def __init__(self, column: pa.Array, separator: Callable[[np.ndarray], np.ndarray], lower: bool):
        column = pc.fill_null(column, "")
        sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        text = "".join(column.to_pylist())
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        if lower:
            big = (self.points >= 65) & (self.points <= 90)
            self.points[big] += 32
        self.offsets = np.r_[0, np.cumsum(sizes)]
        self.rows = len(sizes)
        self.gap = separator(self.points)
        inside = ~self.gap
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        full = sizes > 0
        at = self.offsets[:-1][full]
        begin[at] = inside[at]
        at = self.offsets[1:][full] - 1
        stop[at] = inside[at]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.row = self.row_of(self.start)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets[1:], at, side="right")

    def hashed(self):
        return prefix_hashes((self.points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def spaced(points: np.ndarray) -> np.ndarray:
    return (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))


def not_alnum(points: np.ndarray) -> np.ndarray:
    return ~(((points >= 0x30) & (points <= 0x39)) | ((points >= 0x61) & (points <= 0x7A))
             | ((points >= 0x41) & (points <= 0x5A)) | (points >= 0x80))


def counted(features: Features, bits: int):
    """Arrow function: (_id, text) -> (_id, _label, buckets, counts), buckets distinct per row."""
    def run(batches):
        for whole in batches:
            for batch in row_slices(whole, "_text"):
                row, value = features(batch.column("_text"))
                key = (row.astype(np.uint64) << np.uint64(bits)) | (value >> np.uint64(64 - bits))
                key, n = np.unique(key, return_counts=True)
                of = (key >> np.uint64(bits)).astype(np.int64)
                offsets = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
                bucket = (key & np.uint64((1 << bits) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("_label"), pa.ListArray.from_arrays(offsets, pa.array(bucket)),
                     pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))],
                    names=["_id", "_label", "buckets", "counts"])
    return run


def scored(features: Features, bits: int, model, power: float = 1.0):
    """Arrow function: (_id, text) -> (_id, score) with a broadcast (weights, bias).

    A text's score is the logistic of its features' weights, summed and
    divided by their number to the ``power``, plus the bias; a text without
    features has the bias alone.
    """
    def run(batches):
        weights, bias = model.value
        weights = np.asarray(weights, np.float64)
        for whole in batches:
            for batch in row_slices(whole, "_text"):
                row, value = features(batch.column("_text"))
                total = np.bincount(row, weights[(value >> np.uint64(64 - bits)).astype(np.int64)], batch.num_rows)
                n = np.bincount(row, minlength=batch.num_rows)
                z = np.clip(total / np.maximum(n, 1) ** power + bias, -30, 30)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(1 / (1 + np.exp(-z)))],
                                                 names=["_id", "score"])
    return run


class Bags:
    """Bags of buckets of a bounded training sample in CSR arrays.

    A value is the bucket's count divided by the row's number of features
    to the ``power``; rows are in the order of their ids.
    """

    def __init__(self, batches: list[pa.RecordBatch], power: float = 1.0):
        table = pa.Table.from_batches(batches).combine_chunks() if batches else None
        if table is None or not table.num_rows:
            self.label, self.at, self.bucket, self.value = np.zeros(0, int), np.zeros(1, int), np.zeros(0, np.int32), np.zeros(0)
            return
        order = pc.sort_indices(table, [("_id", "ascending"), ("_label", "ascending")])
        table = table.take(order)
        self.label = table.column("_label").to_numpy().astype(int)
        lists = table.column("buckets").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.r_[0, np.cumsum(sizes)]
        self.bucket = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        counts = pc.list_flatten(table.column("counts").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64)
        sums = np.add.reduceat(np.r_[counts, 0.0], self.at[:-1]) * (sizes > 0)
        self.value = counts / np.repeat(np.maximum(sums, 1) ** power, sizes)

    def only(self, keep: np.ndarray) -> Bags:
        """The same rows with the entries of the kept buckets alone."""
        out, mask = copy.copy(self), keep[self.bucket]
        out.at = np.r_[0, np.cumsum(mask)][self.at]
        out.bucket, out.value = self.bucket[mask], self.value[mask]
        return out

    def rows(self, rows: np.ndarray) -> Bags:
        """Some of the rows."""
        out = copy.copy(self)
        _, out.bucket, out.value = self.batch(rows)
        out.label, out.at = self.label[rows], np.r_[0, np.cumsum(self.at[rows + 1] - self.at[rows])]
        return out

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in the batch, bucket, value) of the entries of some rows."""
        sizes = self.at[rows + 1] - self.at[rows]
        of = np.repeat(np.arange(len(rows)), sizes)
        take = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.at[rows], sizes)
        return of, self.bucket[take], self.value[take]


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def least_hashed(ids: DataFrame, count: int) -> DataFrame:
    """At most ``count`` distinct rows of a narrow id table, those of the least id hashes.

    The share of the hash range that holds them is known from the number of
    ids (an estimate within a few percent, for which the share is wider), so
    each task passes on its part of little more than ``count`` rows, at any
    size of the table, and only those are sorted.
    """
    n = ids.agg(F.approx_count_distinct("_id", 0.02)).first()[0]
    wanted = 1.2 * count + 10 * count ** 0.5 + 100
    if n > wanted:
        ids = ids.where(F.xxhash64("_id") <= int(-2**63 + 2**64 * (wanted / n)))
    return ids.distinct().orderBy(F.xxhash64("_id"), *ids.columns).limit(count)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))


def trained(sample: DataFrame, docs: DataFrame, features: Features, bits: int, fit,
            power: float = 1.0) -> tuple[np.ndarray, float]:
    """Fit ``fit(Bags) -> (weights, bias)`` in one task on the documents of a bounded id sample.

    ``sample`` (_id, _label) is limited by its caller, so the join is a
    broadcast of that many ids and one task holds that many bags.  The bags
    are made by all tasks of the scan and written; the fitting task reads
    them alone..
    """
    bags = Scratch(docs.sparkSession, "bags").keep(docs.join(F.broadcast(sample), "_id").mapInArrow(
        counted(features, bits), "_id long, _label int, buckets array<int>, counts array<int>"), "bags")

    def one(batches):
        weights, bias = fit(Bags(list(batches), power))
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(weights, np.float32).tobytes()], pa.binary()),
                                          pa.array([float(bias)])], names=["weights", "bias"])

    model = bags.coalesce(1).mapInArrow(one, "weights binary, bias double").collect()
    if not model:  # no document at all
        return np.zeros(1 << bits, np.float32), 0.0
    return np.frombuffer(bytes(model[0]["weights"]), np.float32), model[0]["bias"]
