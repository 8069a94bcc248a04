"""Contains-search by a trigram index (FLT-7, FLT-15).

``postings`` lists, for each lower-cased three-character run of a text, the
rows that hold it.  A term of three characters or more is in a text only if
all its runs are, so the search reads the posting lists of the term's runs,
keeps the rows that are in all of them and checks only those texts.  Shorter
terms have no run and scan.  Stored sorted by run, the lists of a term are a
few row groups of the index, whatever its size.  A posting list is stored in
blocks, one per batch of rows, so what is made, dealt out and sorted is one row
per run and batch, not one per run and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ci

GRAM = 3
BLOCK_BYTES = 1 << 22


def grams_of(term: str) -> list[str]:
    """The distinct runs of a term, lower-cased."""
    low = term.lower()
    return sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})


def _block_maker():
    """(key, lower-cased text) -> (gram, keys): the rows of a batch that hold each run, each row once.

    A function of its own for each job, so that Spark ships it whole.
    """
    def run(batches):
        for whole in batches:
            size = pc.binary_length(whole.column(1).cast(pa.binary())).to_numpy(zero_copy_only=False)
            # so many bytes at once that the sort below stays small; a longer text is taken alone
            part = np.cumsum(size) // BLOCK_BYTES
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(size)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue  # a batch of no rows
                batch = whole.slice(start, end - start)
                texts = [t.decode("utf-8", "replace") for t in batch.column(1).cast(pa.binary()).to_pylist()]
                chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
                row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                at = np.flatnonzero(row[:-(GRAM - 1)] == row[GRAM - 1:])
                grams, row = chars[at] << 42 | chars[at + 1] << 21 | chars[at + 2], row[at]
                if not len(grams):
                    continue
                order = np.lexsort((row, grams))
                grams, row = grams[order], row[order]
                new = np.ones(len(grams), bool)
                new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
                grams, row = grams[new], row[new]
                first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
                value = grams[first]
                codes = np.stack([value >> 42, value >> 21 & (1 << 21) - 1, value & (1 << 21) - 1], axis=1)
                joined = codes.astype("<u4").tobytes().decode("utf-32-le")
                names = [joined[i:i + GRAM] for i in range(0, len(joined), GRAM)]
                offsets = pa.array(np.r_[first, len(grams)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.ListArray.from_arrays(offsets, batch.column(0).take(pa.array(row)))],
                    names=["gram", "keys"])
    return run


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, keys): posting lists in blocks, one per run and batch of rows; NULL and shorter texts have none."""
    low = F.lower(F.col(text))
    kind = df.schema[key].dataType.simpleString()
    return df.where(F.length(low) >= GRAM).select(key, low.alias("_low")).mapInArrow(
        _block_maker(), f"gram string, keys array<{kind}>")


def _rows(found: DataFrame, key: str) -> DataFrame:
    # no block is empty; the outer form adds no filter on the lists to the scan
    return found.select("gram", F.explode_outer("keys").alias(key))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key): each run of each text once per row key; NULL and shorter texts have none."""
    return _rows(blocks(df, key, text), key)


def write_postings(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Write the index sorted by run (range-partitioned, so a frequent run spans files), and read it back as (gram, key).

    The blocks are written as they are made, under ``path`` as well: the
    range partitioning reads its input twice, to sample it and to deal it
    out, and must not make the lists twice.
    """
    spark = df.sparkSession
    made = blocks(df, key, text)
    made.write.parquet(f"{path}/made")
    found = spark.read.schema(made.schema).parquet(f"{path}/made")
    found.repartitionByRange("gram", F.col("keys")[0]).sortWithinPartitions("gram").write.parquet(f"{path}/sorted")
    return _rows(spark.read.schema(made.schema).parquet(f"{path}/sorted"), key)


def candidates(index: DataFrame, key: str, term: str) -> DataFrame:
    """Row keys that hold every run of the term (a superset of the rows that hold the term)."""
    runs = grams_of(term)
    hits = index.where(F.col("gram").isin(runs))  # pushed down to the sorted files
    if len(runs) == 1:
        return hits.select(key)
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(runs)).select(key)


def contains(df: DataFrame, key: str, text: str, term: str, index: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose ``text`` contains the term (case-insensitive, literal), through the index if the term allows.

    ``key`` is unique in ``df``; the index must be of the same rows.
    """
    found = df
    if index is not None and len(term) >= GRAM:
        found = df.join(candidates(index, key, term), key, "left_semi")
    return found.where(contains_ci(text, term))
