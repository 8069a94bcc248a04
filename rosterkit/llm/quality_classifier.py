"""Quality classifier: supervised subword embeddings trained by numpy SGD.

A text's features are its words, the 3- and 4-character runs inside them
(borders included) and one marker per word that repeats the word before it,
hashed to 2 ** BITS buckets.  Each bucket has a vector; a text is the mean of
its features' vectors, a softmax over two classes reads it.  Vectors and
output are trained by stochastic gradient descent with per-coordinate steps.

Only a bounded, hash-chosen sample of at most ``max_train`` labelled rows is
fitted (in one task); every text is scored whole.  Since the output is
linear in the mean, scoring needs one weight per bucket: each vector's
difference of the two class products.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subword import Bags, Letters, least_hashed, remainder, scored, spaced, texts, trained
from .textops import mix, range_hash

BITS = 16
DIMENSION = 12
EPOCHS = 8
BATCH = 64
RATE = 0.15
MAX_TRAIN = 4000
GRAMS = (3, 4)
THRESHOLD = 0.7


def features(column):
    """(row, hash) of words, inner character runs and repeat markers; case and marks are kept."""
    x = Letters(column, spaced, lower=False)
    hashed = x.hashed()
    rows, values = [x.row], [range_hash(hashed, x.start, x.end)]
    word = values[0]
    again = np.flatnonzero((word[1:] == word[:-1]) & (x.row[1:] == x.row[:-1])) + 1 if len(word) else np.zeros(0, int)
    rows.append(x.row[again])
    values.append(np.full(len(again), 0x5851F42D4C957F2D, np.uint64))
    gaps = np.r_[0, np.cumsum(x.gap)]
    # a border is one gap character, whichever it is
    points = x.points.astype(np.uint64)
    points[x.gap] = 0x20
    x.points = points
    hashed = x.hashed()
    where = x.row_of(np.arange(len(points)))
    for n in GRAMS:
        at = np.arange(max(0, len(points) - n + 1))
        ok = (gaps[at + n - 1] == gaps[at + 1]) & (where[at] == where[at + n - 1])
        at = at[ok]
        rows.append(where[at])
        values.append(mix(range_hash(hashed, at, at + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(values)


def fit(bags: Bags, seed: int = 7) -> tuple[np.ndarray, float]:
    """Bucket weights and bias; with fewer than two classes every weight is zero."""
    size, n = 1 << BITS, len(bags.label)
    if n == 0 or bags.label.min() == bags.label.max():
        return np.zeros(size, np.float32), 0.0
    rng = np.random.default_rng(seed)
    vector = rng.uniform(-1, 1, (size, DIMENSION)) / DIMENSION
    out, bias = np.zeros((2, DIMENSION)), np.zeros(2)
    seen_vector, seen_out, seen_bias = np.full((size, DIMENSION), 1e-8), np.full((2, DIMENSION), 1e-8), np.full(2, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for first in range(0, n, BATCH):
            rows = order[first:first + BATCH]
            of, bucket, value = bags.batch(rows)
            mean = np.empty((len(rows), DIMENSION))
            for d in range(DIMENSION):
                mean[:, d] = np.bincount(of, value * vector[bucket, d], len(rows))
            z = mean @ out.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), bags.label[rows]] -= 1
            p /= len(rows)
            back = p @ out
            touched, place = np.unique(bucket, return_inverse=True)
            grad = np.empty((len(touched), DIMENSION))
            for d in range(DIMENSION):
                grad[:, d] = np.bincount(place, value * back[of, d], len(touched))
            for g, seen, weight, at in ((grad, seen_vector, vector, touched), (p.T @ mean, seen_out, out, slice(None)),
                                        (p.sum(axis=0), seen_bias, bias, slice(None))):
                seen[at] += g * g
                weight[at] -= RATE * g / np.sqrt(seen[at])
    return (vector @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "quality", modulus: int = 4, held: int = 2, max_train: int = MAX_TRAIN,
           threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, ``held_out``, ``score``, ``predicted``.

    Labels count only from rows whose id's crc32 leaves another remainder
    than ``held``; null labels and ids don't count.  A null or empty text
    scores the bias alone; without labels of both classes every score is
    0.5.  A repeated row is scored as often as it stands; an id with both
    labels counts in both classes; an empty table gives no row.  Long texts
    are scored whole; columns other than id and text are not looked at.
    """
    body = texts(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")) \
        .where("_id is not null and _label in (0, 1)").where(remainder(F.col("_id"), modulus) != held)
    model = trained(least_hashed(known, max_train), body, features, BITS, fit)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = body.mapInArrow(scored(features, BITS, shared), "_id long, score double")
    return out.select(F.col("_id").alias(id_col), (remainder(F.col("_id"), modulus) == held).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
