"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled set is a hash-chosen
sample of all documents, whose labels are never looked at.  With class prior
pi the risk of a scorer g is

    pi * E_pos[l(g)] + max(0, E_unl[l(-g)] - pi * E_pos[l(-g)])

(l is the logistic loss): the second term estimates the risk on negatives and
is kept from going below zero, as a flexible model would otherwise drive it.
When a batch's estimate is below -``SLACK`` the step goes up that term instead.

g is linear in the counts of a text's hashed features divided by the square
root of their number: its words and their first 4, 5 and 6 letters (inflected
stems share those).  Only buckets that stand in clearly more positive than
unlabelled texts (``SIGMAS`` standard errors; equal positives count once)
have a weight.  Weights are trained by numpy SGD on a bounded sample, in one
task; every text is scored whole.  Posteriors are cautious where positives
are few, so the bias is set last: ``FOLDS`` fits on parts of the sample score
the rest, and the logit with the most recall^2 / share of unlabelled texts
taken is moved to the threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subword import Bags, Letters, least_hashed, not_alnum, remainder, scored, texts, trained
from .textops import mix, range_hash

BITS = 18
STEMS = (4, 5, 6)
EPOCHS = 300
POSITIVES, UNLABELLED = 512, 2000
SLACK = 0.05
RATE = 500.0
BIAS_RATE = 1.0
SIGMAS = 4.0
FOLDS = 4
GAP = 0.5
POWER = 0.5
MAX_POSITIVE = 1500
MAX_UNLABELLED = 6000
THRESHOLD = 0.7


def features(column):
    """(row, hash) of lower-cased words and of the stems of longer words."""
    x = Letters(column, not_alnum, lower=True)
    hashed = x.hashed()
    rows, values = [x.row], [range_hash(hashed, x.start, x.end)]
    for n in STEMS:
        long = x.end - x.start >= n
        rows.append(x.row[long])
        values.append(mix(range_hash(hashed, x.start[long], x.start[long] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(values)


def telling(bags: Bags, size: int) -> np.ndarray:
    """Mask of the buckets whose share of positive texts is SIGMAS errors above the unlabelled share."""
    pos, unl = np.flatnonzero(bags.label == 1), np.flatnonzero(bags.label == 0)
    first = {bags.bucket[bags.at[r]:bags.at[r + 1]].tobytes(): r for r in pos[::-1]}
    pos = np.array(sorted(first.values()))
    in_pos = np.bincount(bags.batch(pos)[1], minlength=size) / len(pos)
    in_unl = (np.bincount(bags.batch(unl)[1], minlength=size) + 1) / (len(unl) + 2)
    return in_pos - in_unl > SIGMAS * np.sqrt(in_unl * (1 - in_unl) / len(pos))


def cut(pos: np.ndarray, unl: np.ndarray) -> float:
    """The logit from which a text counts as positive: the most recall^2 / share of unlabelled texts.

    Both are known without a negative label; the criterion is proportional to
    precision times recall.  ``pos`` and ``unl`` are logits of texts that the
    scorer was not trained on.  The cut is half way to the next logit below,
    at most ``GAP`` below the least positive it takes in.
    """
    at = np.unique(pos)
    recall = 1 - np.searchsorted(np.sort(pos), at) / len(pos)
    taken = len(unl) - np.searchsorted(np.sort(unl), at)
    best = at[int(np.argmax(recall ** 2 / (taken + 1)))]
    both = np.concatenate([pos, unl])
    below = both[both < best]
    return float(best - min(GAP, (best - below.max()) / 2 if len(below) else 0.0))


def fit(bags: Bags, prior: float, threshold: float = THRESHOLD, seed: int = 11) -> tuple[np.ndarray, float]:
    """Bucket weights and bias; the bias puts the threshold where ``FOLDS`` fits on parts of the texts put the cut."""
    pos, unl = np.flatnonzero(bags.label == 1), np.flatnonzero(bags.label == 0)
    weight, bias = descent(bags, prior, seed)
    if len(pos) < FOLDS or len(unl) < FOLDS:
        return weight, bias
    fold = np.zeros(len(bags.label), int)
    fold[pos], fold[unl] = np.arange(len(pos)) % FOLDS, np.arange(len(unl)) % FOLDS
    logit = np.zeros(len(fold))
    for k in range(FOLDS):
        part_weight, part_bias = descent(bags.rows(np.flatnonzero(fold != k)), prior, seed)
        rows = np.flatnonzero(fold == k)
        of, bucket, value = bags.batch(rows)
        logit[rows] = np.bincount(of, value * part_weight[bucket], len(rows)) + part_bias
    return weight, bias - cut(logit[pos], logit[unl]) + float(np.log(threshold / (1 - threshold)))


def descent(bags: Bags, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Bucket weights and bias from positives (label 1) and unlabelled texts (label 0)."""
    size = 1 << BITS
    pos, unl = np.flatnonzero(bags.label == 1), np.flatnonzero(bags.label == 0)
    if not len(pos) or not len(unl):
        return np.zeros(size, np.float32), 0.0
    bags = bags.only(telling(bags, size))
    rng = np.random.default_rng(seed)
    weight, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(unl))
        for first in range(0, len(unl), UNLABELLED):
            u = unl[order[first:first + UNLABELLED]]
            p = pos[rng.integers(0, len(pos), min(POSITIVES, len(pos)))]
            rows = np.r_[p, u]
            is_pos = np.arange(len(rows)) < len(p)
            of, bucket, value = bags.batch(rows)
            g = np.bincount(of, value * weight[bucket], len(rows)) + bias
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            loss = np.logaddexp(0, g)  # l(-g), with slope s; the slope of l(g) is s - 1
            if loss[~is_pos].mean() - prior * loss[is_pos].mean() >= -SLACK:
                d = np.where(is_pos, -prior / len(p), s / len(u))
            else:
                d = np.where(is_pos, prior * s / len(p), -s / len(u))
            weight -= RATE * np.bincount(bucket, value * d[of], size)
            bias -= BIAS_RATE * d.sum()
    return weight.astype(np.float32), float(bias)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", modulus: int = 3, held: int = 1, prior: float | None = None,
           max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
           threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, ``held_out``, ``score``, ``predicted``.

    Labels count only from rows whose id's crc32 leaves another remainder
    than ``held``: the toxic ones are the positives, and the share of toxic
    rows among them is the class prior unless one is given.  Null ids and
    labels don't count; a null or empty text scores the bias alone; without
    positives every score is 0.5; with fewer than ``FOLDS`` the bias stays as
    trained.  A repeated row is scored as often as it stands; an id with both
    labels is a positive.  Long texts are scored whole; columns other than id
    and text are not looked at; an empty table gives no row.
    """
    body = texts(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")) \
        .where("_id is not null and _label in (0, 1)").where(remainder(F.col("_id"), modulus) != held)
    if prior is None:
        prior = known.distinct().agg(F.avg("_label")).first()[0] or 0.0
    prior = min(max(prior, 1e-3), 0.9)
    positives = least_hashed(known.where("_label = 1"), max_positive)
    unlabelled = least_hashed(body.select("_id").where("_id is not null"), max_unlabelled) \
        .select("_id", F.lit(0).alias("_label"))
    model = trained(positives.union(unlabelled), body, features, BITS, lambda bags: fit(bags, prior, threshold), POWER)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = body.mapInArrow(scored(features, BITS, shared, POWER), "_id long, score double")
    return out.select(F.col("_id").alias(id_col), (remainder(F.col("_id"), modulus) == held).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
