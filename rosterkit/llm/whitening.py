"""Embedding whitening: QDWH spectral divide-and-conquer, then one broadcast matrix.

Entries become whole numbers, x = floor(1024 * c) + 100000, so the counts and
sums of the fit list are exact.  The covariance is made of products of
centred entries: each x less the rounded mean of its dimension (a whole
number, exact) is multiplied and summed by the tasks, and the rest of the mean
(at most a half) is taken off once at the end.  What the driver holds is the
d x d covariance, a statistic whose size depends on the dimensions only
(``MAX_DIMS``), never on the rows.

The components come from spectral divide-and-conquer.  For a shift s the
polar factor U of V - s I (dynamically weighted Halley iterations on QR
factors, at most seven from any condition) gives the projector (U + I) / 2 on
the components above s.  Its range and the complement split V in two
smaller problems, down to single components.  The median of the diagonal is
the first shift, the mean of the eigenvalues the second: the mean lies between
the least and the greatest unless all are equal, and then any basis will do.

Whitening multiplies every row, in Arrow tasks, by one d x k matrix that is
broadcast in the task closure.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
OFFSET = 100000
TOP = 8
#: Most dimensions: the covariance of the driver is at most 128 MB.
MAX_DIMS = 4096

_TINY = np.finfo(np.float64).eps


# --------------------------------------------------------------------------- spectral divide-and-conquer

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based weighted Halley iterations."""
    m = len(a)
    x = a / np.linalg.norm(a)
    low = _TINY / m  # a lower bound of the least singular value that matters in double precision
    for _ in range(12):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * root), 0.0))
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        w, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(m)]))
        after = (q / c) * x + (p - q / c) / np.sqrt(c) * w[:m] @ w[m:].T
        after = (after + after.T) / 2
        step, x = np.linalg.norm(after - x), after
        low = min(low * (p + q * low * low) / (1 + c * low * low), 1.0)
        if step <= np.cbrt(_TINY) * 1e-3 and abs(1 - low) < 1e-8:
            break
    return x


def _pivoted(a: np.ndarray, k: int) -> np.ndarray:
    """An orthonormal basis of the k columns that span most of ``a`` (column pivoting, orthogonalised twice)."""
    rest, basis = a.copy(), np.zeros((len(a), 0))
    for _ in range(k):
        v = rest[:, int(np.argmax((rest * rest).sum(axis=0)))]
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
            v = v / np.linalg.norm(v)
        basis = np.column_stack([basis, v])
        rest = rest - np.outer(v, v @ rest)
    return basis


def _split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, those of the larger eigenvalues first; None if all are equal."""
    m = len(v)
    mean = np.trace(v) / m
    spread = np.linalg.norm(v - mean * np.eye(m))
    if spread <= 4 * m * _TINY * max(abs(mean), np.linalg.norm(v) / m):
        return None
    for shift in (float(np.median(np.diag(v))), mean, mean + 1e-3 * spread / m, mean - 1e-3 * spread / m):
        projector = (polar(v - shift * np.eye(m)) + np.eye(m)) / 2
        k = int(round(float(np.trace(projector))))
        if 0 < k < m:
            upper = _pivoted(projector, k)
            upper, _ = np.linalg.qr(projector @ upper)  # one step of subspace iteration
            whole, _ = np.linalg.qr(upper, mode="complete")
            upper, lower = whole[:, :k], whole[:, k:]
            if np.linalg.norm(lower.T @ v @ upper) <= 1e-12 * np.linalg.norm(v):
                return upper, lower
    raise ValueError("no shift splits the spectrum")


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix."""
    values: list[float] = []
    vectors: list[np.ndarray] = []
    todo = [np.eye(len(v))]
    while todo:
        basis = todo.pop()
        small = basis.T @ v @ basis
        parts = _split((small + small.T) / 2) if basis.shape[1] > 1 else None
        if parts is None:
            for column in basis.T:
                column = column / np.linalg.norm(column)
                vectors.append(column)
                values.append(float(column @ v @ column))
        else:
            todo += [basis @ part for part in parts]
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.column_stack(vectors)[:, order] if vectors else np.zeros((0, 0))


# --------------------------------------------------------------------------- tasks

def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The x-vectors of the rows, all of ``dims`` entries and finite."""
    flat = np.asarray(pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False))
    x = np.floor(SCALE * flat) + OFFSET
    return np.clip(x, -(2.0**62), 2.0**62).astype(np.int64).reshape(-1, dims)


def _sums(batches):
    """Rows -> one row per length of vector: rows and the sums of the dimensions."""
    totals: dict[int, list] = {}
    for batch in batches:
        lengths = pc.list_value_length(batch.column("_v")).to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths).tolist():
            x = _matrix(batch.column("_v").filter(pa.array(lengths == dims)), dims) if dims else np.zeros((0, 0), np.int64)
            old = totals.setdefault(dims, [0, np.zeros(dims, object)])
            old[0] += int((lengths == dims).sum())
            old[1] = old[1] + x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) > 2**40 else old[1] + x.sum(axis=0)
    for dims, (n, s) in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dims], pa.int32()), pa.array([n], pa.int64()), pa.array([[str(v) for v in s]], pa.list_(pa.string()))],
            names=["dims", "n", "sums"])


def _products(dims: int, centre: np.ndarray):
    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            y = (_matrix(batch.column("_v"), dims) - centre).astype(np.float64)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dims, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])
    return run


def _centred(batch: pa.RecordBatch, dims: int, centre: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x less the mean, from the whole part (exact) and the rest of the mean."""
    return (_matrix(batch.column("_v"), dims) - centre).astype(np.float64) - rest


def _white_products(dims: int, centre: np.ndarray, rest: np.ndarray, w: np.ndarray):
    def run(batches):
        k = w.shape[1]
        total, sums, n = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            z = _centred(batch, dims, centre, rest) @ w
            total, sums, n = total + z.T @ z, sums + z.sum(axis=0), n + len(z)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(list(np.column_stack([total, sums])), pa.list_(pa.float64()))],
            names=["i", "row"])
    return run


def _deviation(x: np.ndarray, n: int, centre: np.ndarray, left: list[int]) -> list[int | None]:
    """Exact sum of (n * x - S)**2 by row, None beyond 64 bits; S = n * centre + left."""
    y = x - centre
    widest = max(int(np.abs(y).max(initial=0)) * n + max(map(abs, left), default=0), 1)
    if widest * widest * max(x.shape[1], 1) < 2**63:
        d = y * n - np.array(left, np.int64)
        return (d * d).sum(axis=1).tolist()
    sums = [sum((v * n - s) ** 2 for v, s in zip(row, left, strict=True)) for row in y.tolist()]
    return [s if s < 2**63 else None for s in sums]


def _whiten(dims: int, n: int, centre: np.ndarray, left: list[int], w: np.ndarray, with_row: list[str]):
    def run(batches):
        k = w.shape[1]
        rest = np.array([s / n for s in left])
        for batch in batches:
            x = _matrix(batch.column("_v"), dims)
            z = ((x - centre).astype(np.float64) - rest) @ w
            deviation = pa.array(_deviation(x, n, centre, left), pa.int64())
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in with_row],
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviation.take(at),
                 pa.array(z.reshape(-1))], names=[*with_row, "component", "deviation", "whitened"])
    return run


# --------------------------------------------------------------------------- operator

def _collected(rows: DataFrame, dims: int) -> np.ndarray:
    """Sum of the tasks' matrices: d rows of d numbers, whatever the number of tasks."""
    summed = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = summed.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("r")).select(
        "i", F.col("r.v").alias("r")).orderBy("i").collect()
    return np.array([r["r"] for r in out]).reshape(dims, -1)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """Per row and component: ``id_col``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``.

    Rows whose vector is null, empty or holds a null or a number that is not
    finite are left out.  The fit list has vectors of one length: the
    commonest (of equally common ones the longest), other rows are left out
    too.  Null ids and repeated rows stay, each as a row of its own.  At
    most ``top`` components are given, only those with variance above
    rounding (a table of one vector, or of equal ones, has none and gives no
    row).  Entries beyond 2**52 are cut there; a deviation beyond 64 bits
    is null.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    entries = F.col(vector_col).cast("array<double>")
    usable = vectors.select(F.col(id_col), entries.alias("_v")).where(
        F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists(
            "_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, " \
             "whitened double, explained double, identity_error double"
    counted = usable.select("_v").mapInArrow(_sums, "dims int, n long, sums array<string>")
    lengths = counted.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dims, n = lengths[0]["dims"], lengths[0]["n"]
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MAX_DIMS}")
    per_dim = counted.where(F.col("dims") == dims).select(F.posexplode("sums").alias("j", "s")).groupBy("j").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("j").collect()
    sums = [int(r["s"]) for r in per_dim]
    centre = np.array([round(s / n) for s in sums], np.int64)
    left = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    rest = np.array([s / n for s in left])

    fit = usable.where(F.size("_v") == dims)
    products = _collected(fit.select("_v").mapInArrow(_products(dims, centre), "i int, row array<double>"), dims)
    v = products / n - np.outer(rest, rest)
    values, components = spectrum((v + v.T) / 2)
    trace = float(np.trace(v))
    k = int((values[:top] > 1e-12 * max(trace, 0.0)).sum()) if trace > 0 else 0
    if not k:
        return spark.createDataFrame([], schema)
    w = components[:, :k] / np.sqrt(values[:k])
    white = _collected(fit.select("_v").mapInArrow(_white_products(dims, centre, rest, w), "i int, row array<double>"), k)
    mean = white[:, k] / n
    error = float(np.abs(white[:, :k] / n - np.outer(mean, mean) - np.eye(k)).max())

    rows = fit.select(F.col(id_col).alias("_id"), "_v").mapInArrow(
        _whiten(dims, n, centre, left, w, ["_id"]),
        f"_id {vectors.schema[id_col].dataType.simpleString()}, component int, deviation long, whitened double")
    explained = F.element_at(F.array(*[F.lit(float(e / trace)) for e in values[:k]]), F.col("component"))
    return rows.select(F.col("_id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       explained.alias("explained"), F.lit(error).alias("identity_error"))
