"""Whitening: the spectrum against a library routine, exact deviations, odd rows."""

import math

import numpy as np
import pytest

from rosterkit.llm import whitening as wh


@pytest.mark.parametrize("kind", ["random", "equal", "one large", "null space", "close", "zero corner"])
@pytest.mark.parametrize("m", [1, 2, 7, 48])
def test_spectrum(kind, m):
    rng = np.random.default_rng(m)
    q, _ = np.linalg.qr(rng.normal(size=(m, m)))
    values = {"random": rng.random(m) * 100, "equal": np.full(m, 3.0), "one large": np.r_[1e6, np.ones(m - 1)],
              "null space": np.r_[np.zeros(m // 2), np.logspace(-3, 6, m - m // 2)],
              "close": 1 + 1e-9 * np.arange(m), "zero corner": np.r_[5.0, np.zeros(m - 1)]}[kind]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    e, c = wh.spectrum(v)
    size = max(abs(values).max(), 1e-300)
    assert np.abs(np.sort(values)[::-1] - e).max() <= 1e-13 * size
    assert np.abs(c.T @ c - np.eye(m)).max() <= 1e-13
    assert np.abs(v @ c - c * e).max() <= 1e-12 * size


def test_polar_factor_is_orthogonal():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(20, 20))
    a = a + a.T
    u = wh.polar(a)
    assert np.abs(u @ u - np.eye(20)).max() < 1e-13
    assert np.linalg.eigvalsh((u @ a + a @ u) / 2).min() > -1e-12


def brute(rows, top=8):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    y = np.array([[float(a - b / n) for a, b in zip(r, s)] for r in x])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:top], q[:, ::-1][:, :top]
    return deviation, y @ q / np.sqrt(e), e / np.trace(v)


def table(spark, rows, schema="vec_id long, embedding array<float>, component int"):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], schema).repartition(4)


def test_matches_brute_force_and_leaves_odd_rows_out(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=10) * np.arange(1, 11)]) for i in range(300)]
    odd = [(1000, None), (1001, []), (1002, [None] * 10), (1003, [math.nan] * 10), (1004, [math.inf] * 10), (1005, [1.0, 2.0])]
    rows.append((7, rows[7][1]))  # a repeated row
    got = wh.whitened(table(spark, rows + odd)).collect()
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)}
    deviation, white, explained = brute(rows)
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(8):
        mine = np.array([by[i, k + 1].whitened for i, _ in rows])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-9
        assert abs(by[0, k + 1].explained - explained[k]) < 1e-10
    assert [by[i, 1].deviation for i, _ in rows] == deviation
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_small_and_degenerate_tables(spark):
    assert wh.whitened(table(spark, [])).collect() == []
    assert wh.whitened(table(spark, [(1, None)])).collect() == []
    assert wh.whitened(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert wh.whitened(table(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []
    got = wh.whitened(table(spark, [(None, [0.0, 5.0]), (2, [4.0, 5.0])])).collect()
    assert sorted((r.component, abs(round(r.whitened, 9))) for r in got) == [(1, 1.0), (1, 1.0)]
    assert {r.vec_id for r in got} == {None, 2} and {r.explained for r in got} == {1.0}


def test_deviation_beyond_64_bits_is_exact_or_null(spark):
    big = [(i, [2.0**k * (i - 1) for k in (17, 19)]) for i in range(3)]
    got = {r.vec_id: r.deviation for r in wh.whitened(table(spark, big, "vec_id long, embedding array<double>, component int"))
           .where("component = 1").collect()}
    assert got == dict(zip(range(3), brute(big)[0]))
    huge = [(i, [2.0**40 * (i - 1), 0.5 * (i % 2)]) for i in range(3)]
    got = wh.whitened(table(spark, huge, "vec_id long, embedding array<double>, component int")).collect()
    assert {r.vec_id: r.deviation for r in got}[0] is None
