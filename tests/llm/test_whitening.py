"""Whitening against numpy's own decomposition and whole-number arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from loomlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, x string"


def vectors(seed=1, n=700, d=24):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, d)) @ np.diag(np.linspace(1.5, 0.2, d)) @ np.linalg.qr(r.standard_normal((d, d)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(i, rows[3][1]) for i in range(1000, 1400)]  # one vector of many rows
    bad = list(rows[0][1])
    rows += [(2000, None), (2001, [None, *bad[1:]]), (2002, [math.nan, *bad[1:]]), (2003, [math.inf, *bad[1:]]), (2004, bad[1:]), (None, bad), (5, rows[7][1])]
    return rows


def test_whitened_rows(spark):
    rows = vectors()
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and None not in v and all(map(math.isfinite, v)) and len(v) == 24]
    fit = [list(x) for x in {tuple(x) for _, x in good}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    v = centre.T @ centre / n
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1][:16], vecs[:, ::-1][:, :16]
    want = {}
    for i, x in good:
        z = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)]) @ vecs / np.sqrt(values)
        want.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), z))
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)
    got = whitening.whiten(docs).collect()
    assert len(got) == 16 * len(good) and {r["n"] for r in got} == {n}
    signs = {}
    for r in got:
        k = r["component"] - 1
        assert any(r["deviation"] == dev and r["deviation_exact"] == str(dev) for dev, _ in want[r["vec_id"]])
        assert any(abs(abs(r["whitened"]) - abs(z[k])) < 1e-9 for _, z in want[r["vec_id"]])
        if len(want[r["vec_id"]]) == 1 and abs(r["whitened"]) > 1e-6:
            signs.setdefault(k, set()).add(np.sign(r["whitened"]) == np.sign(want[r["vec_id"]][0][1][k]))
        assert r["explained"] == pytest.approx(values[k] / np.trace(v), rel=1e-10)
        assert r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 3])
def test_nothing_to_whiten(spark, rows):
    """No rows, no usable rows, no dimensions, one different vector: nothing can be divided by a spread of zero."""
    assert whitening.whiten(spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)).collect() == []


def test_fewer_dimensions_than_components(spark):
    rows = [(i, [float(i % 5), float(i % 7), 1.0]) for i in range(35)]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 70


@pytest.mark.parametrize("values", [np.linspace(5, 0, 64), np.r_[np.full(20, 3.0), np.full(44, 1.0)], 2.0 ** -np.arange(40), np.r_[1e6, np.full(30, 1.0)], np.ones(20), np.r_[2.0, 2.0 + 1e-13, 1.0, np.zeros(9)]])
def test_components(values):
    """Spread, tied, falling, dominated, all equal and nearly tied eigenvalues."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((d, d)))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.components(a)
    want = np.sort(values)[::-1][:16]
    want = want[want > whitening.FLAT * want.max()]
    assert found == pytest.approx(want, rel=1e-9, abs=1e-12 * want.max())
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 1e-12 * want.max()


def test_inertia():
    r = np.random.default_rng(6)
    for _ in range(30):
        a = r.integers(-2, 3, (9, 9)).astype(float)
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in (-3.3, 0.123, 2.7):
            assert whitening.above(a, shift) == (values > shift).sum()


def test_deviations_beyond_a_long():
    x = np.array([[1_000_000, 1_000_007], [2**60, 3]])
    n, sums = 10**9, [10**15, 10**15 + 5]
    assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
