"""Whitening against NumPy on all rows at once."""

import math
import random

import numpy as np
import pytest

from docloom.llm import whitening

KIND = "vec_id long, embedding array<double>, n long, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 9, 9) for i, v in rows], KIND).repartition(5)


def slow(rows):
    """Exact sums in Python's numbers, the covariance of distinct vectors, LAPACK."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in good}
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    away = np.array([[c - s / n for c, s in zip(r, sums, strict=True)] for r in x])
    cov = away.T @ away / n
    return good, n, sums, cov


@pytest.mark.parametrize("dims", [3, 40])
def test_equals_brute_force(spark, dims):
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(k, 1 + k) for k in range(dims)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(None, rows[3][1]), (1, None), (2, [1.0] * (dims - 1) + [None]), (3, [math.nan] * dims), (4, [-math.inf] * dims), (5, [1.0] * (dims + 1)), (6, [])]
    good, n, sums, cov = slow([r for r in rows if r[1] is None or len(r[1]) == dims])
    vectors = table(spark, rows)
    model = whitening.fit(vectors)
    assert (model.n, model.sums) == (n, sums) == (400, sums)
    assert np.allclose(model.values, np.linalg.eigvalsh(cov)[::-1][:16], rtol=1e-10)
    assert np.allclose(np.abs(cov @ model.vectors - model.vectors * model.values), 0, atol=1e-7 * model.values[0])
    found = whitening.whiten(vectors, model).collect()
    k = min(16, dims)
    assert len(found) == len(good) * k and {r.component for r in found} == set(range(1, k + 1))
    by = {(r.vec_id, r.component): r for r in found}
    project = model.vectors / np.sqrt(model.values)
    for i, v in good:
        x = [math.floor(64 * c) + 1_000_000 for c in v]
        away = np.array([c - s / n for c, s in zip(x, sums, strict=True)]) @ project
        for c in range(1, k + 1):
            r = by[i, c]
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, sums, strict=True))
            assert abs(r.whitened - away[c - 1]) < 1e-9
            assert abs(r.explained - model.values[c - 1] / np.trace(cov)) < 1e-9 and r.identity_error <= 1e-4


def test_great_entries_stay_exact(spark):
    rows = [(i, [1e9 * i, float(i % 3)]) for i in range(5)]
    _, n, sums, _ = slow(rows)
    model = whitening.fit(table(spark, rows))
    assert (model.n, model.sums) == (n, sums)
    for r in whitening.whiten(table(spark, rows), model).collect():
        x = [64 * c + 1_000_000 for c in map(int, rows[r.vec_id][1])]
        want = sum((n * a - b) ** 2 for a, b in zip(x, sums, strict=True))
        assert r.deviation == (want if want < 2**63 else None)


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    assert {r.component for r in whitening.whiten(table(spark, rows), whitening.fit(table(spark, rows))).collect()} == {1}
    assert whitening.fit(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])) is None
    assert whitening.whiten(table(spark, []), whitening.fit(table(spark, []))).count() == 0
