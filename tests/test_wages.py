"""Sums of products of sparse designs."""

import numpy as np
import pytest

from rankloom.operators import wages


@pytest.mark.parametrize("n", [0, 5_000])
def test_products_are_added_up_in_tasks(spark, n):
    rng = np.random.default_rng(3)
    k = 9
    j = np.column_stack([np.zeros(n, int), rng.integers(1, 4, n), rng.integers(4, 8, n), np.full(n, 8)])
    v = np.column_stack([np.ones(n), np.ones(n), rng.random(n) < 0.5, rng.normal(size=n)])
    j[v == 0] = 0
    y, w, beta = rng.normal(size=n), rng.random(n) + 0.1, rng.normal(size=k)
    rows = [(float(a), float(b), c.tolist(), d.astype(float).tolist()) for a, b, c, d in zip(y, w, j, v)]
    sparse = spark.createDataFrame(rows, "y double, w double, j array<int>, v array<double>").repartition(3)
    x = np.zeros((n, k + 1))
    for a in range(4):
        x[np.arange(n), j[:, a]] += v[:, a]
    x[:, k] = y
    assert np.allclose(wages._products(sparse, k), (x * w[:, None]).T @ x)
    e = w * (y - x[:, :k] @ beta)
    assert np.allclose(wages._products(sparse, k, beta)[:k, :k], (x[:, :k] * (e * e)[:, None]).T @ x[:, :k])
