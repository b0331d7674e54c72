"""Newey-West with half-lives of their own for variances and correlations, against numpy, with and without a fallback."""

from __future__ import annotations

import numpy as np
import pytest

from riskloom import risk


def plain(x, h, lags):
    n = len(x)
    w = 2.0 ** (np.arange(n) / h)
    c0 = (x * w[:, None]).T @ x / w.sum()
    out = c0.copy()
    for k in range(1, lags + 1):
        c = (x[k:] * w[k:, None]).T @ x[:-k] / w[k:].sum()
        out += (1 - k / (lags + 1)) * (c + c.T)
    return c0, out


def test_two_half_lives_and_fallback(spark):
    rng = np.random.default_rng(11)
    a = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3))
    b = a.copy()
    b[:, 1] = np.array([(-1.0) ** i * (3 - 0.04 * i) for i in range(60)])  # turns from row to row
    rows = [(k, i, x[i].tolist()) for k, x in (("a", a), ("b", b)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, rn int, v array<double>").repartition(3)
    got = {(r.k, r.i, r.j): r for r in risk.newey_west_two(df, "k", 8.0, 25.0, 1).collect()}
    assert len(got) == 18
    for k, x in (("a", a), ("b", b)):
        w0, w = plain(x, 8.0, 1)
        c0, c = plain(x, 25.0, 1)
        var = np.where(np.diag(w) > 0, np.diag(w), np.diag(w0))
        fell = (np.diag(w) <= 0) | (np.diag(c) <= 0)
        assert fell.any() == (k == "b")
        for i in range(3):
            for j in range(3):
                m = c if c[i, i] > 0 and c[j, j] > 0 else c0
                r = 1.0 if i == j else m[i, j] / np.sqrt(m[i, i] * m[j, j])
                assert got[k, i, j].value == pytest.approx(r * np.sqrt(var[i] * var[j])) and got[k, i, j].fell_back == bool(fell[i] or fell[j])
