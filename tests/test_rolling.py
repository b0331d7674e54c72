"""Rolling regressions, projections, estimators and the normal distribution against numpy and known values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import estimators as E
from riskloom.regress import rolling as G
from riskloom.risk import normal as N


@pytest.mark.parametrize("chunk", [16, 256])
def test_five_factors_equal_numpy(spark, chunk):
    rng = np.random.default_rng(4)
    data = {k: (rng.normal(size=(n, 5)), rng.normal(size=n)) for k, n in (("a", 70), ("b", 33), ("c", 10))}
    rows = [(k, i + 1, float(y[i]), x[i].tolist()) for k, (x, y) in data.items() for i in range(len(y))]
    df = spark.createDataFrame(rows, "k string, rn long, y double, x array<double>").repartition(3)
    W, h, lags = 30, 12.0, 3
    got = {(r.k, r.rn): r for r in G.rolling_regression(df, ["k"], W, h, lags, [2, 5], chunk).collect()}
    assert set(got) == {(k, t) for k, (x, y) in data.items() for t in range(W, len(y) + 1)}
    w = 2.0 ** (-np.arange(W - 1, -1, -1.0) / h)
    for (k, t), r in got.items():
        x, y = data[k][0][t - W : t], data[k][1][t - W : t]
        z = np.column_stack([np.ones(W), x])
        inv = np.linalg.inv((z * w[:, None]).T @ z)
        beta = inv @ (z * w[:, None]).T @ y
        e = y - z @ beta
        s = z * (w * e)[:, None]
        meat = s.T @ s
        for j in range(1, lags + 1):
            c = s[j:].T @ s[:-j]
            meat += (1 - j / (lags + 1)) * (c + c.T)
        error = np.sqrt(np.diag(inv @ meat @ inv))
        m = (w @ y) / w.sum()
        assert [r.alpha, *r.betas] == pytest.approx(beta.tolist()) and [r.alpha_error, *r.beta_errors] == pytest.approx(error.tolist())
        assert r.r2 == pytest.approx(1 - w @ e**2 / (w @ (y - m) ** 2)) and r.nested_r2[1] == pytest.approx(r.r2) and r.nested_r2[0] <= r.r2 + 1e-12


def test_singular_windows_and_panel(spark):
    rows = [("a", i + 1, float(i % 3), [1.0, float(i)]) for i in range(8)] + [("b", i + 1, float(i % 4), [float(i % 5), float(i * i % 7)]) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, rn long, y double, x array<double>")
    fits = G.rolling_regression(df, ["k"], 6, None, None)
    got = {(r.k, r.rn): r for r in fits.collect()}
    assert got["a", 6].betas is None and got["a", 6].r2 is None and got["b", 7].betas is not None and got["b", 7].beta_errors is None
    panel = G.exposure_panel(fits, ["k"], ["u", "v"]).collect()
    assert len(panel) == 6 and {(r.k, r.factor) for r in panel} == {("b", "u"), ("b", "v")}
    assert G.rolling_regression(df.where("rn < 0"), ["k"], 6, None).count() == 0


def test_projection_adds_up_and_is_orthogonal(spark):
    rng = np.random.default_rng(3)
    rows, data = [], {}
    for g, (n, k) in enumerate([(40, 3), (6, 4), (2, 4), (5, 2)]):
        x, a = rng.normal(size=(n, k)), rng.normal(size=n)
        if g == 3:
            a[:] = 0
        data[g] = (x, a)
        rows += [(g, i, float(a[i]), x[i].tolist()) for i in range(n)]
    rows += [(0, 99, None, [1.0, 1.0, 1.0]), (0, 98, 1.0, None), (0, 97, 1.0, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "g int, i int, alpha double, x array<double>").repartition(3)
    got = G.projection(df, "g", "alpha", "x").collect()
    assert len(got) == 53
    for g, (x, a) in data.items():
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.i)
        coef, *_ = np.linalg.lstsq(x, a, rcond=None)
        spanned, rest = np.array([r.spanned for r in mine]), np.array([r.orthogonal for r in mine])
        assert np.allclose(spanned, x @ coef) and np.allclose(spanned + rest, a) and np.allclose(x.T @ rest, 0, atol=1e-9)
        norm = np.linalg.norm(a)
        assert mine[0].cosine == pytest.approx(np.linalg.norm(spanned) / norm if norm else 0.0)


def test_shrinkage_intensities():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 6)) + rng.normal(size=(50, 1)) * np.array([2.0, 2, 2, 0, 0.5, -1])
    t, k = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / t
    r = s / np.sqrt(np.outer(np.diag(s), np.diag(s)))
    mean = (r.sum() - k) / (k * (k - 1))
    # The published estimator entry by entry.
    pi = rho = gamma = 0.0
    for i in range(k):
        for j in range(k):
            p = np.mean((c[:, i] * c[:, j] - s[i, j]) ** 2)
            pi += p
            target = s[i, i] if i == j else mean * math.sqrt(s[i, i] * s[j, j])
            gamma += (target - s[i, j]) ** 2
            if i == j:
                rho += p
            else:
                ti = np.mean((c[:, i] ** 2 - s[i, i]) * (c[:, i] * c[:, j] - s[i, j]))
                tj = np.mean((c[:, j] ** 2 - s[j, j]) * (c[:, i] * c[:, j] - s[i, j]))
                rho += mean / 2 * (math.sqrt(s[j, j] / s[i, i]) * ti + math.sqrt(s[i, i] / s[j, j]) * tj)
    shrunk, delta = E.constant_correlation(x)
    assert delta == pytest.approx(min(max((pi - rho) / gamma / t, 0), 1)) and 0 < delta < 1
    assert np.allclose(np.diag(shrunk), np.diag(s))
    other, share = E.identity_shrinkage(x)
    assert 0 < share < 1 and np.trace(other) == pytest.approx(np.trace(s))
    a, noise = E.denoised(x)
    e = np.linalg.eigvalsh(np.corrcoef(x.T))
    assert noise == pytest.approx((e <= (1 + math.sqrt(k / t)) ** 2).mean()) and np.allclose(np.diag(a), x.var(axis=0, ddof=1))


def test_books_are_held_until_the_next(spark):
    rng = np.random.default_rng(2)
    v = {k: rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4)) for k in ("a", "b")}
    df = spark.createDataFrame([(k, i + 1, x[i].tolist()) for k, x in v.items() for i in range(40)], "k string, rn long, v array<double>").repartition(3)
    books = E.estimates(df, "k", 20, 7)
    assert {(r.k, r.rn) for r in books.collect()} == {(k, t) for k in v for t in (20, 27, 34)}
    held = E.held_returns(df, books, "k").collect()
    assert len(held) == 2 * 5 * 20 and min(r.rn for r in held) == 21
    for r in held:
        if r.estimator == "sample":
            at = 20 + (r.rn - 21) // 7 * 7
            s = np.cov(v[r.k][at - 20 : at].T)
            w = np.linalg.solve(s, np.ones(4))
            w /= w.sum()
            assert r.r == pytest.approx(w @ v[r.k][r.rn - 1]) and r.forecast == pytest.approx(math.sqrt(w @ s @ w))
    out = {(r.k, r.estimator): r for r in E.realised(E.held_returns(df, books, "k"), "k").collect()}
    mine = [r.r for r in held if r.k == "a" and r.estimator == "identity"]
    assert out["a", "identity"].volatility == pytest.approx(np.std(mine, ddof=1) * math.sqrt(252)) and out["a", "identity"].days == 20
    flat = spark.createDataFrame([("a", i + 1, [1.0, 1.0]) for i in range(6)], "k string, rn long, v array<double>")
    assert {r.weights for r in E.estimates(flat, "k", 4, 2, ["sample"]).collect()} == {None}


def test_normal_distribution(spark):
    x = [-40.0, -9.0, -5.0, -1.959963984540054, -0.5, 0.0, 1.0, 1.2815515655446004, 3.0, 7.5, 40.0]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "x double")
    for r in df.select("x", N.cdf(F.col("x")).alias("p")).collect():
        assert r.p is None if r.x is None or r.x != r.x else r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-10, abs=1e-15)
    p = [1e-9, 0.001, 0.02425, 0.1, 0.5, 0.9, 0.975, 1 - 1e-6]
    for r in spark.createDataFrame([(v,) for v in p], "p double").select("p", N.quantile(F.col("p")).alias("x")).collect():
        assert 0.5 * math.erfc(-r.x / math.sqrt(2)) == pytest.approx(r.p, rel=1e-7)
    known = spark.range(1).select(N.quantile(F.lit(0.975)).alias("a"), N.quantile(F.lit(1.0)).alias("b"), N.chi_square_p(F.lit(3.841458820694124), 1).alias("c"), N.chi_square_p(F.lit(5.991464547107979), 2).alias("d"), N.expected_maximum(F.lit(1.0), F.lit(1)).alias("e"), N.expected_maximum(F.lit(4.0), F.lit(1000)).alias("f")).first()
    assert known.a == pytest.approx(1.959963984540054, abs=1e-8) and known.b is None and known.c == pytest.approx(0.05, abs=1e-9) and known.d == pytest.approx(0.05, abs=1e-12) and known.e is None
    # 2 * ((1 - g) * 3.0902323 + g * z(1 - 1 / (1000 e)))
    assert known.f == pytest.approx(2 * ((1 - N.EULER) * 3.090232306 + N.EULER * 3.3754) , abs=2e-3)


def test_breach_tests_without_breaches(spark):
    df = spark.createDataFrame([(50.0, 0.0, 0.0, 0.0), (90.0, 5.0, 5.0, 0.0), (0.0, 0.0, 0.0, 0.0)], "n00 double, n01 double, n10 double, n11 double")
    a, b, c = sorted(N.breach_tests(df, 0.05).collect(), key=lambda r: -r.n00)
    assert b.coverage == pytest.approx(-2 * 50 * math.log(0.95)) and b.independence == 0 and b.independence_p == pytest.approx(1)
    assert a.conditional_p == pytest.approx(math.exp(-a.conditional / 2)) and 0 < a.conditional_p < 1 and c.coverage is None
