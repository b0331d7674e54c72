"""Regressions, matrices and books against values worked out by hand and against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import book, regress, solve


@pytest.fixture(scope="module")
def day(spark):
    rows = [(1, "a", 0.016, 1.0, 0, 4.0), (1, "b", 0.004, -2.0, 0, 1.0), (1, "c", 0.014, 2.0, 1, 1.0), (1, "d", 0.0055, -1.0, 1, 4.0)]
    return spark.createDataFrame(rows, "date int, asset string, r double, style double, industry int, cap double")


def test_constrained_day(day):
    fitted = regress.constrained_wls(day, "date", "r", "industry", ["style"], "cap")
    x = fitted.first()
    assert x.country == pytest.approx(101.6667e-4, abs=1e-8) and x.style_returns == pytest.approx([34.1667e-4], abs=1e-8)
    assert x.industries == [0, 1] and x.industry_returns == pytest.approx([18.3333e-4, -18.3333e-4], abs=1e-8) and x.eliminated == 0
    assert x.r2 == pytest.approx(0.975152, abs=1e-6) and x.condition == pytest.approx(np.sqrt(2)) and x.names == 4
    assert x.country_t == pytest.approx(12.3238, abs=2e-3) and x.industry_t == pytest.approx([2.2223, -2.2223], abs=2e-3) and x.style_t == pytest.approx([5.8571], abs=2e-3)
    res = {r.asset: r.residual for r in regress.residuals(day, fitted, "date", "r", "industry", ["style"]).collect()}
    assert [res[k] for k in "abcd"] == pytest.approx([5.8333e-4, -11.6667e-4, -11.6667e-4, 5.8333e-4], abs=1e-8)
    for exponent, country in ((1.0, 104.0e-4), (0.0, 98.75e-4)):
        assert regress.constrained_wls(day, "date", "r", "industry", ["style"], "cap", exponent).first().country == pytest.approx(country, abs=1e-9)


def test_constraint_matrix():
    w = np.array([0.11, 0.64, 0.25])
    r = regress.constraint_matrix(w, 1)
    assert np.allclose(r, [[1, 0], [-11 / 64, -25 / 64], [0, 1]]) and np.allclose(w @ r, 0)


def test_rolling_two_and_hac_equal_numpy(spark):
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(2, 60))
    y = 0.3 + 1.5 * u - 0.7 * v + 0.1 * rng.normal(size=60)
    df = spark.createDataFrame([("k", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, u, v, strict=True))], "key string, date int, y double, u double, v double")
    last = regress.rolling_two(df, "key", "date", 40, 10).orderBy(F.desc("date")).first()
    w = np.sqrt(0.5 ** (np.arange(40)[::-1] / 10))
    x = np.column_stack([np.ones(40), u[20:], v[20:]])
    want = np.linalg.lstsq(x * w[:, None], y[20:] * w, rcond=None)[0]
    assert (last.alpha, last.b1, last.b2) == pytest.approx(tuple(want))
    fit = regress.ols_hac(df, "key", "date", "y", "u", 2).first()
    x = np.column_stack([np.ones(60), u])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    score = x * (y - x @ beta)[:, None]
    meat = score.T @ score
    for k in (1, 2):
        part = score[k:].T @ score[:-k]
        meat += (1 - k / 3) * (part + part.T)
    inv = np.linalg.inv(x.T @ x)
    error = np.sqrt(np.diag(inv @ meat @ inv))
    assert (fit.alpha, fit.beta, fit.alpha_error, fit.beta_error) == pytest.approx((*beta, *error))


def test_matrices(spark):
    rng = np.random.default_rng(3)
    a = np.cov(rng.normal(size=(5, 40)))
    c = np.corrcoef(rng.normal(size=(5, 40)))
    df = spark.createDataFrame([(5, a.ravel().tolist(), c.ravel().tolist(), [1.2, 1.1, 1.05, 1.0, 0.95])], "n int, a array<double>, c array<double>, curve array<double>")
    x = df.select(solve.minimum_variance()("n", "a").alias("w"), solve.variance_inflation()("n", "c").alias("vif"), solve.eigen_portfolios()("n", "a").alias("v"), solve.detoned(1)("n", "c").alias("d"), solve.eigen_scaled()("n", "a", "curve").alias("e")).first()
    w = np.linalg.solve(a, np.ones(5))
    assert x.w == pytest.approx(w / w.sum()) and x.vif == pytest.approx(np.diag(np.linalg.inv(c)))
    v = np.array(x.v).reshape(5, 5)
    e = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(v @ a @ v.T, np.diag(e)) and all(abs(r).max() == r.max() for r in v)
    d = np.array(x.d).reshape(5, 5)
    assert np.allclose(np.diag(d), 1) and np.linalg.eigvalsh(d)[0] == pytest.approx(0, abs=1e-9)
    s = np.sqrt(np.diag(a))
    e, v = np.linalg.eigh(a / np.outer(s, s))
    gamma = solve.parabola(np.array([1.2, 1.1, 1.05, 1.0, 0.95]))
    assert np.allclose(np.array(x.e).reshape(5, 5), (v * (e * gamma**2)) @ v.T * np.outer(s, s))
    assert solve.embedded(np.array([0, 2]), 3)(np.eye(2)).tolist() == [[1, 0, 0], [0, 0, 0], [0, 0, 1]]


def test_book_and_quantiles(spark):
    b = spark.createDataFrame([("a", 1, 0.1, 0.01), ("a", 2, -0.05, 0.02)], "k string, d int, r double, c double")
    rows = sorted(book.book(b, "k", "d", "r", "c").collect(), key=lambda r: r.d)
    assert [r.nav for r in rows] == pytest.approx([0.99 * 1.1, 0.99 * 1.1 * 0.98 * 0.95]) and [r.cost for r in rows] == pytest.approx([0.01, 0.99 * 1.1 * 0.02])
    q = spark.createDataFrame([("a", float(x), 1.0, i) for i, x in enumerate([1, 2, 3, 4, 5])], "k string, x double, w double, t int")
    got = book.weighted_quantiles(q, ["k"], "x", "w", {"a": 0.25, "b": 0.6}, "t").first()
    assert (got.a, got.b) == pytest.approx((2.0, 3.4))


def test_lookahead_is_found(spark):
    from pyspark.sql import Window

    from riskloom import contracts

    df = spark.sql("SELECT date_add(DATE '2020-01-01', CAST(id AS INT)) AS date, 1.0D + id AS x FROM range(20)")
    w = Window.orderBy("date")
    honest = lambda d: d.select("date", F.avg("x").over(w.rowsBetween(-3, 0)).alias("s"))
    peeks = lambda d: d.select("date", F.avg("x").over(w.rowsBetween(-3, 1)).alias("s"))
    assert contracts.lookahead(honest, df, "date", "2020-01-10", ["x"]).count() == 0
    assert contracts.lookahead(peeks, df, "date", "2020-01-10", ["x"]).count() == 1
