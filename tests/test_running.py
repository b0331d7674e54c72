"""Running matrices against numpy at every row: carries over chunks, decay, signs, no look-ahead."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import risk, running as R, solve


def frame(spark, series):
    rows = [(k, i + 1, [float(z) for z in x]) for k, v in series.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "k string, rn long, v array<double>").repartition(3)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(5, 5))
    return {"a": rng.normal(size=(75, 5)) @ mix * 0.01, "b": rng.normal(size=(40, 5)) @ mix.T + 0.2}


def decayed(x, h):
    w = 2.0 ** (-(np.arange(len(x))[::-1]) / h) if h else np.ones(len(x))
    return (x * w[:, None]).T @ x / w.sum()


def test_numbered(spark):
    df = spark.createDataFrame([("a", i * 7 % 50) for i in range(50)] + [(None, i) for i in range(9)], "k string, at int")
    got = R.numbered(df, ["k"], ["at"], F.expr("at div 6")).collect()
    assert len(got) == 59 and all(r.rn == r["at"] + 1 for r in got)


@pytest.mark.parametrize("chunk", [8, 256])
def test_condition_numbers(spark, series, chunk):
    got = {(r.k, r.rn): r.condition for r in R.condition_numbers(frame(spark, series), "k", 10, 12, chunk).collect()}
    assert set(got) == {(k, i) for k, v in series.items() for i in range(12, len(v) + 1)}
    for (k, i), c in got.items():
        m = decayed(series[k][:i], 10)
        s = np.sqrt(np.diag(m))
        e = np.linalg.eigvalsh(m / np.outer(s, s))
        assert c == pytest.approx(e[-1] / e[0], rel=1e-7)


def test_a_long_sequence_doesnt_overflow(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30_000, 2)) @ np.array([[1.0, 0.6], [0.0, 0.5]])
    df = spark.range(30_000).select(F.lit("a").alias("k"), (F.col("id") + 1).alias("rn")).join(frame(spark, {"a": x}), ["k", "rn"])
    got = {r.rn: r.condition for r in R.condition_numbers(df, "k", 21, 100, 1024).collect()}
    assert len(got) == 29_901
    for i in (100, 1024, 1025, 9_999, 30_000):
        m = decayed(x[max(0, i - 3000) : i], 21)
        r = m[0, 1] / np.sqrt(m[0, 0] * m[1, 1])
        assert got[i] == pytest.approx((1 + abs(r)) / (1 - abs(r)), rel=1e-8)


def test_constant_and_singular_columns(spark):
    df = frame(spark, {"a": [[0.0, 1.0], [0.0, 2.0], [0.0, 3.0]], "b": [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]]})
    assert {r.condition for r in R.condition_numbers(df, "k", 5, 1).collect()} == {None}
    assert R.condition_numbers(df.where("rn < 0"), "k", 5, 1).count() == 0
    assert R.principal_components(df.where("k = 'a'"), "k", 2, 2).count() == 0


def test_rate_factors(spark, series):
    for r in R.rate_factors(frame(spark, series), "k", 20, 2.0, 3.0, chunk=16).collect():
        x = series[r.k][: r.rn]
        e, v = np.linalg.eigh(np.cov(x.T))
        for rank, value, share, loading, target, w in ((-1, r.level, r.level_share, r.level_loading, 2.0, np.full(5, 0.2)), (-2, r.slope, r.slope_share, r.slope_loading, 3.0, np.array([-1.0, 0, 0, 0, 1]))):
            u = v[:, rank]
            scale = target / (w @ u)
            assert np.allclose(loading, u * scale, rtol=1e-5, atol=1e-7) and w @ np.array(loading) == pytest.approx(target)
            assert value == pytest.approx(u @ x[-1] / scale, rel=1e-5, abs=1e-9) and share == pytest.approx(e[rank] / e.sum())


def test_principal_components_keep_their_direction(spark, series):
    parts = R.oriented(R.principal_components(frame(spark, series), "k", 15, 3, edge=True, chunk=8), "k", 3).collect()
    by = {(r.k, r.rn): r for r in parts}
    assert len(by) == (75 - 14) + (40 - 14)
    for k, x in series.items():
        before = None
        for i in range(15, len(x) + 1):
            r = by[k, i]
            c = np.corrcoef(x[:i].T)
            e, v = np.linalg.eigh(c)
            e, v = e[::-1], v[:, ::-1][:, :3]
            if before is None:
                v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(3)])
            else:
                v = v * np.where((before * v).sum(axis=0) < 0, -1, 1)
            assert r.survivors == min(3, int((e > (1 + np.sqrt(5 / i)) ** 2).sum()))
            if r.survivors and before is not None:
                assert r.alignment == pytest.approx(np.abs((before * v).sum(axis=0))[: r.survivors].min(), abs=1e-6)
            assert np.allclose(r.eigenvalues, e) and np.allclose(np.reshape(r.loadings, (3, 5)).T * r.sign, v, atol=1e-5)
            assert np.allclose(r.factors, (x[i - 1] / x[:i].std(axis=0, ddof=1)) @ v, rtol=1e-4, atol=1e-6)
            before = v


def test_no_look_ahead(spark, series):
    changed = {k: v.copy() for k, v in series.items()}
    for v in changed.values():
        v[30:] *= -3
    one, two = ({(r.k, r.rn): r.asDict() for r in R.oriented(R.principal_components(frame(spark, s), "k", 10, 2, chunk=8), "k", 2).collect()} for s in (series, changed))
    assert all(one[k] == two[k] for k in one if k[1] <= 30) and any(one[k] != two[k] for k in one if k[1] > 30)


def test_forecast_history_is_the_job_on_the_rows_before(spark, series):
    df = frame(spark, series)
    got = {(r.k, r.half_life, r.rn): r for r in R.forecast_history(df, "k", [5, 20], 2, 8, chunk=16).collect()}
    assert set(got) == {(k, h, i) for k, v in series.items() for h in (5.0, 20.0) for i in range(9, len(v) + 1)}
    for h in (5, 20):
        for t in (9, 17, 40):
            m = risk.covariance_job(df.where(F.col("rn") < t), "k", h, 2)["volatility_regime"].collect()
            for r in m:
                want = np.sqrt(np.diag(np.reshape(r.cells, (5, 5))))
                x = got[r.k, float(h), t]
                assert x.observations == t - 1 and np.allclose(x.forecast, want, rtol=1e-8)
                assert x.bias == pytest.approx(np.sqrt(np.mean((series[r.k][t - 1] / want) ** 2)))
    # The row itself and later ones change nothing.
    changed = {k: v.copy() for k, v in series.items()}
    for v in changed.values():
        v[19:] = 7.0
    again = {(r.k, r.half_life, r.rn): r.forecast for r in R.forecast_history(frame(spark, changed), "k", [5, 20], 2, 8, chunk=16).collect()}
    assert all(again[k] == got[k].forecast for k in got if k[2] <= 20) and any(again[k] != got[k].forecast for k in got if k[2] == 21)
    assert solve is not None
