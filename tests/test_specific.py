"""Specific risk: planted fits, assets outside the fit, both half-lives, shrinkage and regime against numpy."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import specific as S

X3 = ["x1", "x2", "x3"]


def panel(spark, blocks):
    """Rows (month, asset, sd, x1, x2, x3, fit) of several months."""
    rows = [(m, a, None if not np.isfinite(s) else float(s), *map(float, x), bool(f)) for m, (sd, xs, fit) in blocks.items() for a, (s, x, f) in enumerate(zip(sd, xs, fit))]
    return spark.createDataFrame(rows, "month int, asset int, sd double, x1 double, x2 double, x3 double, fit boolean").repartition(3)


def fit(df):
    return {(r.month, r.asset): r for r in S.structural(df, "month", "sd", X3, F.col("fit")).collect()}


def test_planted_relation_and_assets_outside_the_fit(spark):
    rng = np.random.default_rng(1)
    xs = rng.normal(size=(14, 3))
    sd = np.exp(-1.2 + xs @ np.array([0.4, -0.3, 0.6]))
    inside = np.arange(14) < 11
    unknown = np.where(np.arange(14) == 13, np.nan, sd)
    noisy = np.exp(rng.normal(size=14))
    got = fit(panel(spark, {1: (unknown, xs, inside), 2: (noisy, xs, inside), 3: (sd[:4], xs[:4], inside[:4]), 4: (sd, np.ones((14, 3)), inside), 5: (sd * np.nan, xs, inside)}))
    for a in range(14):
        r = got[1, a]
        assert r.structural == pytest.approx(sd[a]) and r.e_zero == pytest.approx(1) and r.r2 == pytest.approx(1) and r.fitted_rows == 11
    design = np.column_stack([np.ones(14), xs])
    beta, *_ = np.linalg.lstsq(design[inside], np.log(noisy[inside]), rcond=None)
    raw = np.exp(design @ beta)
    zero = noisy[inside].mean() / raw[inside].mean()
    assert zero > 1
    assert [got[2, a].structural for a in range(14)] == pytest.approx((zero * raw).tolist()) and got[2, 0].e_zero == pytest.approx(zero)
    # No residual freedom, a rank that is short, nothing to fit: no structural value, and no row is lost.
    assert len(got) == 14 * 4 + 4 and all(got[m, a].structural is None for m in (3, 4, 5) for a in range(4))


def plain_series(e, n, h, hl, lags):
    x = e[:n]
    w = lambda k, half: 2.0 ** (np.arange(n)[k:] / half)
    c0 = (w(0, h) * x * x).sum() / w(0, h).sum()
    total = c0
    for k in range(1, lags + 1):
        if n > k:
            total += 2 * (1 - k / (lags + 1)) * (w(k, hl) * x[k:] * x[:-k]).sum() / w(k, hl).sum()
    return c0, total


def test_time_series_carries_over_months(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for a in range(4):
        e = rng.normal(size=90) if a < 3 else np.array([(-0.93) ** i for i in range(90)])
        days = [date(2020, 1 + i // 15, 1 + i % 15) for i in range(90)]
        rows += [(a, d, date(d.year, d.month, 1), float(x)) for d, x in zip(days, e, strict=True)]
        for m in range(6):
            want[a, date(2020, 1 + m, 1)] = plain_series(e, 15 * (m + 1), 7.0, 20.0, 2)
    df = spark.createDataFrame(rows, "asset int, date date, month date, e double").repartition(4)
    got = S.time_series(df, "asset", "date", "month", "e", 7.0, 20.0, 2).collect()
    assert len(got) == len(want)
    for r in got:
        c0, total = want[r.asset, r.month]
        assert r.plain == pytest.approx(c0) and r.variance == pytest.approx(total if total > 0 else c0) and r.fell_back == (total <= 0)
    assert any(r.fell_back for r in got) and not all(r.fell_back for r in got)


def test_shrinkage_by_bucket(spark):
    rows = [(1, "a", 1.0, True), (1, "a", 3.0, True), (1, "a", 9.0, False), (1, "b", 5.0, True), (1, "c", 2.0, False), (1, None, 4.0, True), (1, None, 6.0, True), (1, "a", None, True)]
    df = spark.createDataFrame(rows, "month int, bucket string, v double, target boolean")
    got = {(r.bucket, r.v): (r.weight, r.shrunk) for r in S.shrunk(df, "month", "bucket", "v", 0.5, F.col("target")).collect()}
    assert got["a", 1.0] == pytest.approx((1 / 1.5, 1 / 1.5 * 1 + 0.5 / 1.5 * 2)) and got["a", 9.0] == pytest.approx((7 / 7.5, 7 / 7.5 * 9 + 0.5 / 7.5 * 2))
    assert got["b", 5.0] == (1.0, 5.0) and got["c", 2.0] == (1.0, 2.0) and got[None, 4.0] == pytest.approx((1 / 1.5, 4 / 1.5 + 2.5 / 1.5)) and got["a", None] == (None, None)


def test_regime_looks_at_months_up_to_its_own(spark):
    b = [None, 1.44, 0.81, None, 4.0]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(b)], "month int, b double").repartition(3)
    got = [r.multiplier for r in S.regime(df, "month", "b", 3.0).orderBy("month").collect()]
    want = []
    for k in range(5):
        known = [(2 ** (j / 3), x) for j, x in enumerate(b[: k + 1]) if x is not None]
        want.append(np.sqrt(sum(w * x for w, x in known) / sum(w for w, _ in known)) if known else 1.0)
    assert got == pytest.approx(want)


def test_later_months_change_nothing_before(spark):
    def risk(scale):
        rows, xs = [], []
        for a in range(8):
            e = rng_.normal(size=80) * (1 + a)
            e[60:] *= scale
            if a == 7:
                e = e[:5]
            rows += [(a, date(2021, 1 + i // 20, 1 + i % 20), date(2021, 1 + i // 20, 1), float(x)) for i, x in enumerate(e)]
            xs += [(a, date(2021, m, 1), a % 2, float(a)) for m in range(1, 5)]
        r = spark.createDataFrame(rows, "asset int, date date, month date, e double")
        x = spark.createDataFrame(xs, "asset int, month date, bucket int, size double")
        return {(r_.asset, r_.month.month): r_ for r_ in S.specific_risk(r, x, "asset", "date", "month", "e", ["size"], "bucket", 20.0, 40.0, 1, 10, 0.1, 2.0).collect()}

    rng_ = np.random.default_rng(9)
    one = risk(1.0)
    rng_ = np.random.default_rng(9)
    two = risk(5.0)
    near = lambda a, b: all(x == pytest.approx(y) for x, y in zip(a, b, strict=True))
    assert len(one) == 32 and all(near(one[k], two[k]) for k in one if k[1] < 4) and any(one[k].multiplier != two[k].multiplier for k in one if k[1] == 4)
    # The asset with five rows has the level that its exposure stands for.
    assert one[7, 1].series is None and one[7, 1].blended == pytest.approx(one[7, 1].structural) and one[7, 1].risk > 0
