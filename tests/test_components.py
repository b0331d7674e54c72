"""Linked residuals and component splits against numpy; broken rows are reported."""

from __future__ import annotations

import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.contracts import ContractError
from riskloom.portfolio import components as C
from riskloom.portfolio import linked as L


def test_forty_assets_equal_numpy_and_only_linked_pairs_exist(spark):
    rng = np.random.default_rng(7)
    n, t = 40, 60
    e = rng.normal(size=(t, n)) + 0.7 * rng.normal(size=(t, 1))
    there = rng.random((t, n)) > 0.2
    groups = [(g, int(a)) for g in range(25) for a in rng.choice(n, rng.integers(1, 5), replace=False)] + [(99, a) for a in range(n)] + [(98, None)]
    rows = [(a, date(2020, 1 + i // 28, 1 + i % 28), float(e[i, a]) if there[i, a] else None) for i in range(t) for a in range(n)]
    df = spark.createDataFrame(rows, "asset int, date date, e double").repartition(4)
    pairs = L.pairs_of(spark.createDataFrame(groups, "g int, asset int"), "g", "asset", 10)
    want = {(x, y) for g in range(25) for x in [a for k, a in groups if k == g] for y in [a for k, a in groups if k == g] if x < y}
    assert {tuple(r) for r in pairs.collect()} == want and 0 < len(want) < n * (n - 1) / 4
    cor = L.pair_correlation(L.decayed(df, "date", 20.0), pairs, "asset", "date", "e", "g")
    w = 2.0 ** (-np.arange(t)[::-1] / 20)
    full = np.eye(n)
    got = {(r.i, r.j): r for r in cor.collect()}
    assert set(got) == want
    for i, j in want:
        both = there[:, i] & there[:, j]
        v = w[both] * e[both, i] @ e[both, j] / np.sqrt((w[both] @ e[both, i] ** 2) * (w[both] @ e[both, j] ** 2))
        assert got[i, j].value == pytest.approx(v) and got[i, j].days == both.sum()
        full[i, j] = full[j, i] = v
    sd = rng.random(n) + 0.5
    books = {p: rng.normal(size=n) * (rng.random(n) > 0.3) for p in ("a", "b")}
    b = spark.createDataFrame([(p, a, float(x[a])) for p, x in books.items() for a in range(n)] + [("empty", 0, 0.0), ("a", 1000, 5.0)], "p string, asset int, w double")
    s = spark.createDataFrame([(a, float(sd[a])) for a in range(n)], "asset int, sd double")
    out = {r.p: r for r in L.linked_variance(b, s, cor, "p", "asset").collect()}
    for p, x in books.items():
        y = x * sd
        assert out[p].diagonal == pytest.approx(y @ y) and out[p].variance == pytest.approx(y @ full @ y) and out[p].linked == pytest.approx(y @ (full - np.eye(n)) @ y)
    assert (out["empty"].diagonal, out["empty"].linked) == (0.0, 0.0)


def test_pairs_of_many_cells_equal_the_join_by_date(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n, t = 60, 45
    there = rng.random((t, n)) > 0.4
    there[:, 0], there[:, 1], there[::2, 2], there[1::2, 3] = True, False, False, False
    e = rng.normal(size=(t, n))
    e[4, 5], e[6, 6], there[4, 5], there[6, 6] = np.inf, np.nan, True, True
    rows = [(a, date(2020, 1, 1 + i) if i < 31 else date(1890, 2, i - 30), float(e[i, a]), 2.0**-i) for i in range(t) for a in range(n) if there[i, a]] + [(None, date(2020, 1, 1), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "asset long, date date, e double, g double").repartition(5)
    given = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3] + [(2, 3), (1, 9), (5, 77)]
    pairs = spark.createDataFrame(given + given[:200] + [(None, 4)], "i long, j long").repartition(3)
    monkeypatch.setattr(L, "BLOCK_ROWS", 300)
    monkeypatch.setattr(L, "_STEP", 100)
    monkeypatch.setattr(L, "_PAIRS", 50)
    monkeypatch.setattr(L, "_OUT", 40)
    rows = L.pair_correlation(df, pairs, "asset", "date", "e", "g").collect()
    got = {(r.i, r.j): r for r in rows}
    assert len(got) == len(rows)  # a repeated pair is one row
    g = 2.0 ** -np.arange(t)
    want = {}
    for i, j in given:
        both = there[:, i] & there[:, j] if j < n else np.zeros(t, bool)
        if both.any():
            x, y, w = e[both, i], e[both, j], g[both]
            with np.errstate(all="ignore"):
                want[i, j] = both.sum(), (w * x * y).sum() / np.sqrt((w * x * x).sum() * (w * y * y).sum())
    assert set(got) == set(want) and (2, 3) not in want
    for k, (days, v) in want.items():
        assert got[k].days == days and got[k].value == pytest.approx(v, rel=1e-9, abs=1e-12, nan_ok=True), k


def test_pairs_and_dates_are_never_joined(spark):
    df = spark.createDataFrame([(1, date(2020, 1, 1), 1.0, 1.0)], "asset int, date date, e double, g double")
    cor = L.pair_correlation(df, spark.createDataFrame([(1, 2)], "i int, j int"), "asset", "date", "e", "g")
    assert "Join" not in cor._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_added_up_before_the_other_sides_weight(spark):
    b = spark.createDataFrame([("a", 1, 0.5)], "p string, asset int, w double")
    sd = spark.createDataFrame([(1, 1.0), (None, 2.0)], "asset int, sd double")
    cor = spark.createDataFrame([(1, 2, 0.1)], "i int, j int, value double")
    out = L.linked_variance(b.unionByName(spark.createDataFrame([("a", None, 3.0)], b.schema)), sd, cor, "p", "asset")
    assert re.search(r"HashAggregate\(keys=\[p#\d+, j#\d+\], functions=\[partial_sum", out._jdf.queryExecution().executedPlan().toString())
    assert [tuple(r) for r in out.collect()] == [("a", 0.25, 0.0, 0.25)]  # no asset, no deviation


@pytest.mark.parametrize("name", ["q_linked_correlation", "q_linked_variance"])
def test_lines_without_keys_count_as_in_the_sql(spark, tmp_path, name):
    import duckdb

    from riskloom import queries

    con, path = duckdb.connect(), f"{tmp_path}/lineitem.parquet"
    no = lambda c, k: f"CASE WHEN hash(rowid, {k}) % 30 = 0 THEN NULL ELSE {c} END AS {c}"
    con.execute("create table raw as select * from read_parquet('/root/testdata/sf0.001/lineitem.parquet') limit 3000")
    con.execute("update raw set l_suppkey = l_suppkey * 10 + l_partkey % 7, l_orderkey = l_orderkey // 3")
    con.execute(f"create table lineitem as select * replace ({no('l_orderkey', 1)}, {no('l_suppkey', 2)}, {no('l_shipdate', 3)}) from raw where hash(rowid, 4) % 9 > 0")
    con.execute(f"copy lineitem to '{path}' (format parquet)")
    want = con.execute(queries.SQL[name]).fetchall()
    got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
    assert len(want) > 5 and len(got) == len(want)
    for x, y in zip(sorted(got), sorted(want), strict=True):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:], abs=2e-4)


def split(spark):
    rng = np.random.default_rng(3)
    months, assets, k, days = [date(2021, m, 1) for m in (1, 2, 3)], 6, 2, 5
    held, exposures, factors, cov, specific, want = [], [], [], [], [], {}
    for m in months:
        w, x, f = rng.normal(size=assets), rng.normal(size=(assets, k)), rng.normal(size=(days, k)) * 0.01
        r = rng.normal(size=(days, assets)) * 0.02
        u = r - f @ x.T
        c = np.cov(rng.normal(size=(20, k)).T) * 1e-4
        own = rng.random(assets) * 1e-4
        when = [date(2021, m.month, 2 + i) for i in range(days)]
        missing = r.copy()
        missing[2, 3] = 0
        held += [(m, when[i], a, float(w[a]), None if (i, a) == (2, 3) else float(r[i, a]), float(u[i, a])) for i in range(days) for a in range(assets)]
        exposures += [(a, m, i, float(x[a, i])) for a in range(assets) for i in range(k)]
        factors += [(when[i], j, float(f[i, j])) for i in range(days) for j in range(k)]
        cov += [(m, i, j, float(c[i, j])) for i in range(k) for j in range(k)]
        specific += [(a, m, float(own[a])) for a in range(assets)]
        b = x.T @ w
        want[m] = ((missing @ w).sum(), (f @ b).sum(), (u @ w).sum(), days * b @ c @ b, days * w**2 @ own)
    frame = spark.createDataFrame
    got = C.component_split(
        frame(held, "month date, date date, asset int, w double, r double, e double").repartition(3), frame(exposures, "asset int, month date, i int, x double"),
        frame(factors, "date date, i int, f double"), frame(cov, "month date, i int, j int, value double"), frame(specific, "asset int, month date, variance double"),
    )
    return got, want


def test_split_equals_numpy(spark):
    got, want = split(spark)
    rows = got.collect()
    assert len(rows) == 3
    for r in rows:
        p, f, u, fv, sv = want[r.month]
        assert (r.days, r.portfolio, r.factor, r.specific, r.regression) == (5, pytest.approx(p), pytest.approx(f), pytest.approx(p - f), pytest.approx(u))
        assert r.factor_variance == pytest.approx(fv) and r.specific_variance == pytest.approx(sv) and r.total_variance == pytest.approx(fv + sv)
    assert C.require_identities(got) is got


def test_a_broken_row_is_reported(spark):
    got, _ = split(spark)
    february = F.col("month") == F.lit(date(2021, 2, 1))
    for column, reason in (("factor", "return"), ("specific_variance", "variance"), ("portfolio", "return")):
        bad = got.withColumn(column, F.when(february, F.col(column) * (1 + 1e-9) + 1e-9).otherwise(F.col(column)))
        assert [(r.month, r.reason) for r in C.broken_identities(bad).collect()] == [(date(2021, 2, 1), reason)]
        with pytest.raises(ContractError, match="2021-02-01"):
            C.require_identities(bad)
    assert {r.reason for r in C.broken_identities(got.withColumn("factor", F.lit(None).cast("double"))).collect()} == {"missing"}


def test_reconcile_marks_and_raises(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(60, 2))
    rows = [(k, float(a), float(3 * b), float(a + 3 * b), 1.0, 1.0, 2.0) for k, (a, b) in enumerate(z)]
    s = spark.createDataFrame(rows, "month int, factor double, specific double, portfolio double, factor_variance double, specific_variance double, total_variance double")
    out = {r.component: r for r in C.reconcile(s).collect()}
    assert out["factor"].bias == pytest.approx(np.sqrt(np.mean(z[:, 0] ** 2))) and out["factor"].periods == 60
    # The square roots of the 2.5 % and 97.5 % points of chi-square with 60 degrees over 60.
    assert out["factor"].low == pytest.approx(np.sqrt(40.482 / 60), abs=2e-3) and out["factor"].high == pytest.approx(np.sqrt(83.298 / 60), abs=2e-3)
    assert out["factor"].inside and not out["specific"].inside
    with pytest.raises(ContractError, match="specific"):
        C.reconcile(s, strict=True)
    assert C.reconcile(s.where("month < 0")).count() == 0
