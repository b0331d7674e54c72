"""Hand values and the DuckDB oracle for the core operators."""

from __future__ import annotations

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import contracts, moments, panel, portfolio, queries, solve, windows, xsection

SF = "/root/testdata/sf0.001"


def test_asof_takes_the_latest_fact(spark):
    facts = spark.createDataFrame([("a", date(2020, 1, 5), 1.0), ("a", date(2020, 1, 9), 2.0), ("a", date(2020, 1, 9), 3.0)], "k string, date date, v double")
    probes = spark.createDataFrame([("a", date(2020, 1, 4)), ("a", date(2020, 1, 5)), ("a", date(2020, 2, 1)), ("b", date(2020, 2, 1))], "k string, date date")
    got = {(r.k, r.date.day): r.out for r in panel.asof(probes, facts, "k", "date", "v", "out").collect()}
    assert got == {("a", 4): None, ("a", 5): 1.0, ("a", 1): 3.0, ("b", 1): None}
    head = {(r.k, r.date.day): (r.out, r.approximated) for r in panel.asof_with_head(probes, facts, "k", "date", "v", "out").collect()}
    assert head["a", 4] == (1.0, True) and head["a", 5] == (1.0, False) and head["b", 1] == (None, False)


def test_spells_are_half_open(spark):
    s = spark.createDataFrame([("a", date(2020, 1, 30), date(2020, 2, 2)), ("b", None, None), ("c", date(2020, 3, 1), None)], "asset string, start date, end date")
    days = panel.spells_to_days(s, "2020-01-31", "2020-02-03").groupBy("asset").count().collect()
    assert {r.asset: r["count"] for r in days} == {"a": 2, "b": 3}


def test_state_counts_equal_counts_of_days(spark):
    rng = np.random.default_rng(4)
    day = lambda: date(2020, 1 + int(rng.integers(4)), 1 + int(rng.integers(28)))
    spells = [(a, *((x, y) if rng.random() < 0.8 else (x, None) if rng.random() < 0.5 else (None, y))) for a in range(40) for x, y in [sorted((day(), day()))]] + [(3, day(), None), (None, None, None), (90, date(2021, 1, 1), None)]
    bars = [(int(rng.integers(45)), day()) for _ in range(900)] + [(None, day()), (5, None)]
    s = spark.createDataFrame(spells, "asset int, start date, end date").repartition(3)
    b = spark.createDataFrame(bars, "asset int, date date").repartition(3)
    want = panel.membership_state(panel.spells_to_days(s, "2020-01-10", "2020-04-20").select("asset", "date"), b, ["asset", "date"]).groupBy("date", "state").agg(F.count(F.lit(1)).alias("n"))
    got = panel.state_counts(s, b, ["asset"], "2020-01-10", "2020-04-20")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema["n"].dataType == want.schema["n"].dataType
    empty = panel.state_counts(s.limit(0), b, ["asset"], "2020-01-10", "2020-04-20")
    assert empty.collect() == []


def test_days_of_spells_are_not_joined(spark):
    plan = queries.QUERIES["p_membership_states"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate" in line and "sequence" in line and "asset" in line]


def test_code_ranges(spark):
    r = spark.createDataFrame([("x", 1, 5), ("y", 7, 9)], "label string, low int, high int")
    got = panel.code_group(spark.createDataFrame([(1,), (6,), (9,), (None,)], "code int"), r, "code", "none").collect()
    assert {g.code: g.label for g in got} == {1: "x", 6: "none", 9: "y", None: None}


def test_runs(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, False, True])], "k string, i int, flag boolean")
    assert sorted((r["first"], r["last"], r["length"]) for r in panel.runs(df, ["k"], "i", "flag").collect()) == [(0, 1, 2), (3, 3, 1)]


def test_decay_window_halves_every_h_rows(spark):
    df = windows.numbered(spark.createDataFrame([("a", i, float(x)) for i, x in enumerate([4, 2, 8])], "k string, d int, x double"), "k", "d")
    got = df.select(windows.decay_mean(F.col("x"), 1, windows.trailing("k", 2, "d")).alias("m")).collect()
    assert [r.m for r in got] == pytest.approx([4.0, (4 * 0.5 + 2) / 1.5, (2 * 0.5 + 8) / 1.5])


def test_cross_section(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 3.0, 1.0), (1, 100.0, None), (2, 5.0, 2.0)], "date int, x double, cap double")
    z = {r.x: r.z for r in df.withColumn("z", xsection.standardise(F.col("x"), F.col("cap"))).collect()}
    assert z[1.0] == pytest.approx(-1 / math.sqrt(2)) and z[100.0] is None and z[5.0] is None
    w = df.where("date = 2").select(xsection.winsorise(F.col("x"), 1.0).alias("w")).first()
    assert w.w == 5.0


def test_newey_west_falls_back(spark):
    df = spark.createDataFrame([("a", i, float((-1) ** i)) for i in range(6)], "k string, d int, x double")
    r = moments.newey_west_variance(df, "k", "d", "x", 1e9, 1).first()
    assert r.plain == pytest.approx(1) and not r.fell_back or r.variance == r.plain


def test_psd_repair_and_spectrum(spark):
    a = np.array([[1.0, 2.0], [2.0, 1.0]])
    df = spark.createDataFrame([(1, i, j, float(a[i, j])) for i in range(2) for j in range(2)], "k int, i int, j int, value double")
    m = solve.matrix_rows(df, "k").withColumn("s", solve.spectrum("n", "cells")).withColumn("f", solve.floored()("n", "cells")).first()
    assert m.s.low == pytest.approx(-1) and not m.s.positive and np.allclose(np.reshape(m.f, (2, 2)), 1.5)


def test_brinson_adds_up(spark):
    df = spark.createDataFrame([(1, "a", 0.6, 0.5, 0.1, 0.05), (1, "b", 0.4, 0.5, 0.02, 0.03)], "date int, sleeve string, wp double, wb double, rp double, rb double")
    r = portfolio.brinson(df, "date").agg(F.sum(F.col("allocation") + F.col("selection") + F.col("interaction")).alias("x"), F.sum(F.col("wp") * F.col("rp") - F.col("wb") * F.col("rb")).alias("y")).first()
    assert r.x == pytest.approx(r.y)


def test_contracts(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0)], "k int, v double")
    assert contracts.duplicates(df, ["k"]).count() == 1 and contracts.rejected(df, F.col("v") > 0).count() == 1
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["z"])
    with pytest.raises(contracts.ContractError):
        contracts.refuse(df, "rows")


@pytest.mark.parametrize("name", ["flagship_exposures", "p_asof_orders", "p_membership_states", "m_newey_west", "f_brinson", "x_orthogonalise"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part", "supplier"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.nansum(got[c].astype(float)) == pytest.approx(np.nansum(want[c].astype(float)), rel=1e-6, abs=1e-3)


def test_driver_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "flagship_exposures" in entry.queries()
