"""Queries over running matrices: expanding and decayed moments, components, condition numbers and forecasts at every row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import running as R
from .base import VECTORS, query, rnd, table, vectors
from .risk import newey_west_two as newey_west_two_half_lives


def weekly(spark, d):
    """By market segment the weekly changes of the mean order price (logarithm) of each priority, weeks with all priorities only."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("key")), "o_custkey")
    wk = o.groupBy("key", F.date_trunc("week", "o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("p")).agg(F.log(F.avg("o_totalprice")).alias("x"))
    priorities = o.select("o_orderpriority").distinct().count()
    full = wk.groupBy("key", "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda c: c["x"]).alias("l")).where(F.size("l") == priorities)
    w = Window.partitionBy("key").orderBy("date")
    c = full.withColumn("_b", F.lag("l").over(w)).where("_b IS NOT NULL").select("key", "date", F.zip_with("l", "_b", lambda a, b: a - b).alias("v"))
    return R.numbered(c, ["key"], ["date"], F.year("date"))


WEEKLY = """wk AS (SELECT c_mktsegment AS key, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_orderpriority AS p, ln(avg(o_totalprice)) AS x FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
 cmp AS (SELECT key, date, list(x ORDER BY p) AS l FROM wk GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT o_orderpriority) FROM orders)),
 lg AS (SELECT key, date, l, lag(l) OVER (PARTITION BY key ORDER BY date) AS b FROM cmp),
 chg AS (SELECT key, date, row_number() OVER (PARTITION BY key ORDER BY date) AS rn, list_transform(list_zip(l, b), lambda z: z[1] - z[2]) AS v FROM lg WHERE b IS NOT NULL),
 cell AS (SELECT key, date, rn, unnest(range(len(v))) AS i, unnest(v) AS x FROM chg)"""


@query("u_running_moments", f"WITH {VECTORS}, d AS (SELECT label, vec_id, rn, list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))) AS q, pow(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE))), 2) AS t, pow(2.0, rn / 84.0) AS g FROM vecs)"
       " SELECT label, vec_id, round(sum(g * q) OVER w / sum(g) OVER w, 5) AS trace, round(sum(g * t) OVER w / sum(g) OVER w, 5) + 0.0 AS total FROM d WINDOW w AS (PARTITION BY label ORDER BY rn)")
def running_moments(spark, d):
    """Trace and sum of all entries of the decayed second moment of all vectors up to each."""

    def f(g: pd.DataFrame, q: R.Sums) -> pd.DataFrame:
        c = R.covariances(q)
        return pd.DataFrame({"label": g["label"], "vec_id": g["vec_id"], "trace": np.trace(c, axis1=1, axis2=2), "total": c.sum(axis=(1, 2))})

    v = R.numbered(vectors(spark, d).drop("rn"), ["label"], ["vec_id"], F.expr("vec_id div 4096"))
    out = R.running(v, ["label"], [("v", "v")], 84.0, f, "label int, vec_id long, trace double, total double")
    return out.select("label", "vec_id", rnd("trace").alias("trace"), rnd("total").alias("total"))


@query("u_expanding_correlation", f"WITH {WEEKLY}, p AS (SELECT a.key, a.date, a.rn, a.i, b.i AS j, corr(a.x, b.x) OVER (PARTITION BY a.key, a.i, b.i ORDER BY a.rn) AS value FROM cell a JOIN cell b ON a.key = b.key AND a.rn = b.rn AND a.i < b.i) SELECT key, date, i, j, round(value, 5) + 0.0 AS value FROM p WHERE rn >= 10")
def expanding_correlation(spark, d):
    """Correlation of each pair over all weeks so far."""

    def f(g: pd.DataFrame, q: R.Sums) -> pd.DataFrame:
        ok = np.flatnonzero(q.n >= 10)
        r, _ = R.correlations(R.covariances(q, demeaned=True)[ok])
        i, j = np.triu_indices(r.shape[1], 1)
        return pd.DataFrame({"key": np.repeat(g["key"].to_numpy()[ok], len(i)), "date": np.repeat(g["date"].to_numpy()[ok], len(i)), "i": np.tile(i, len(ok)), "j": np.tile(j, len(ok)), "value": r[:, i, j].ravel()})

    out = R.running(weekly(spark, d), ["key"], [("v", "v")], None, f, "key string, date date, i long, j long, value double")
    return out.select("key", "date", "i", "j", rnd("value").alias("value"))


def _before(h: float) -> str:
    g, w = f"pow(2.0, rn / {h})", "OVER (PARTITION BY key, i ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    lag = lambda k: f"sum({g} * x * l{k}) {w} / sum(CASE WHEN l{k} IS NOT NULL THEN {g} END) {w}"
    return f"SELECT key, {h} AS half_life, date, rn, i, sum({g} * x * x) {w} / sum({g}) {w} AS c0, {lag(1)} AS c1, {lag(2)} AS c2 FROM l"


@query("u_forecast_sums", f"WITH {WEEKLY}, l AS (SELECT *, lag(x, 1) OVER (PARTITION BY key, i ORDER BY rn) AS l1, lag(x, 2) OVER (PARTITION BY key, i ORDER BY rn) AS l2 FROM cell), s AS ({_before(21.0)} UNION ALL {_before(84.0)}) SELECT key, half_life, date, i, round(c0, 6) AS c0, round(c1, 6) + 0.0 AS c1, round(c2, 6) + 0.0 AS c2 FROM s WHERE rn >= 6")
def forecast_sums(spark, d):
    """Decayed variances and autocovariances of each series from the weeks before each, for two half-lives: the diagonals that the forecasts are made of."""
    w = Window.partitionBy("key").orderBy("rn")
    v = weekly(spark, d).withColumn("l1", F.lag("v", 1).over(w)).withColumn("l2", F.lag("v", 2).over(w)).withColumn("half_life", F.explode(F.array(F.lit(21.0), F.lit(84.0))))

    def f(g: pd.DataFrame, q: R.Sums) -> pd.DataFrame:
        ok = np.flatnonzero(q.n >= 5)
        c = [np.diagonal(R.covariances(q, k)[ok], axis1=1, axis2=2) for k in range(3)]
        n = c[0].shape[1]
        return pd.DataFrame({**{k: np.repeat(g[k].to_numpy()[ok], n) for k in ("key", "half_life", "date")}, "i": np.tile(np.arange(n), len(ok)), **{f"c{k}": c[k].ravel() for k in range(3)}})

    out = R.running(v, ["key", "half_life"], [("v", "v"), ("v", "l1"), ("v", "l2")], "half_life", f, "key string, half_life double, date date, i long, c0 double, c1 double, c2 double", before=True)
    return out.select("key", "half_life", "date", "i", *(rnd(c, 6).alias(c) for c in ("c0", "c1", "c2")))


@query("u_forecast_history")
def forecast_history(spark, d):
    """Standard deviations that the covariance job forecasts for each week from those before it, and the cross-sectional bias."""
    return R.forecast_history(weekly(spark, d), "key", [21, 42, 84, 168], lags=2, min_rows=20)


@query("u_half_life_sweep")
def half_life_sweep(spark, d):
    """By half-life the bias statistic's mean square and the mean QLIKE of all forecasts."""
    h = forecast_history(spark, d).join(weekly(spark, d).select("key", "rn", "v"), ["key", "rn"])
    z = F.zip_with("v", "forecast", lambda a, b: F.pow(F.try_divide(a, b), 2))
    one = h.select("half_life", "bias", F.explode(z).alias("z2")).where("z2 > 0")
    return one.groupBy("half_life").agg(F.sqrt(F.avg("z2")).alias("bias"), F.avg(F.col("z2") - F.log("z2") - 1).alias("qlike"), F.count(F.lit(1)).alias("cells"))


@query("u_condition_numbers")
def condition_numbers(spark, d):
    """Condition number of the decayed correlation of each segment's weeks so far."""
    return R.condition_numbers(weekly(spark, d), "key", 42.0, 12)


@query("u_rate_factors")
def rate_factors(spark, d):
    """Level and slope of the weekly changes, each from the covariance of the weeks so far."""
    return R.rate_factors(weekly(spark, d), "key", 12)


@query("u_principal_components")
def principal_components(spark, d):
    """Components of the expanding correlation with signs that follow the week before."""
    return R.oriented(R.principal_components(weekly(spark, d), "key", 12, 3, edge=True), "key", 3).drop("raw")


@query("u_newey_west_two", f"""WITH {WEEKLY}, x AS (SELECT a.key, h.h, k.k, a.i, b.i AS j, sum(pow(2.0, a.rn / h.h) * a.x * b.x) / sum(pow(2.0, a.rn / h.h)) AS v FROM cell a JOIN (SELECT unnest([0, 1, 2]) AS k) k ON true JOIN (SELECT unnest([42.0, 126.0]) AS h) h ON true JOIN cell b ON b.key = a.key AND b.rn = a.rn - k.k GROUP BY ALL),
 nw AS (SELECT a.key, a.h, a.i, a.j, sum(CASE WHEN a.k = 0 THEN a.v ELSE (1 - a.k / 3.0) * (a.v + b.v) END) AS v, max(CASE WHEN a.k = 0 THEN a.v END) AS plain FROM x a JOIN x b ON b.key = a.key AND b.h = a.h AND b.k = a.k AND b.i = a.j AND b.j = a.i GROUP BY 1, 2, 3, 4),
 va AS (SELECT key, i, CASE WHEN v > 0 THEN v ELSE plain END AS v, v <= 0 AS fell FROM nw WHERE h = 42 AND i = j), d AS (SELECT key, i, v, plain FROM nw WHERE h = 126 AND i = j)
 SELECT m.key, m.i, m.j, round((CASE WHEN m.i = m.j THEN 1.0 WHEN di.v > 0 AND dj.v > 0 THEN m.v / sqrt(di.v * dj.v) ELSE m.plain / sqrt(di.plain * dj.plain) END) * sqrt(vi.v * vj.v), 5) + 0.0 AS value, NOT (di.v > 0 AND dj.v > 0) OR vi.fell OR vj.fell AS fell_back
 FROM nw m JOIN d di ON di.key = m.key AND di.i = m.i JOIN d dj ON dj.key = m.key AND dj.i = m.j JOIN va vi ON vi.key = m.key AND vi.i = m.i JOIN va vj ON vj.key = m.key AND vj.i = m.j WHERE m.h = 126""")
def newey_west_two(spark, d):
    """Covariance of the weekly changes with variances and correlations corrected at half-lives of their own."""
    return newey_west_two_half_lives(weekly(spark, d), "key", 42.0, 126.0, 2).select("key", "i", "j", rnd("value").alias("value"), "fell_back")
