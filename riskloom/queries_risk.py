"""Queries over the covariance job and the overfitting test."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import risk as R
from . import solve as S
from .base import RETURNS, VECTORS, query, returns, rnd, vectors

_BLOCKS = f"""{RETURNS}, cal AS (SELECT date, CAST(floor((row_number() OVER (ORDER BY date) - 1) * 8 / count(*) OVER ()) AS INTEGER) AS block FROM (SELECT DISTINCT date FROM rets WHERE r IS NOT NULL)), b AS (SELECT asset, block, count(r) AS n, sum(r) AS s, sum(r * r) AS q FROM rets JOIN cal ON rets.date = cal.date WHERE r IS NOT NULL GROUP BY 1, 2),
k AS (SELECT m AS split FROM (SELECT unnest(range(256)) AS m) WHERE bit_count(m) = 4),
x AS (SELECT split, asset, sum(CASE WHEN (split >> block) & 1 = 1 THEN n END) AS n1, sum(CASE WHEN (split >> block) & 1 = 1 THEN s END) AS s1, sum(CASE WHEN (split >> block) & 1 = 1 THEN q END) AS q1, sum(CASE WHEN (split >> block) & 1 = 0 THEN n END) AS n0, sum(CASE WHEN (split >> block) & 1 = 0 THEN s END) AS s0, sum(CASE WHEN (split >> block) & 1 = 0 THEN q END) AS q0 FROM b, k GROUP BY 1, 2),
y AS (SELECT split, asset, (s1 / n1) / nullif(sqrt(greatest((q1 - s1 * s1 / n1) / (n1 - 1), 0)), 0) AS inside, (s0 / n0) / nullif(sqrt(greatest((q0 - s0 * s0 / n0) / (n0 - 1), 0)), 0) AS outside FROM x WHERE n1 > 1 AND n0 > 1)"""


def _splits(spark, d):
    """Eight blocks of sessions, equal in number of sessions; the calendar has a row a session."""
    r = returns(spark, d).where("r IS NOT NULL")
    cal = r.select("date").distinct()
    cal = cal.withColumn("block", F.floor((F.row_number().over(Window.orderBy("date")) - 1) * 8 / F.count(F.lit(1)).over(Window.partitionBy())).cast("int"))
    r = r.join(cal, "date")
    return R.half_splits(r.select("asset", "block", "r"), "asset")


@query("r_half_splits", f"WITH {_BLOCKS} SELECT split, count(*) AS trials, round(avg(inside), 6) AS inside, round(avg(outside), 6) AS outside, round(regr_slope(outside, inside), 4) AS slope FROM y WHERE inside IS NOT NULL AND outside IS NOT NULL GROUP BY 1")
def half_splits(spark, d):
    y = _splits(spark, d).where("inside IS NOT NULL AND outside IS NOT NULL")
    return y.groupBy("split").agg(F.count(F.lit(1)).alias("trials"), rnd(F.avg("inside"), 6).alias("inside"), rnd(F.avg("outside"), 6).alias("outside"), rnd(F.regr_slope("outside", "inside"), 4).alias("slope"))


@query("r_overfitting", f"WITH {_BLOCKS}, z AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY outside) + (count(*) OVER (PARTITION BY split, outside) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY split) AS c, row_number() OVER (PARTITION BY split ORDER BY inside DESC, asset) AS o FROM y WHERE inside IS NOT NULL AND outside IS NOT NULL) SELECT count(*) AS splits, round(avg(CASE WHEN rk / (c + 1.0) <= 0.5 THEN 1.0 ELSE 0.0 END), 5) AS overfit FROM z WHERE o = 1")
def overfitting(spark, d):
    best = R.overfitting(_splits(spark, d), "asset")
    return best.agg(F.count(F.lit(1)).alias("splits"), rnd(F.avg(F.when(F.col("share") <= 0.5, 1.0).otherwise(0.0))).alias("overfit"))


_D = "pow(2.0, rn / 84.0)"


@query("r_newey_west_matrix", f"""WITH {VECTORS}, c0 AS (SELECT label, i, j, sum({_D} * xi * xj) / sum({_D}) AS v FROM prs GROUP BY 1, 2, 3),
l AS (SELECT a.label, k.k, a.i, b.i AS j, sum(pow(2.0, a.rn / 84.0) * a.x * b.x) / sum(pow(2.0, a.rn / 84.0)) AS v FROM long a JOIN (SELECT unnest([1, 2]) AS k) k ON true JOIN long b ON a.label = b.label AND a.rn = b.rn + k.k GROUP BY 1, 2, 3, 4)
SELECT c0.label, c0.i, c0.j, round(c0.v + (2.0 / 3) * (max(CASE WHEN l.k = 1 AND l.i = c0.i AND l.j = c0.j THEN l.v END) + max(CASE WHEN l.k = 1 AND l.i = c0.j AND l.j = c0.i THEN l.v END)) + (1.0 / 3) * (max(CASE WHEN l.k = 2 AND l.i = c0.i AND l.j = c0.j THEN l.v END) + max(CASE WHEN l.k = 2 AND l.i = c0.j AND l.j = c0.i THEN l.v END)), 5) + 0.0 AS value
FROM c0 JOIN l ON l.label = c0.label AND ((l.i = c0.i AND l.j = c0.j) OR (l.i = c0.j AND l.j = c0.i)) GROUP BY c0.label, c0.i, c0.j, c0.v""")
def newey_west_matrix(spark, d):
    return R.newey_west(vectors(spark, d), "label", 84, 2).where("i <= j").select("label", "i", "j", rnd("value").alias("value"))


@query("r_covariance_job")
def covariance_job(spark, d):
    """Extreme eigenvalues after each stage of the job."""
    stages = R.covariance_job(vectors(spark, d), "label", multiplier=1.1)
    out = None
    for name, m in stages.items():
        part = m.select("label", F.lit(name).alias("stage"), S.spectrum("n", "cells").alias("s")).select("label", "stage", rnd("s.low", 6).alias("low"), rnd("s.high", 6).alias("high"))
        out = part if out is None else out.union(part)
    return out
