"""Queries over costs, attribution, book accounting and return statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import moments as M
from . import portfolio as P
from .base import BARS, RETURNS, VECTORS, bars, corr, query, returns, rnd, table, vectors

_MONTHLY = f"{RETURNS}, mon AS (SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, exp(sum(r)) - 1 AS r, count(r) AS n FROM rets WHERE r IS NOT NULL GROUP BY 1, 2)"


def _monthly(spark, d):
    return returns(spark, d).where("r IS NOT NULL").groupBy("asset", F.trunc("date", "MM").alias("month")).agg(F.expm1(F.sum("r")).alias("r"), F.count("r").alias("n"))


@query("f_sharpe", f"WITH {_MONTHLY} SELECT asset, round(avg(r) / stddev_samp(r), 5) AS sharpe, count(*) AS n FROM mon GROUP BY 1")
def sharpe(spark, d):
    return _monthly(spark, d).groupBy("asset").agg(rnd(P.sharpe("r")).alias("sharpe"), F.count(F.lit(1)).alias("n"))


@query("f_serial_scaling", f"WITH {_MONTHLY}, c AS (SELECT asset, month, r - avg(r) OVER (PARTITION BY asset) AS x FROM mon), l AS (SELECT asset, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2 FROM c WINDOW w AS (PARTITION BY asset ORDER BY month)) SELECT asset, round(3 / sqrt(greatest(3 + 2 * (2 * sum(x * l1) + sum(x * l2)) / sum(x * x), 0.01)), 4) AS scale FROM l GROUP BY 1")
def serial_scaling(spark, d):
    c = _monthly(spark, d).withColumn("x", F.col("r") - F.avg("r").over(Window.partitionBy("asset")))
    w = Window.partitionBy("asset").orderBy("month")
    c = c.select("asset", "x", F.lag("x", 1).over(w).alias("l1"), F.lag("x", 2).over(w).alias("l2"))
    s = lambda k: F.sum(F.col("x") * F.col(k))
    return c.groupBy("asset").agg(rnd(3 / F.sqrt(F.greatest(3 + 2 * (2 * s("l1") + s("l2")) / s("x"), F.lit(0.01))), 4).alias("scale"))


@query("f_annual_correlation", f"WITH {_MONTHLY}, a AS (SELECT month, avg(r) FILTER (WHERE asset % 2 = 0) AS a, avg(r) FILTER (WHERE asset % 2 = 1) AS b FROM mon GROUP BY 1) SELECT CAST(year(month) AS INTEGER) AS year, round(corr(a, b), 4) AS corr, count(*) AS n, round(stddev_samp(a - b), 5) AS tracking FROM a GROUP BY 1 HAVING count(*) > 2")
def annual_correlation(spark, d):
    even = F.col("asset") % 2 == 0
    a = _monthly(spark, d).groupBy("month").agg(F.avg(F.when(even, F.col("r"))).alias("a"), F.avg(F.when(~even, F.col("r"))).alias("b"))
    return a.groupBy(F.year("month").alias("year")).agg(rnd(corr("a", "b"), 4).alias("corr"), F.count(F.lit(1)).alias("n"), rnd(F.stddev_samp(F.col("a") - F.col("b"))).alias("tracking")).where("n > 2")


_COST = f"""{RETURNS}, t AS (SELECT asset, date, cap / 1000000 - lag(cap) OVER (PARTITION BY asset ORDER BY date) / 1000000 AS z, (high - low) / (high + low) AS a, stddev_samp(r) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sigma, cap FROM rets),
c AS (SELECT asset, date, z, a * abs(z) AS spread, CASE WHEN z = 0 THEN 0 ELSE abs(z) * 0.58 * sigma * sqrt(abs(z) / (cap / 1000000)) END AS impact FROM t WHERE z IS NOT NULL AND sigma IS NOT NULL)"""


def _costs(spark, d):
    w = Window.partitionBy("asset").orderBy("date")
    t = returns(spark, d).select("asset", "date", ((F.col("cap") - F.lag("cap").over(w)) / 1_000_000).alias("z"), ((F.col("high") - F.col("low")) / (F.col("high") + F.col("low"))).alias("a"), F.stddev_samp("r").over(w.rowsBetween(-19, 0)).alias("sigma"), "cap")
    spread, impact = P.trade_cost(F.col("z"), F.col("a"), F.col("sigma"), F.col("cap"), F.lit(1_000_000.0), 0.58)
    return t.where("z IS NOT NULL AND sigma IS NOT NULL").select("asset", "date", "z", spread.alias("spread"), impact.alias("impact"))


@query("f_trade_costs", f"WITH {_COST} SELECT asset, date, round(spread, 6) AS spread, round(impact, 6) AS impact FROM c")
def trade_costs(spark, d):
    return _costs(spark, d).select("asset", "date", rnd("spread", 6).alias("spread"), rnd("impact", 6).alias("impact"))


@query("f_costs_by_date", f"WITH {_COST} SELECT date, round(sum(spread), 5) AS spread, round(sum(impact), 5) AS impact, round(sum(abs(z)) / 2, 5) AS turnover FROM c GROUP BY 1")
def costs_by_date(spark, d):
    return _costs(spark, d).groupBy("date").agg(rnd(F.sum("spread")).alias("spread"), rnd(F.sum("impact")).alias("impact"), rnd(F.sum(F.abs("z")) / 2).alias("turnover"))


@query("f_cost_cube", f"WITH {_COST} SELECT CAST(year(date) AS INTEGER) AS year, asset, round(sum(spread + impact), 4) AS cost FROM c GROUP BY CUBE (1, 2)")
def cost_cube(spark, d):
    return _costs(spark, d).withColumn("year", F.year("date")).cube("year", "asset").agg(rnd(F.sum(F.col("spread") + F.col("impact")), 4).alias("cost"))


@query("f_aum_drag", f"WITH {_COST}, k AS (SELECT sum(impact) / sum(abs(z)) AS kappa, avg(spread) AS drag FROM c), g AS (SELECT unnest(range(9)) AS i) SELECT i, round(pow(10.0, 6 + 4 * i / 8.0), 1) AS aum, round(0.04 - drag - kappa * sqrt(pow(10.0, 4 * i / 8.0)), 4) AS net FROM k, g")
def aum_drag(spark, d):
    k = _costs(spark, d).agg((F.sum("impact") / F.sum(F.abs("z"))).alias("kappa"), F.avg("spread").alias("drag"))
    g = spark.range(9).withColumnRenamed("id", "i")
    return k.crossJoin(g).select("i", rnd(F.pow(F.lit(10.0), 6 + 4 * F.col("i") / 8.0), 1).alias("aum"), rnd(0.04 - F.col("drag") - F.col("kappa") * F.sqrt(F.pow(F.lit(10.0), 4 * F.col("i") / 8.0)), 4).alias("net"))


_SLEEVES = """x AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS date, c_mktsegment AS sleeve, sum(CASE WHEN c_custkey % 2 = 0 THEN o_totalprice END) AS p, sum(o_totalprice) AS b, avg(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END) / 100000 AS rp, avg(c_acctbal) / 100000 AS rb FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
w AS (SELECT date, sleeve, p / sum(p) OVER d AS wp, b / sum(b) OVER d AS wb, rp, rb FROM x WINDOW d AS (PARTITION BY date)), t AS (SELECT *, sum(wb * rb) OVER (PARTITION BY date) AS total FROM w)"""


@query("f_brinson", f"WITH {_SLEEVES} SELECT date, sleeve, round((wp - wb) * (rb - total), 6) AS allocation, round(wb * (rp - rb), 6) AS selection, round((wp - wb) * (rp - rb), 6) AS interaction FROM t")
def brinson(spark, d):
    even = F.col("c_custkey") % 2 == 0
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = o.groupBy(F.trunc("o_orderdate", "year").alias("date"), F.col("c_mktsegment").alias("sleeve")).agg(F.sum(F.when(even, F.col("o_totalprice"))).alias("p"), F.sum("o_totalprice").alias("b"), (F.avg(F.when(even, F.col("c_acctbal"))) / 100_000).alias("rp"), (F.avg("c_acctbal") / 100_000).alias("rb"))
    w = Window.partitionBy("date")
    s = x.select("date", "sleeve", "rp", "rb", (F.col("p") / F.sum("p").over(w)).alias("wp"), (F.col("b") / F.sum("b").over(w)).alias("wb"))
    return P.brinson(s, "date").select("date", "sleeve", *(rnd(c, 6).alias(c) for c in ("allocation", "selection", "interaction")))


@query("f_factor_variance", f"WITH {VECTORS}, cov AS (SELECT label, i, j, sum(xi * xj) / count(*) AS value FROM prs GROUP BY 1, 2, 3), e AS (SELECT label, rn, i, x FROM long) SELECT e.label, e.rn, round(sum(e.x * f.x * (CASE WHEN e.i <= f.i THEN c1.value ELSE c2.value END)), 5) AS variance FROM e JOIN e f ON e.label = f.label AND e.rn = f.rn LEFT JOIN cov c1 ON c1.label = e.label AND c1.i = e.i AND c1.j = f.i LEFT JOIN cov c2 ON c2.label = e.label AND c2.i = f.i AND c2.j = e.i GROUP BY 1, 2")
def factor_variance(spark, d):
    """Variance of the portfolios whose exposures are the vectors of each label."""
    v = vectors(spark, d)
    cov = M.both_triangles(M.second_moment(M.pairs(v, "label", "v", ["rn"]), "label"), "label")
    e = v.select("label", "rn", F.posexplode("v").alias("i", "x"))
    return P.factor_variance(e, cov, "label", "rn").select("label", "rn", rnd("variance").alias("variance"))


@query("f_linking", f"WITH {_MONTHLY}, y AS (SELECT asset, CAST(year(month) AS INTEGER) AS year, month, r, exp(sum(ln(1 + r)) OVER (PARTITION BY asset, year(month))) - 1 AS total FROM mon) SELECT asset, month, round(CASE WHEN r = 0 THEN 1 ELSE ln(1 + r) / r END / (CASE WHEN total = 0 THEN 1 ELSE ln(1 + total) / total END) * r, 5) AS linked FROM y")
def linking(spark, d):
    w = Window.partitionBy("asset", F.year("month"))
    y = _monthly(spark, d).withColumn("total", F.expm1(F.sum(F.log1p("r")).over(w)))
    return y.select("asset", "month", rnd(P.linking_factor(F.col("r")) / P.linking_factor(F.col("total")) * F.col("r")).alias("linked"))


@query("f_nav_drawdown", f"WITH {_MONTHLY}, n AS (SELECT asset, month, exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY month)) AS nav FROM mon), p AS (SELECT asset, month, nav, max(nav) OVER (PARTITION BY asset ORDER BY month) AS peak FROM n) SELECT asset, round(min(nav / peak - 1), 5) AS drawdown, round(arg_max(nav, month), 4) AS nav FROM p GROUP BY 1")
def nav_drawdown(spark, d):
    w = Window.partitionBy("asset").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    n = _monthly(spark, d).withColumn("nav", F.exp(F.sum(F.log1p("r")).over(w))).withColumn("peak", F.max("nav").over(w))
    return n.groupBy("asset").agg(rnd(F.min(F.col("nav") / F.col("peak") - 1)).alias("drawdown"), rnd(F.max_by("nav", "month"), 4).alias("nav"))


@query("f_holdings_distance", f"WITH {BARS}, s AS (SELECT date, asset, cap / sum(cap) OVER (PARTITION BY date) AS a, volume / sum(volume) OVER (PARTITION BY date) AS b FROM bars), g AS (SELECT date, sum(abs(a - b)) AS l1 FROM s GROUP BY 1) SELECT round(max(l1), 5) AS largest, count(*) AS dates FROM g")
def holdings_distance(spark, d):
    w = Window.partitionBy("date")
    s = bars(spark, d).select("date", F.abs(F.col("cap") / F.sum("cap").over(w) - F.col("volume") / F.sum("volume").over(w)).alias("x"))
    return s.groupBy("date").agg(F.sum("x").alias("l1")).agg(rnd(F.max("l1")).alias("largest"), F.count(F.lit(1)).alias("dates"))


@query("f_multi_horizon", f"WITH {RETURNS}, d AS (SELECT date, sum(r) FILTER (WHERE asset % 2 = 0) AS a, sum(r) FILTER (WHERE asset % 2 = 1) AS b FROM rets GROUP BY 1), h AS (SELECT 'week' AS horizon, date_trunc('week', date) AS k, sum(a) AS a, sum(b) AS b FROM d GROUP BY 2 UNION ALL SELECT 'month', date_trunc('month', date), sum(a), sum(b) FROM d GROUP BY 2 UNION ALL SELECT 'quarter', date_trunc('quarter', date), sum(a), sum(b) FROM d GROUP BY 2) SELECT horizon, round(corr(a, b), 4) AS corr, count(*) AS n FROM h GROUP BY 1")
def multi_horizon(spark, d):
    even = F.col("asset") % 2 == 0
    day = returns(spark, d).groupBy("date").agg(F.sum(F.when(even, F.col("r"))).alias("a"), F.sum(F.when(~even, F.col("r"))).alias("b"))
    h = F.explode(F.array(*(F.struct(F.lit(k).alias("horizon"), F.trunc("date", k).alias("k")) for k in ("week", "month", "quarter")))).alias("h")
    return day.select("a", "b", h).groupBy("h.horizon", "h.k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).groupBy("horizon").agg(rnd(corr("a", "b"), 4).alias("corr"), F.count(F.lit(1)).alias("n"))
