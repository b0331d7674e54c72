"""Queries over rolling regressions, projections, minimum-variance books, breach tests and deflated ratios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import estimators as E
from . import running as R
from .base import MARKET, RETURNS, query, returns, rnd
from .regress import rolling as G
from .queries_book import _TWO, _with_market
from .queries_running import weekly
from .risk import normal as N


@query("q_rolling_regression", f"WITH {_TWO} SELECT asset, date, round(b1, 4) + 0.0 AS b1, round(b2, 4) + 0.0 AS b2, round(my - b1 * mu - b2 * mv, 5) + 0.0 AS alpha, round((b1 * p + b2 * q) / s, 4) + 0.0 AS r2 FROM bt")
def rolling_regression(spark, d):
    """Rolling decayed regression on an array of factors, solved window by window."""
    x = _with_market(spark, d)
    even = F.col("asset") % 2 == 0
    s = x.groupBy("date").agg((F.avg(F.when(even, F.col("r"))) - F.avg(F.when(~even, F.col("r")))).alias("s")).where("s IS NOT NULL")
    p = R.numbered(x.join(s, "date").select("asset", "date", F.col("r").alias("y"), F.array("m", "s").alias("x")), ["asset"], ["date"], F.year("date"))
    fits = G.rolling_regression(p, ["asset"], 126, 63.0)
    return fits.join(p.select("asset", "rn", "date"), ["asset", "rn"]).select("asset", "date", rnd(F.col("betas")[0], 4).alias("b1"), rnd(F.col("betas")[1], 4).alias("b2"), rnd("alpha").alias("alpha"), rnd("r2", 4).alias("r2"))


def _factors(spark, d):
    """A segment's mean weekly change on the changes of all priorities over all segments."""
    w = weekly(spark, d)
    one = w.select("key", "date", F.posexplode("v").alias("i", "x"))
    f = one.groupBy("date", "i").agg(F.avg("x").alias("x")).groupBy("date").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("x"))
    y = one.groupBy("key", "date").agg(F.avg("x").alias("y"))
    return R.numbered(y.join(f, "date"), ["key"], ["date"], F.year("date"))


@query("q_rolling_factors")
def rolling_factors(spark, d):
    """Five factors in windows of 40 weeks with HAC errors, and what the last three add to the first two."""
    return G.rolling_regression(_factors(spark, d), ["key"], 40, 20.0, lags=3, nested=[2])


@query("q_exposure_panel")
def exposure_panel(spark, d):
    """The same as rows of asset, week and factor."""
    return G.exposure_panel(rolling_factors(spark, d), ["key"], [f"priority_{k}" for k in range(1, 6)])


@query("q_augmented_r2")
def augmented_r2(spark, d):
    """By segment the mean R^2 on two and on all factors, and the share of windows that gain a tenth."""
    f = rolling_factors(spark, d).where("r2 IS NOT NULL")
    gain = F.col("r2") - F.col("nested_r2")[0]
    return f.groupBy("key").agg(F.avg(F.col("nested_r2")[0]).alias("two"), F.avg("r2").alias("five"), F.avg(F.when(gain >= 0.1, 1.0).otherwise(0.0)).alias("gains"), F.count(F.lit(1)).alias("windows"))


_SIZE = RETURNS + ", al AS (SELECT date, asset, r AS alpha, ln(lag_cap) AS x FROM rets WHERE r IS NOT NULL AND lag_cap > 0), co AS (SELECT date, count(*) AS n, regr_slope(alpha, x) AS b, regr_intercept(alpha, x) AS a FROM al GROUP BY 1 HAVING count(DISTINCT x) > 1), sp AS (SELECT al.date, asset, alpha, a + b * x AS spanned FROM al JOIN co ON co.date = al.date)"


def _projection(spark, d):
    a = returns(spark, d).where("r IS NOT NULL AND lag_cap > 0").select("date", "asset", F.col("r").alias("alpha"), F.log("lag_cap").alias("lx"))
    enough = a.groupBy("date").agg(F.count_distinct("lx").alias("_n")).where("_n > 1").select("date")
    return G.projection(a.join(enough, "date").withColumn("x", F.array(F.lit(1.0), "lx")).drop("lx"), "date", "alpha", "x")


@query("q_alpha_projection", f"WITH {_SIZE} SELECT date, asset, round(spanned, 4) + 0.0 AS spanned, round(alpha - spanned, 4) + 0.0 AS orthogonal FROM sp")
def alpha_projection(spark, d):
    """Each date's alpha split into what the exposures span and what is orthogonal to them."""
    return _projection(spark, d).select("date", "asset", rnd("spanned", 4).alias("spanned"), rnd("orthogonal", 4).alias("orthogonal"))


@query("q_alpha_cosine", f"WITH {_SIZE} SELECT date, round(sqrt(sum(spanned * spanned) / sum(alpha * alpha)), 4) AS cosine, abs(sum(spanned * (alpha - spanned))) <= 1e-9 * sum(alpha * alpha) AS orthogonal FROM sp GROUP BY 1")
def alpha_cosine(spark, d):
    """By date the cosine between alpha and its spanned part, and whether the parts are orthogonal."""
    p = _projection(spark, d)
    return p.groupBy("date").agg(rnd(F.max("cosine"), 4).alias("cosine"), (F.abs(F.sum(F.col("spanned") * F.col("orthogonal"))) <= 1e-9 * F.sum(F.col("alpha") * F.col("alpha"))).alias("orthogonal"))


@query("q_minimum_variance_books")
def minimum_variance_books(spark, d):
    """Five estimators on windows of 60 weeks, held four weeks: realised volatility and bias."""
    w = weekly(spark, d).select("key", "rn", "v")
    return E.realised(E.held_returns(w, E.estimates(w, "key", 60, 4), "key"), "key", 52.0)


@query("q_shrinkage_intensity")
def shrinkage_intensity(spark, d):
    """Intensity of each estimator at each rebalance."""
    return E.estimates(weekly(spark, d).select("key", "rn", "v"), "key", 60, 4).select("key", "rn", "estimator", "intensity", "forecast")


# The distribution function by Simpson's rule and its inverse by bisection, independent of the expressions.
_PHI = "(0.5 + ({x}) * list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(({x}) * i / 400.0, 2) / 2))) / 1200.0 / sqrt(2 * pi()))"
_DEFLATED = f"""WITH RECURSIVE {MARKET}, t AS (SELECT asset, count(*) AS periods, avg(r) / stddev_samp(r) AS sharpe, skewness(r) AS skewness, kurtosis(r) + 3 AS kurtosis FROM rets WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 4 AND stddev_samp(r) > 0),
v AS (SELECT var_samp(sharpe) AS v, CAST(count(*) AS DOUBLE) AS n FROM t),
bis(k, target, lo, hi) AS (SELECT 0, unnest([1 - 1 / n, 1 - 1 / (n * exp(1.0))]), -8.0::DOUBLE, 8.0::DOUBLE FROM v UNION ALL SELECT k + 1, target, CASE WHEN {_PHI.format(x='(lo + hi) / 2')} < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_PHI.format(x='(lo + hi) / 2')} < target THEN hi ELSE (lo + hi) / 2 END FROM bis WHERE k < 50),
z AS (SELECT target, (lo + hi) / 2 AS z FROM bis WHERE k = 50), e AS (SELECT sqrt(v) * ((1 - 0.5772156649015329) * min(z) + 0.5772156649015329 * max(z)) AS expected FROM z, v GROUP BY v),
s AS (SELECT t.*, expected, (sharpe - expected) * sqrt(periods - 1) / sqrt(1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) AS stat FROM t, e)"""


@query("q_deflated_sharpe", _DEFLATED + f" SELECT asset, periods, round(sharpe, 5) + 0.0 AS sharpe, round(skewness, 4) + 0.0 AS skewness, round(kurtosis, 3) AS kurtosis, round(expected, 5) AS expected, round(CASE WHEN abs(stat) < 8 THEN {_PHI.format(x='stat')} WHEN stat > 0 THEN 1.0 ELSE 0.0 END, 5) + 0.0 AS probability FROM s")
def deflated_sharpe(spark, d):
    """By asset the probability that its ratio isn't the best of so many trials by luck."""
    t = N.deflated(returns(spark, d), "asset", "r")
    return t.select("asset", "periods", rnd("sharpe").alias("sharpe"), rnd("skewness", 4).alias("skewness"), rnd("kurtosis", 3).alias("kurtosis"), rnd("expected").alias("expected"), rnd("probability").alias("probability"))


@query("q_breach_tests", f"""WITH {RETURNS}, q AS (SELECT asset, date, r, quantile_cont(r, 0.05) OVER (PARTITION BY asset) AS lim FROM rets WHERE r IS NOT NULL), b AS (SELECT asset, CAST(r < lim AS INTEGER) AS b, lag(CAST(r < lim AS INTEGER)) OVER (PARTITION BY asset ORDER BY date) AS a FROM q),
c AS (SELECT asset, CAST(count(*) FILTER (a = 0 AND b = 0) AS DOUBLE) AS n00, CAST(count(*) FILTER (a = 0 AND b = 1) AS DOUBLE) AS n01, CAST(count(*) FILTER (a = 1 AND b = 0) AS DOUBLE) AS n10, CAST(count(*) FILTER (a = 1 AND b = 1) AS DOUBLE) AS n11 FROM b WHERE a IS NOT NULL GROUP BY 1),
l AS (SELECT *, (n00 + n10) * ln(0.95) + (n01 + n11) * ln(0.05) AS given, CASE WHEN n00 + n10 > 0 THEN (n00 + n10) * ln((n00 + n10) / (n00 + n01 + n10 + n11)) ELSE 0 END + CASE WHEN n01 + n11 > 0 THEN (n01 + n11) * ln((n01 + n11) / (n00 + n01 + n10 + n11)) ELSE 0 END AS same,
 CASE WHEN n00 > 0 THEN n00 * ln(n00 / (n00 + n01)) ELSE 0 END + CASE WHEN n01 > 0 THEN n01 * ln(n01 / (n00 + n01)) ELSE 0 END + CASE WHEN n10 > 0 THEN n10 * ln(n10 / (n10 + n11)) ELSE 0 END + CASE WHEN n11 > 0 THEN n11 * ln(n11 / (n10 + n11)) ELSE 0 END AS apart FROM c),
s AS (SELECT asset, greatest(-2 * (given - same), 0) AS coverage, greatest(-2 * (same - apart), 0) AS independence FROM l)
SELECT asset, round(coverage, 5) AS coverage, round(independence, 5) AS independence, round(2 * (1 - {_PHI.format(x='sqrt(coverage)')}), 5) + 0.0 AS coverage_p, round(2 * (1 - {_PHI.format(x='sqrt(independence)')}), 5) + 0.0 AS independence_p, round(exp(-(coverage + independence) / 2), 5) AS conditional_p FROM s""")
def breach_tests(spark, d):
    """Coverage, independence and both of each asset's breaches of its 5 % quantile, with p values."""
    x = returns(spark, d).where("r IS NOT NULL").select("asset", "date", "r")
    lim = x.groupBy("asset").agg(F.percentile("r", 0.05).alias("lim"))
    b = x.join(lim, "asset").withColumn("b", (F.col("r") < F.col("lim")).cast("int")).withColumn("a", F.lag("b").over(Window.partitionBy("asset").orderBy("date"))).where("a IS NOT NULL")
    n = b.groupBy("asset").agg(*(F.count(F.when((F.col("a") == i) & (F.col("b") == j), 1)).cast("double").alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)))
    return N.breach_tests(n, 0.05).select("asset", *(rnd(c).alias(c) for c in ("coverage", "independence", "coverage_p", "independence_p", "conditional_p")))


