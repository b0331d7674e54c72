"""The normal distribution as Catalyst expressions, and what rests on it: p values, expected maximum and deflated Sharpe."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of published rational approximations.
# Normal distribution function (Hart's double-precision algorithm, as in West 2005).
_CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_CDF_TURN = 7.07106781186547
# Normal quantile (Acklam): middle and tails.
_Q_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_Q_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_Q_TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_Q_TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_Q_LOW = 0.02425
EULER = 0.5772156649015329


def _poly(c: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda s, k: s * x + F.lit(k), c[1:], F.lit(c[0]))


def cdf(x: Column) -> Column:
    """P(Z <= x), to 1e-14; null for null and NaN."""
    a = F.abs(x)
    tail = reduce(lambda s, k: a + k / s, (4.0, 3.0, 2.0, 1.0), a + 0.65)
    near = F.exp(-a * a / 2) * _poly(_CDF_TOP, a) / _poly(_CDF_BOTTOM, a)
    far = F.exp(-a * a / 2) / tail / math.sqrt(2 * math.pi)
    up = F.when(a < _CDF_TURN, near).when(a > 37, 0.0).otherwise(far)
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x > 0, 1 - up).otherwise(up))


def quantile(p: Column) -> Column:
    """x with P(Z <= x) = p, to 2e-9 of its size; null outside (0, 1)."""
    q = p - 0.5
    middle = q * _poly(_Q_TOP, q * q) / _poly(_Q_BOTTOM, q * q)
    t = F.sqrt(-2 * F.log(F.when(p < 0.5, p).otherwise(1 - p)))
    tail = _poly(_Q_TAIL_TOP, t) / _poly(_Q_TAIL_BOTTOM, t)
    return F.when((p > 0) & (p < 1), F.when((p >= _Q_LOW) & (p <= 1 - _Q_LOW), middle).when(p < 0.5, tail).otherwise(-tail))


def chi_square_p(x: Column, degrees: int) -> Column:
    """P(chi^2 > x) for one or two degrees of freedom."""
    if degrees == 2:
        return F.exp(-F.greatest(x, F.lit(0.0)) / 2)
    if degrees == 1:
        return 2 * (1 - cdf(F.sqrt(F.greatest(x, F.lit(0.0)))))
    raise ValueError("one or two degrees of freedom")


def expected_maximum(variance: Column, trials: Column) -> Column:
    """Expected largest of so many independent ratios of that variance; null for fewer than two."""
    n = trials.cast("double")
    return F.when(n >= 2, F.sqrt(variance) * ((1 - EULER) * quantile(1 - 1 / n) + EULER * quantile(1 - 1 / (n * math.e))))


def deflated(returns: DataFrame, trial: str, r: str) -> DataFrame:
    """(trial, periods, sharpe, skewness, kurtosis, expected, probability): that a trial's ratio exceeds the best expected of all trials by luck.

    Skewness and kurtosis are corrected for the sample; trials with fewer than four periods or no
    variance count for nothing; the probability is null where the statistic's variance isn't positive.
    """
    n = F.col("periods").cast("double")
    t = returns.where(F.col(r).isNotNull()).groupBy(trial).agg(F.count(F.lit(1)).alias("periods"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_sd"), F.skewness(r).alias("_g"), F.kurtosis(r).alias("_k"))
    t = t.where("periods >= 4 AND _sd > 0").withColumn("sharpe", F.col("_mean") / F.col("_sd"))
    t = t.withColumn("skewness", F.col("_g") * F.sqrt(n * (n - 1)) / (n - 2)).withColumn("kurtosis", ((n + 1) * F.col("_k") + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3)
    every = t.agg(F.var_samp("sharpe").alias("_v"), F.count(F.lit(1)).alias("_n")).select(expected_maximum(F.col("_v"), F.col("_n")).alias("expected"))
    inside = 1 - F.col("skewness") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    t = t.crossJoin(F.broadcast(every))  # one row
    stat = (F.col("sharpe") - F.col("expected")) * F.sqrt(n - 1) / F.sqrt(F.when(inside > 0, inside))
    return t.select(trial, "periods", "sharpe", "skewness", "kurtosis", "expected", cdf(stat).alias("probability"))


def breach_tests(counts: DataFrame, level: float) -> DataFrame:
    """``counts`` (n00, n01, n10, n11: days by breach on the day before and on the day) with the statistics and p values of coverage, independence and both.

    Terms with a count of zero are zero; nulls where there is no day.
    """
    term = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(p)).otherwise(0.0) if isinstance(k, str) else F.when(k > 0, k * F.log(p)).otherwise(0.0)
    zero, one = F.col("n00") + F.col("n10"), F.col("n01") + F.col("n11")
    p = F.try_divide(one, zero + one)
    p0, p1 = F.try_divide(F.col("n01"), F.col("n00") + F.col("n01")), F.try_divide(F.col("n11"), F.col("n10") + F.col("n11"))
    same = term(zero, 1 - p) + term(one, p)
    apart = term("n00", 1 - p0) + term("n01", p0) + term("n10", 1 - p1) + term("n11", p1)
    given = zero * math.log(1 - level) + one * math.log(level)
    positive = lambda c: F.when(zero + one > 0, F.greatest(c, F.lit(0.0)))
    d = counts.withColumn("coverage", positive(-2 * (given - same))).withColumn("independence", positive(-2 * (same - apart)))
    d = d.withColumn("conditional", F.col("coverage") + F.col("independence"))
    return d.withColumns({"coverage_p": chi_square_p(F.col("coverage"), 1), "independence_p": chi_square_p(F.col("independence"), 1), "conditional_p": chi_square_p(F.col("conditional"), 2)})
