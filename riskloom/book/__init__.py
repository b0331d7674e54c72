"""Statistics of scores and books: weighted quantiles, breaches, spreads, ratios with errors, capacity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_quantiles(df: DataFrame, keys: list[str], x: str, weight: str, quantiles: dict[str, float], tie: str) -> DataFrame:
    """By sorted cumulative weight: position (cum - w) / (total - w), linear between the rows on both sides."""
    w = Window.partitionBy(*keys)
    o = w.orderBy(x, tie)
    c = df.select(*keys, x, tie, weight, F.sum(weight).over(o.rowsBetween(Window.unboundedPreceding, -1)).alias("_cum"), F.sum(weight).over(w).alias("_all"))
    c = c.withColumn("_pos", F.try_divide(F.coalesce("_cum", F.lit(0.0)), F.col("_all") - F.col(weight)))
    c = c.withColumn("_x2", F.lead(x).over(o)).withColumn("_pos2", F.lead("_pos").over(o))

    def at(q: float) -> Column:
        here = (F.col("_pos") <= q) & (F.col("_pos2") > q)
        return F.max(F.when(here, F.col(x) + (F.col("_x2") - F.col(x)) * (q - F.col("_pos")) / (F.col("_pos2") - F.col("_pos"))))

    return c.groupBy(*keys).agg(*(at(q).alias(n) for n, q in quantiles.items()))


def independence(flags: DataFrame, key: str, date: str, flag: str) -> DataFrame:
    """Likelihood ratio that a flag doesn't depend on the one before; keys without all kinds of steps are left out."""
    t = flags.withColumn("_p", F.lag(flag).over(Window.partitionBy(key).orderBy(date)))
    cell = lambda p, b: F.count_if((F.col("_p") == p) & (F.col(flag) == b))
    n = t.groupBy(key).agg(cell(0, 0).alias("a"), cell(0, 1).alias("b"), cell(1, 0).alias("c"), cell(1, 1).alias("d")).where("a > 0 AND b > 0 AND c > 0")
    n = n.withColumn("pi", F.expr("(b + d) / (a + b + c + d)")).withColumn("p0", F.expr("b / (a + b)")).withColumn("p1", F.expr("d / (c + d)"))
    return n.withColumn("lr", F.expr("-2 * ((a + c) * ln(1 - pi) + (b + d) * ln(pi) - a * ln(1 - p0) - b * ln(p0) - c * ln(1 - p1) - if(d > 0, d * ln(p1), 0D))"))


def lagged_multiplier(bias: DataFrame, date: str, b: str, half_life: float) -> DataFrame:
    """Decayed root mean square of the bias, as it stood a session before. A row a session."""
    w = Window.orderBy(date)
    e = w.rowsBetween(Window.unboundedPreceding, 0)
    x = bias.withColumn("_g", F.pow(F.lit(2.0), F.row_number().over(w) / float(half_life)))
    x = x.withColumn("_m", F.sqrt(F.sum(F.col("_g") * F.col(b) * F.col(b)).over(e) / F.sum("_g").over(e)))
    return x.select(date, F.lag("_m").over(w).alias("multiplier"))


def in_band(ratio: Column, low: float, high: float) -> Column:
    """Strictly in a band or in its reciprocal."""
    return ((ratio > low) & (ratio < high)) | ((ratio > 1 / high) & (ratio < 1 / low))


def weighted_sum(weights: dict[str, float], parts: dict[str, Column]) -> Column:
    """Null if a part is."""
    return reduce(lambda x, y: x + y, (weights[k] * parts[k] for k in weights))


def effective_spread(bars: DataFrame, key: str, date: str, window: int, least: int) -> DataFrame:
    """``s2``: four times the mean over a window of (close - mid)(close - next mid) of log prices; negative values stay."""
    o = Window.partitionBy(key).orderBy(date)
    h = bars.select(key, date, F.log("close").alias("_c"), ((F.log("high") + F.log("low")) / 2).alias("_m"))
    p = h.withColumn("_x", (F.col("_c") - F.col("_m")) * (F.col("_c") - F.lead("_m").over(o)))
    w = o.rowsBetween(-(window - 1), 0)
    return p.select(key, date, (4 * F.avg("_x").over(w)).alias("s2"), F.count("_x").over(w).alias("_n")).where(F.col("_n") >= least).drop("_n")


def half_spread(full: Column, commission: float) -> Column:
    return full / 2 + commission


def bartlett(columns: list[Column]) -> Column:
    """sum g0 g0 + 2 sum (1 - k / (L + 1)) g0 gk of a score and its lags."""
    lags = len(columns) - 1
    out = F.sum(columns[0] * columns[0])
    for k in range(1, lags + 1):
        out = out + 2 * (1 - k / (lags + 1)) * F.sum(F.coalesce(columns[0] * columns[k], F.lit(0.0)))
    return F.greatest(out, F.lit(0.0))


def sharpe_error(df: DataFrame, key: str, date: str, r: str, lags: int) -> DataFrame:
    """Ratio of mean to deviation, its error from the HAC moments of the influence of each row."""
    p, w = Window.partitionBy(key), Window.partitionBy(key).orderBy(date)
    q = df.withColumn("_mu", F.avg(r).over(p)).withColumn("_v", F.avg(F.col(r) * F.col(r)).over(p) - F.col("_mu") * F.col("_mu")).where("_v > 0")
    e = F.col(r) - F.col("_mu")
    q = q.withColumn("_g0", e / F.sqrt("_v") - F.col("_mu") / (2 * F.col("_v") * F.sqrt("_v")) * (e * e - F.col("_v")))
    for k in range(1, lags + 1):
        q = q.withColumn(f"_g{k}", F.lag("_g0", k).over(w))
    total = bartlett([F.col(f"_g{k}") for k in range(lags + 1)])
    return q.groupBy(key).agg((F.max("_mu") / F.sqrt(F.max("_v"))).alias("sharpe"), (F.sqrt(total) / F.count(F.lit(1))).alias("error"))


def corrected_moments(g1: Column, g2: Column, n: Column) -> tuple[Column, Column]:
    """Skewness and excess kurtosis of a sample from those of the population form."""
    return g1 * F.sqrt(n * (n - 1)) / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def capacity(alpha: Column, turnover: Column, kappa: Column, exponent: float, drag: float) -> tuple[Column, Column]:
    """Money at which the net is zero, and at which its slope is; null without alpha over the drag."""
    ok = (alpha > drag) & (kappa > 0)
    point = lambda scale: F.when(ok, F.pow((alpha - drag) / (scale * turnover * kappa), 1 / (exponent - 1)))
    return point(1.0), point(exponent)


def crossing(points: DataFrame, key: str, x: str, net: str) -> DataFrame:
    """First x with net <= 0, linear with the point before; the lowest x if that is the first one, null if there is none."""
    o = Window.partitionBy(key).orderBy(x)
    p = points.withColumn("_x0", F.lag(x).over(o)).withColumn("_n0", F.lag(net).over(o))
    at = F.coalesce(F.col("_x0") + (F.col(x) - F.col("_x0")) * F.col("_n0") / (F.col("_n0") - F.col(net)), F.col(x))
    return p.groupBy(key).agg(F.min_by(F.when(F.col(net) <= 0, at), F.when(F.col(net) <= 0, F.col(x))).alias("at"))


def fisher_interval(c: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    return F.tanh(F.atanh(c) - z / F.sqrt(n - 3)), F.tanh(F.atanh(c) + z / F.sqrt(n - 3))


def book(periods: DataFrame, key: str, date: str, r: str, cost: str) -> DataFrame:
    """``nav`` after each period, from 1, and ``cost``: the share of the NAV before that trading took."""
    w = Window.partitionBy(key).orderBy(date)
    n = periods.withColumn("nav", F.exp(F.sum(F.log((1 - F.col(cost)) * (1 + F.col(r)))).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return n.select(key, date, "nav", (F.coalesce(F.lag("nav").over(w), F.lit(1.0)) * F.col(cost)).alias("cost"))
