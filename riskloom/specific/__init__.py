"""Specific risk at every month end: time-series and structural volatility, blend, shrinkage, regime, as one chained plan.

All tables are keyed by (asset, month). Sums of daily rows are made by month and carried from month to
month; regressions are sums by month with one small solve a month.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_sums(df: DataFrame, key: str, order: str, month: str, x: str, half_life: float, lag_half_life: float, lags: int) -> DataFrame:
    """(key, month, n, seen, w0, c0, w1, c1, ...): of a month's rows the decayed sums of x^2 and of x times its lags, relative to the month's last row.

    ``df`` has no null x; ``seen`` counts the rows that aren't zero.
    """
    w = Window.partitionBy(key).orderBy(order)
    d = df.select(key, month, F.col(x).alias("x"), F.row_number().over(w).alias("rn"), *(F.lag(x, k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    age = F.max("rn").over(Window.partitionBy(key, month)) - F.col("rn")
    d = d.withColumn("_g", F.pow(F.lit(2.0), -age / float(half_life))).withColumn("_h", F.pow(F.lit(2.0), -age / float(lag_half_life)))
    terms = [F.sum("_g").alias("w0"), F.sum(F.expr("_g * x * x")).alias("c0")]
    for k in range(1, lags + 1):
        terms += [F.coalesce(F.sum(F.when(F.col(f"l{k}").isNotNull(), F.col("_h"))), F.lit(0.0)).alias(f"w{k}"), F.coalesce(F.sum(F.expr(f"_h * x * l{k}")), F.lit(0.0)).alias(f"c{k}")]
    return d.groupBy(key, month).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("x") != 0, 1)).alias("seen"), *terms)


def time_series(df: DataFrame, key: str, order: str, month: str, x: str, half_life: float, lag_half_life: float, lags: int) -> DataFrame:
    """(key, month, n, seen, plain, variance, fell_back): decayed variance about zero of all rows up to each month end.

    Bartlett-weighted autocovariances at a half-life of their own are added; a sum that isn't positive
    gives way to the plain variance, and ``fell_back`` says so.
    """
    sums = month_sums(df, key, order, month, x, half_life, lag_half_life, lags)
    kinds = f"{key} {df.schema[key].dataType.simpleString()}, {month} {df.schema[month].dataType.simpleString()}"

    def carried(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(month)
        n = g["n"].to_numpy()
        out = {}
        for c in [f"{p}{k}" for k in range(lags + 1) for p in "wc"]:
            keep = 2.0 ** (-n / (half_life if c[1:] == "0" else lag_half_life))
            at, got = 0.0, []
            for q, v in zip(keep, g[c].to_numpy(), strict=True):
                at = at * q + v
                got.append(at)
            out[c] = np.array(got)
        plain = out["c0"] / out["w0"]
        total = plain.copy()
        for k in range(1, lags + 1):
            total += 2 * (1 - k / (lags + 1)) * np.where(out[f"w{k}"] > 0, out[f"c{k}"] / np.where(out[f"w{k}"] > 0, out[f"w{k}"], 1), 0)
        return pd.DataFrame({key: g[key], month: g[month], "n": n.cumsum(), "seen": g["seen"].cumsum(), "plain": plain, "variance": np.where(total > 0, total, plain), "fell_back": total <= 0})

    return sums.groupBy(key).applyInPandas(carried, f"{kinds}, n long, seen long, plain double, variance double, fell_back boolean")


def fit_by(df: DataFrame, by: str, y: str, xs: list[str], fitted: Column) -> DataFrame:
    """(by, fitted_rows, coefficients, r2): y on a constant and ``xs`` over the rows with ``fitted``; null without a residual degree of freedom or full rank.

    Sums of cross products by group, then one stacked solve for many groups.
    """
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    size = len(cols)
    cells = [F.sum(F.when(fitted, cols[i] * cols[j])) for i in range(size) for j in range(size)]
    sums = df.groupBy(by).agg(F.array(*cells).alias("_a"), F.array(*(F.sum(F.when(fitted, c * F.col(y))) for c in cols)).alias("_b"), F.count(F.when(fitted, 1)).alias("fitted_rows"), F.sum(F.when(fitted, F.col(y) * F.col(y))).alias("_q"))

    @F.pandas_udf("coefficients array<double>, r2 double")
    def solve(n: pd.Series, a: pd.Series, b: pd.Series, q: pd.Series) -> pd.DataFrame:
        coefficients: list = [None] * len(n)
        r2: list = [None] * len(n)
        ok = np.flatnonzero((n.to_numpy() > size) & q.notna().to_numpy())
        if len(ok):
            m, v = np.stack([np.asarray(a[i], float) for i in ok]).reshape(-1, size, size), np.stack([np.asarray(b[i], float) for i in ok])
            scale = np.sqrt(np.maximum(np.diagonal(m, axis1=1, axis2=2), 1e-300))
            unit = m / (scale[:, :, None] * scale[:, None, :])
            full = np.linalg.eigvalsh(unit)[:, 0] > 1e-10
            for i, one, s, rhs, good in zip(ok, unit, scale, v, full, strict=True):
                if good:
                    beta = np.linalg.solve(one, rhs / s) / s
                    total = q[i] - rhs[0] ** 2 / n[i]
                    coefficients[i] = beta.tolist()
                    r2[i] = float(1 - (q[i] - beta @ rhs) / total) if total > 0 else None
        return pd.DataFrame({"coefficients": coefficients, "r2": r2})

    return sums.select(by, "fitted_rows", solve("fitted_rows", "_a", "_b", "_q").alias("s")).select(by, "fitted_rows", "s.*")


def structural(df: DataFrame, month: str, deviation: str, xs: list[str], fitted: Column) -> DataFrame:
    """``df`` with ``structural``, ``e_zero``, ``r2`` and ``fitted_rows``: ln deviation on the exposures, from the fitted rows of the month, for all its rows.

    ``e_zero`` = mean deviation over mean fitted level, over the fitted rows, takes away what taking the
    logarithm biases. Null where the month can't be fitted or an exposure is missing.
    """
    complete = fitted & F.col(deviation).isNotNull() & (F.col(deviation) > 0)
    for x in xs:
        complete = complete & F.col(x).isNotNull()
    d = df.withColumn("_fit", F.coalesce(complete, F.lit(False))).withColumn("_y", F.when(F.col(deviation) > 0, F.log(deviation)))
    d = d.join(fit_by(d, month, "_y", xs, F.col("_fit")), month)
    level = F.col("coefficients")[0]
    for k, x in enumerate(xs, 1):
        level = level + F.col("coefficients")[k] * F.col(x)
    d = d.withColumn("_raw", F.exp(level))
    zero = d.where("_fit").groupBy(month).agg(F.try_divide(F.sum(deviation), F.sum("_raw")).alias("e_zero"))
    return d.join(zero, month, "left").withColumn("structural", F.col("e_zero") * F.col("_raw")).drop("_fit", "_y", "_raw", "coefficients")


def blended(series: Column, model: Column, weight: Column) -> Column:
    """weight * series + (1 - weight) * model; the other one where one is missing."""
    return F.coalesce(weight * series + (1 - weight) * model, series, model)


def shrunk(df: DataFrame, month: str, bucket: str, value: str, q: float, target: Column | None = None) -> DataFrame:
    """``df`` with ``weight`` and ``shrunk``: towards the mean of the month's bucket (of its ``target`` rows) by q times its dispersion.

    A row that stands at its bucket's mean, or whose bucket has no target, keeps its value with weight 1.
    """
    t = F.col(value) if target is None else F.when(target, F.col(value))
    stats = df.groupBy(month, bucket).agg(F.avg(t).alias("_mean"), F.stddev_pop(t).alias("_sd"))
    same = F.col("d._m").eqNullSafe(F.col("s._m")) & F.col("d._b").eqNullSafe(F.col("s._b"))
    left = df.withColumn("_m", F.col(month)).withColumn("_b", F.col(bucket)).alias("d")
    d = left.join(stats.withColumnRenamed(month, "_m").withColumnRenamed(bucket, "_b").alias("s"), same).select("d.*", "_mean", "_sd").drop("_m", "_b")
    away = F.abs(F.col(value) - F.col("_mean"))
    d = d.withColumn("weight", F.when(F.col(value).isNotNull(), F.coalesce(F.try_divide(away, away + q * F.col("_sd")), F.lit(1.0))))
    return d.withColumn("shrunk", F.col("weight") * F.col(value) + (1 - F.col("weight")) * F.coalesce("_mean", value)).drop("_mean", "_sd")


def regime(bias: DataFrame, month: str, square: str, half_life: float) -> DataFrame:
    """(month, multiplier): root of the decayed mean of the squared biases of all months up to each; 1 where there is none yet.

    One row a month comes in, so all of them, as many as the calendar has, go into one array.
    """
    every = bias.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(month).alias("m"), F.col(square).alias("b")))).alias("all"))
    keep = float(2.0 ** (-1.0 / half_life))
    one = every.select("all", F.posexplode("all").alias("at", "r"))
    state = F.aggregate(F.slice("all", F.lit(1), F.col("at") + 1), F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s")), lambda z, r: F.when(r["b"].isNull(), F.struct((z["w"] * keep).alias("w"), (z["s"] * keep).alias("s"))).otherwise(F.struct((z["w"] * keep + 1.0).alias("w"), (z["s"] * keep + r["b"]).alias("s"))))
    return one.select(F.col("r.m").alias(month), state.alias("z")).select(month, F.coalesce(F.sqrt(F.try_divide("z.s", F.when(F.col("z.w") > 0, F.col("z.w")))), F.lit(1.0)).alias("multiplier"))


def specific_risk(residuals: DataFrame, exposures: DataFrame, key: str, order: str, month: str, x: str, xs: list[str], bucket: str, half_life: float, lag_half_life: float, lags: int, floor: int, q: float, regime_half_life: float) -> DataFrame:
    """(key, month, bucket, n, series, structural, blended, shrunk, multiplier, risk) of every asset with exposures at a month end.

    ``residuals`` has key, order, month and x by day; ``exposures`` key, month, bucket and ``xs``. Assets with
    ``floor`` rows that aren't all zero have a volatility of their own; the others take the structural one.
    The multiplier of a month comes from the standardised residuals of the months up to it, each scored
    with the forecast of the month end before.
    """
    ts = time_series(residuals.where(F.col(x).isNotNull()), key, order, month, x, half_life, lag_half_life, lags)
    own = F.when((F.col("n") >= floor) & (F.col("seen") > 0) & (F.col("variance") > 0), F.sqrt("variance"))
    d = exposures.select(key, month, bucket, *xs).join(ts, [key, month], "left").withColumn("series", own)
    d = structural(d, month, "series", xs, F.col("series").isNotNull())
    d = d.withColumn("blended", blended(F.col("series"), F.col("structural"), F.when(F.col("series").isNotNull(), 1.0).otherwise(0.0)))
    d = shrunk(d, month, bucket, "blended", q)
    forecast = d.where("shrunk > 0").select(key, F.add_months(F.col(month), 1).alias(month), F.col("shrunk").alias("_s"))
    z = residuals.where(F.col(x).isNotNull()).join(forecast, [key, month]).groupBy(month).agg(F.avg(F.pow(F.col(x) / F.col("_s"), 2)).alias("_b"))
    scores = d.select(month).distinct().join(z, month, "left")
    known = regime(scores, month, "_b", regime_half_life)
    return d.join(known, month).select(key, month, bucket, "n", "series", "structural", "blended", "shrunk", "multiplier", (F.col("shrunk") * F.col("multiplier")).alias("risk"))
