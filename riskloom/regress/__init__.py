"""Regressions from sums that Spark makes: with HAC errors, rolling with decay on two factors, expanding residuals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..book import bartlett


def mean_hac(df: DataFrame, key: str, date: str, x: str, lags: int) -> DataFrame:
    """Mean, count and t by Bartlett-weighted autocovariances."""
    p, w = Window.partitionBy(key), Window.partitionBy(key).orderBy(date)
    e = df.withColumn("_mu", F.avg(x).over(p)).withColumn("_g0", F.col(x) - F.col("_mu"))
    for k in range(1, lags + 1):
        e = e.withColumn(f"_g{k}", F.lag("_g0", k).over(w))
    v = e.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("_mu").alias("mean"), bartlett([F.col(f"_g{k}") for k in range(lags + 1)]).alias("_s"))
    return v.select(key, "n", "mean", F.when(F.col("_s") > 0, F.col("mean") * F.col("n") / F.sqrt("_s")).alias("t"))


def ols_hac(df: DataFrame, key: str, date: str, y: str, x: str, lags: int) -> DataFrame:
    """Intercept and slope with HAC errors: sums by key, joined back, then lagged products of the scores."""
    b = df.groupBy(key).agg(F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.count(F.lit(1)).alias("n"), F.sum(x).alias("_s"), F.sum(F.col(x) * F.col(x)).alias("_q"))
    e = df.join(b, key).withColumn("_e", F.col(y) - F.col("alpha") - F.col("beta") * F.col(x)).withColumn("_d", F.col("n") * F.col("_q") - F.col("_s") * F.col("_s"))
    e = e.withColumn("_a0", F.try_divide(F.col("_e") * (F.col("_q") - F.col("_s") * F.col(x)), "_d")).withColumn("_b0", F.try_divide(F.col("_e") * (F.col("n") * F.col(x) - F.col("_s")), "_d"))
    w = Window.partitionBy(key).orderBy(date)
    for k in range(1, lags + 1):
        e = e.withColumn(f"_a{k}", F.lag("_a0", k).over(w)).withColumn(f"_b{k}", F.lag("_b0", k).over(w))
    error = lambda c: F.sqrt(bartlett([F.col(f"_{c}{k}") for k in range(lags + 1)]))
    return e.groupBy(key).agg(F.max("n").alias("n"), F.max("alpha").alias("alpha"), F.max("beta").alias("beta"), error("a").alias("alpha_error"), error("b").alias("beta_error"))


def rolling_two(df: DataFrame, key: str, date: str, window: int, half_life: float) -> DataFrame:
    """y on u and v with intercept over complete decayed windows: ten named window sums, then the 2 x 2 solve."""
    o = Window.partitionBy(key).orderBy(date)
    w = o.rowsBetween(-(window - 1), 0)
    x = df.withColumn("_g", F.pow(F.lit(2.0), F.row_number().over(o) / float(half_life)))
    names = {"my": "y", "mu": "u", "mv": "v", "uu": "u * u", "vv": "v * v", "uv": "u * v", "uy": "u * y", "vy": "v * y", "yy": "y * y"}
    s = x.select(key, date, F.count(F.lit(1)).over(w).alias("_c"), F.sum("_g").over(w).alias("_w"), *(F.sum(F.expr(f"_g * {e}")).over(w).alias(n) for n, e in names.items())).where(F.col("_c") == window)
    s = s.select(key, date, *((F.col(n) / F.col("_w")).alias(n) for n in names))
    s = s.select(key, date, "my", "mu", "mv", *(F.expr(e).alias(n) for n, e in {"a": "uu - mu * mu", "b": "vv - mv * mv", "o": "uv - mu * mv", "p": "uy - mu * my", "q": "vy - mv * my", "s": "yy - my * my"}.items()))
    det = F.expr("a * b - o * o")
    s = s.withColumn("b1", F.try_divide(F.expr("p * b - q * o"), det)).withColumn("b2", F.try_divide(F.expr("q * a - p * o"), det))
    return s.select(key, date, "b1", "b2", F.expr("my - b1 * mu - b2 * mv").alias("alpha"), F.try_divide(F.expr("b1 * p + b2 * q"), F.col("s")).alias("r2"))


def expanding_residual(y: str, x: str, order: WindowSpec) -> Column:
    """y less its fit on x over all rows up to this one."""
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    return F.col(y) - F.regr_intercept(y, x).over(w) - F.regr_slope(y, x).over(w) * F.col(x)


def _design(industry: str, styles: list[str]) -> Column:
    """The non-zero entries of a name's design row: country 0, styles from 1, its industry behind them."""
    entries = [(F.lit(0), F.lit(1.0)), *((F.lit(k), F.col(s)) for k, s in enumerate(styles, 1)), (F.lit(1 + len(styles)) + F.col(industry), F.lit(1.0))]
    return F.array(*(F.struct(i.cast("int").alias("i"), x.cast("double").alias("x")) for i, x in entries))


def design_sums(df: DataFrame, date: str, y: str, industry: str, styles: list[str], cap: str, exponent: float = 0.5) -> DataFrame:
    """(date, i, j, value): weighted cross products of the design for i <= j; with j = -1 those with y,
    -2 the caps of the industries, -3 and i = 0, 1, 2 the sums of w y, w y y and w, -4 the number of names."""
    w = F.pow(F.col(cap), exponent)
    one = df.select(date, y, cap, w.alias("_w"), _design(industry, styles).alias("_e"))
    a = one.select(date, y, cap, "_w", "_e", F.explode("_e").alias("_a"))
    pairs = a.select(date, F.col("_a.i").alias("i"), F.explode(F.filter("_e", lambda e: e["i"] >= F.col("_a.i"))).alias("_b"), (F.col("_w") * F.col("_a.x")).alias("_x")).select(date, "i", F.col("_b.i").alias("j"), (F.col("_x") * F.col("_b.x")).alias("v"))
    first = 1 + len(styles)
    more = F.array(
        F.struct(F.col("_a.i").alias("i"), F.lit(-1).alias("j"), (F.col("_w") * F.col("_a.x") * F.col(y)).alias("v")),
        F.struct(F.when(F.col("_a.i") >= first, F.col("_a.i")).alias("i"), F.lit(-2).alias("j"), F.col(cap).cast("double").alias("v")),
        *(F.struct(F.when(F.col("_a.i") == 0, k).alias("i"), F.lit(-3).alias("j"), (F.col("_w") * F.col(y) ** k if k else F.col("_w")).alias("v")) for k in (1, 2, 0)),
        F.struct(F.when(F.col("_a.i") == 0, 0).alias("i"), F.lit(-4).alias("j"), F.lit(1.0).alias("v")),
    )
    rest = a.select(date, F.explode(more).alias("m")).select(date, "m.*").where("i IS NOT NULL")
    return pairs.unionByName(rest).groupBy(date, "i", "j").agg(F.sum("v").alias("value"))


_WLS = "country double, country_t double, industries array<int>, industry_returns array<double>, industry_t array<double>, style_returns array<double>, style_t array<double>, eliminated int, r2 double, condition double, names int"


def constraint_matrix(weights: np.ndarray, eliminate: int) -> np.ndarray:
    """Rows of industries from the free ones, such that the weighted sum is zero."""
    rest = [k for k in range(len(weights)) if k != eliminate]
    out = np.zeros((len(weights), len(rest)))
    out[rest, np.arange(len(rest))] = 1
    out[eliminate] = -weights[rest] / weights[eliminate]
    return out


def _solve(cells: list[dict], styles: int) -> tuple:
    v = {(c["i"], c["j"]): c["value"] for c in cells}
    first = 1 + styles
    industries = sorted(i - first for i, j in v if j == -2)
    at = [0, *range(1, first), *(first + k for k in industries)]
    x = np.array([[v.get((min(a, b), max(a, b)), 0.0) for b in at] for a in at])
    y = np.array([v.get((a, -1), 0.0) for a in at])
    cap = np.array([v[first + k, -2] for k in industries])
    drop = int(np.argmax(cap))
    r = np.zeros((len(at), len(at) - 1))
    r[:first, :first] = np.eye(first)
    r[first:, first:] = constraint_matrix(cap / cap.sum(), drop)
    a = r.T @ x @ r
    inverse = np.linalg.pinv(a)
    g = inverse @ (r.T @ y)
    f = r @ g
    names, total, square, weight = v[0, -4], v[1, -3], v[2, -3], v[0, -3]
    rss = max(square - 2 * f @ y + f @ x @ f, 0.0)
    tss = square - total * total / weight
    dof = names - len(g)
    error = np.sqrt(np.maximum(np.diag(r @ inverse @ r.T) * rss / dof, 0)) if dof > 0 else np.full(len(f), np.nan)
    t = np.where(error > 0, f / np.where(error > 0, error, 1), np.nan)
    e = np.linalg.eigvalsh(a)
    null = lambda z: [None if np.isnan(q) else float(q) for q in z]
    return (
        f[0], null(t[:1])[0], industries, f[first:].tolist(), null(t[first:]), f[1:first].tolist(), null(t[1:first]), industries[drop],
        1 - rss / tss if tss > 0 else None, float(np.sqrt(e[-1] / e[0])) if e[0] > 0 else None, int(names),
    )


def constrained_wls(df: DataFrame, date: str, y: str, industry: str, styles: list[str], cap: str, exponent: float = 0.5) -> DataFrame:
    """Country, industry and style returns of each date with t, R squared and condition number.

    Weights are cap ** exponent; the industry returns' cap-weighted sum is zero, by eliminating the
    largest industry (the first of equal ones). Spark makes the sums; a task solves a K x K system a date.
    """
    sums = design_sums(df, date, y, industry, styles, cap, exponent).groupBy(date).agg(F.collect_list(F.struct("i", "j", "value")).alias("cells"))
    n = len(styles)

    @F.pandas_udf(_WLS)
    def solve(cells: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_solve(c, n) for c in cells], columns=[x.split()[0] for x in _WLS.split(", ")])

    return sums.select(date, solve("cells").alias("x")).select(date, "x.*")


def residuals(df: DataFrame, fitted: DataFrame, date: str, y: str, industry: str, styles: list[str]) -> DataFrame:
    """``df`` with ``residual``; one row of returns a date is joined."""
    f = fitted.select(date, F.col("country").alias("_c"), F.map_from_arrays("industries", "industry_returns").alias("_i"), F.col("style_returns").alias("_s"))
    fit = F.col("_c") + F.element_at("_i", F.col(industry))
    for k, s in enumerate(styles):
        fit = fit + F.col("_s")[k] * F.col(s)
    return df.join(f, date).withColumn("residual", F.col(y) - fit).drop("_c", "_i", "_s")
