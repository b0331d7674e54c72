"""Covariance estimators on windows before rebalances, minimum-variance books held until the next, and their realised volatility.

The estimator is a key column. A window's rows meet in one task, so a window of any length of history is
bounded by ``window``; weights reach the days they are held on by an as-of join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..panel import asof


def sample(x: np.ndarray) -> tuple[np.ndarray, float]:
    return np.atleast_2d(np.cov(x.T)), 0.0


def constant_correlation(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shrunk to the mean correlation; the intensity (from fourth-order sums) is (pi - rho) / gamma / T, between 0 and 1."""
    t, k = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / t
    sd = np.sqrt(np.diag(s))
    if k < 2 or (sd <= 0).any():
        return s, 0.0
    off = ~np.eye(k, dtype=bool)
    mean = (s / np.outer(sd, sd))[off].mean()
    target = np.where(off, mean * np.outer(sd, sd), s)
    pi = (c**2).T @ c**2 / t - s**2
    theta = (c**3).T @ c / t - np.diag(s)[:, None] * s  # covariance of s_ii with s_ij
    rho = np.trace(pi) + mean * (theta * sd[None, :] / sd[:, None])[off].sum()
    gamma = ((target - s) ** 2).sum()
    delta = float(np.clip((pi.sum() - rho) / gamma / t, 0, 1)) if gamma > 0 else 0.0
    return delta * target + (1 - delta) * s, delta


def identity_shrinkage(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Oracle-approximating shrinkage to the mean variance times the identity."""
    t, k = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / t
    mu, square = np.trace(s) / k, (s**2).sum()
    bottom = (t + 1 - 2 / k) * (square - k * mu**2)
    rho = float(np.clip(((1 - 2 / k) * square + (k * mu) ** 2) / bottom, 0, 1)) if bottom > 0 else 1.0
    return (1 - rho) * s + rho * mu * np.eye(k), rho


def _rebuilt(e: np.ndarray, v: np.ndarray) -> np.ndarray:
    a = (v * e) @ v.T
    d = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return a / np.outer(d, d)


def _correlation(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, _ = sample(x)
    sd = np.sqrt(np.diag(s))
    return s / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1)), sd


def denoised(x: np.ndarray, without: int = 0) -> tuple[np.ndarray, float]:
    """Correlation whose eigenvalues up to (1 + sqrt(K / T))^2 take their mean, after the leading ``without`` were taken out; the share of them."""
    r, sd = _correlation(x)
    if without:
        e, v = np.linalg.eigh(r)
        e[len(e) - without :] = 0
        r = _rebuilt(np.maximum(e, 0), v)
    e, v = np.linalg.eigh(r)
    noise = e <= (1 + np.sqrt(x.shape[1] / x.shape[0])) ** 2
    if noise.any():
        e[noise] = e[noise].mean()
    return _rebuilt(np.maximum(e, 0), v) * np.outer(sd, sd), float(noise.mean())


def detoned(x: np.ndarray) -> tuple[np.ndarray, float]:
    return denoised(x, 1)


ESTIMATORS: dict[str, Callable[[np.ndarray], tuple[np.ndarray, float]]] = {
    "sample": sample, "constant_correlation": constant_correlation, "identity": identity_shrinkage, "denoised": denoised, "detoned": detoned,
}


def minimum_variance(s: np.ndarray) -> np.ndarray | None:
    """S^-1 1 / 1'S^-1 1; None for a matrix that isn't positive definite to rounding."""
    e = np.linalg.eigvalsh(s)
    if not np.isfinite(e).all() or e[0] <= 1e-12 * max(e[-1], 1e-300):
        return None
    w = np.linalg.solve(s, np.ones(len(s)))
    return w / w.sum()


def estimates(df: DataFrame, key: str, window: int, every: int, names: list[str] | None = None, same_variances: bool = True) -> DataFrame:
    """(key, rn, estimator, covariance, intensity, weights, forecast): each estimator on the ``window`` rows up to each rebalance.

    ``df`` has key, rn from 1 and v. Rebalances are the rows ``window``, ``window + every``, ... ; with
    ``same_variances`` every estimator's correlation takes the sample's variances, so that only
    correlations differ. A matrix without an inverse has null weights.
    """
    names = names or list(ESTIMATORS)
    first, last = F.greatest(F.expr(f"cast(ceil((rn - {window}) / {float(every)}) as long)"), F.lit(0)), F.expr(f"cast(floor((rn - 1) / {float(every)}) as long)")
    d = df.select(key, "rn", "v").where("v IS NOT NULL").withColumn("_at", F.explode(F.sequence(first, F.greatest(last, first)))).where(f"rn <= {window} + _at * {every} AND rn > _at * {every}")
    kind = f"{key} {df.schema[key].dataType.simpleString()}"

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn")
        rows = []
        if len(g) == window:
            x = np.stack(g["v"].to_list())
            base = np.sqrt(np.diag(sample(x)[0]))
            for name in names:
                s, intensity = ESTIMATORS[name](x)
                if same_variances:
                    sd = np.sqrt(np.maximum(np.diag(s), 1e-300))
                    s = s / np.outer(sd, sd) * np.outer(base, base)
                w = minimum_variance(s)
                rows.append((g[key].iloc[0], int(g["rn"].iloc[-1]), name, s.ravel().tolist(), float(intensity), None if w is None else w.tolist(), None if w is None else float(np.sqrt(w @ s @ w))))
        return pd.DataFrame(rows, columns=[key, "rn", "estimator", "covariance", "intensity", "weights", "forecast"], dtype=object)

    return d.groupBy(key, "_at").applyInPandas(fit, f"{kind}, rn long, estimator string, covariance array<double>, intensity double, weights array<double>, forecast double")


def held_returns(df: DataFrame, books: DataFrame, key: str) -> DataFrame:
    """(key, estimator, rn, r, forecast): each day's return of the book of the last rebalance before it."""
    b = books.where("weights IS NOT NULL").select(F.struct(key, "estimator").alias("k"), (F.col("rn") + 1).alias("rn"), F.struct("weights", "forecast").alias("book"))
    names = books.select(key, "estimator").distinct()
    days = df.select(key, "rn", "v").join(names, key).select(F.struct(key, "estimator").alias("k"), "rn", "v")
    got = asof(days, b, "k", "rn", "book", "held").where("held IS NOT NULL")
    r = F.aggregate(F.zip_with("v", "held.weights", lambda a, c: a * c), F.lit(0.0), lambda s, x: s + x)
    return got.select(F.col(f"k.{key}").alias(key), F.col("k.estimator").alias("estimator"), "rn", r.alias("r"), F.col("held.forecast").alias("forecast"))


def realised(returns: DataFrame, key: str, periods: float = 252.0) -> DataFrame:
    """(key, estimator, days, volatility, bias): yearly volatility of what the books earned, and the standard deviation of return over forecast."""
    return returns.groupBy(key, "estimator").agg(F.count(F.lit(1)).alias("days"), (F.stddev_samp("r") * float(np.sqrt(periods))).alias("volatility"), F.stddev_samp(F.try_divide("r", "forecast")).alias("bias"))
