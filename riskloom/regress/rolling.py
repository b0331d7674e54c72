"""Rolling decayed regressions on any number of factors, with HAC errors, and what extra factors add.

Rows are dealt into chunks by row number; a chunk also gets the rows before it that its first windows
reach back to, so windows are whole and each is solved in the chunk that holds its last row. The
windows of a chunk are one stack of arrays and one stacked solve.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 256
#: Numbers of a stack of windows that is worked on at a time.
STACK = 1 << 22


def stacked_fit(y: np.ndarray, z: np.ndarray, w: np.ndarray, lags: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, HAC errors (NaN without ``lags``) and R^2 of windows y (m, W) on z (m, k, W) with weights w (W); NaN where the rank is short.

    Scores carry the weights; lagged products of them are Bartlett-weighted.
    """
    m, k, _ = z.shape
    zw = z * w
    a, b = zw @ z.transpose(0, 2, 1), np.einsum("mkw,mw->mk", zw, y)
    scale = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-300))
    unit = a / (scale[:, :, None] * scale[:, None, :])
    good = np.linalg.eigvalsh(unit)[:, 0] > 1e-10 if m else np.zeros(0, bool)
    beta, error, r2 = np.full((m, k), np.nan), np.full((m, k), np.nan), np.full(m, np.nan)
    if not good.any():
        return beta, error, r2
    inverse = np.linalg.inv(unit[good]) / (scale[good, :, None] * scale[good, None, :])
    beta[good] = np.einsum("mkl,ml->mk", inverse, b[good])
    e = y[good] - np.einsum("mk,mkw->mw", beta[good], z[good])
    level = (y[good] @ w) / w.sum()
    total = ((y[good] - level[:, None]) ** 2) @ w
    r2[good] = np.where(total > 0, 1 - (e**2 @ w) / np.where(total > 0, total, 1), np.nan)
    if lags is not None:
        s = zw[good] * e[:, None, :]
        meat = s @ s.transpose(0, 2, 1)
        for j in range(1, lags + 1):
            c = s[:, :, j:] @ s[:, :, :-j].transpose(0, 2, 1)
            meat = meat + (1 - j / (lags + 1)) * (c + c.transpose(0, 2, 1))
        error[good] = np.sqrt(np.maximum(np.diagonal(inverse @ meat @ inverse, axis1=1, axis2=2), 0))
    return beta, error, r2


def rolling_regression(df: DataFrame, keys: list[str], window: int, half_life: float | None, lags: int | None = None, nested: list[int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(keys, rn, alpha, betas, alpha_error, beta_errors, r2, nested_r2) of every complete window of ``window`` rows.

    ``df`` has keys, rn from 1 without gaps, y and x (an array of one length a key), none of them null.
    ``nested_r2`` has the R^2 on the first so many factors for each number in ``nested``, over the same windows.
    """
    own = F.expr(f"cast((rn - 1) div {chunk} as long)")
    last = F.expr(f"cast((rn + {window - 2}) div {chunk} as long)")
    d = df.select(*keys, "rn", "y", "x", F.explode(F.sequence(own, last)).alias("_chunk"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    w = 2.0 ** (-np.arange(window - 1, -1, -1.0) / half_life) if half_life else np.ones(window)
    names = ["rn", "alpha", "betas", "alpha_error", "beta_errors", "r2", "nested_r2"]
    null = lambda v: None if v != v else float(v)
    many = lambda v: None if np.isnan(v).any() else v.tolist()

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn")
        c, rn = int(g["_chunk"].iloc[0]), g["rn"].to_numpy()
        ends = np.flatnonzero((rn > c * chunk) & (np.arange(len(rn)) >= window - 1))
        rows = []
        if len(ends):
            y = g["y"].to_numpy(float)
            x = np.stack(g["x"].to_list()).astype(float)
            z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            ys = np.lib.stride_tricks.sliding_window_view(y, window)
            zs = np.lib.stride_tricks.sliding_window_view(z, window, axis=0)
            step = max(1, STACK // (window * z.shape[1]))
            for k in range(0, len(ends), step):
                at = ends[k : k + step] - window + 1
                beta, error, r2 = stacked_fit(ys[at], zs[at], w, lags)
                parts = [stacked_fit(ys[at], zs[at][:, : n + 1], w, None)[2] for n in nested or []]
                for i, t in enumerate(at + window - 1):
                    rows.append((rn[t], null(beta[i, 0]), many(beta[i, 1:]), null(error[i, 0]), many(error[i, 1:]), null(r2[i]), [null(p[i]) for p in parts]))
        out = pd.DataFrame(rows, columns=names, dtype=object)
        for k in keys:
            out[k] = g[k].iloc[0] if len(rows) else None
        return out[[*keys, *names]]

    return d.groupBy(*keys, "_chunk").applyInPandas(fit, f"{kinds}, rn long, alpha double, betas array<double>, alpha_error double, beta_errors array<double>, r2 double, nested_r2 array<double>")


def exposure_panel(fits: DataFrame, keys: list[str], factors: list[str]) -> DataFrame:
    """(keys, rn, factor, exposure, error): one row an asset, row number and factor."""
    names = F.array(*(F.lit(f) for f in factors))
    d = fits.where("betas IS NOT NULL").select(*keys, "rn", F.explode(F.arrays_zip(names.alias("factor"), F.col("betas").alias("exposure"), F.coalesce("beta_errors", F.transform("betas", lambda _: F.lit(None).cast("double"))).alias("error"))).alias("e"))
    return d.select(*keys, "rn", "e.factor", "e.exposure", "e.error")


def projection(df: DataFrame, by: str, alpha: str, x: str) -> DataFrame:
    """``df`` (by, alpha, x an array) with ``spanned``, ``orthogonal`` and ``cosine``: alpha of each group split by the span of the exposures.

    Cross products are summed by group, the generalised inverse of each K x K matrix gives the
    coefficients (K is the group's own), and one row a group is joined back. The cosine is
    sqrt(b' beta / alpha' alpha) from the same sums, 0 where alpha is zero. Rows with a null take no part.
    """
    d = df.where(F.col(alpha).isNotNull() & F.col(x).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c)))
    pair = d.select(by, alpha, x, F.posexplode(x).alias("i", "xi"))
    rhs = pair.select(by, "i", F.lit(-1).alias("j"), (F.col("xi") * F.col(alpha)).alias("v"))
    cells = pair.select(by, "i", "xi", F.posexplode(x).alias("j", "xj")).where("i <= j").select(by, "i", "j", (F.col("xi") * F.col("xj")).alias("v"))
    own = d.select(by, F.lit(-1).alias("i"), F.lit(-1).alias("j"), (F.col(alpha) * F.col(alpha)).cast("double").alias("v"))
    sums = cells.unionByName(rhs).unionByName(own).groupBy(by, "i", "j").agg(F.sum("v").alias("v")).groupBy(by).agg(F.collect_list(F.struct("i", "j", "v")).alias("cells"))

    @F.pandas_udf("coefficients array<double>, cosine double")
    def solve(cells: pd.Series) -> pd.DataFrame:
        out = []
        for c in cells:
            k = max(r["i"] for r in c) + 1
            a, b, own_ = np.zeros((k, k)), np.zeros(k), 0.0
            for r in c:
                if r["i"] < 0:
                    own_ = r["v"]
                elif r["j"] < 0:
                    b[r["i"]] = r["v"]
                else:
                    a[r["i"], r["j"]] = a[r["j"], r["i"]] = r["v"]
            beta = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b
            out.append((beta.tolist(), float(np.sqrt(np.clip(b @ beta / own_, 0, 1))) if own_ > 0 else 0.0))
        return pd.DataFrame(out, columns=["coefficients", "cosine"])

    fitted = sums.select(by, solve("cells").alias("s")).select(by, "s.*")
    value = F.aggregate(F.zip_with(x, "coefficients", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return d.join(fitted, by).withColumn("spanned", value).withColumn("orthogonal", F.col(alpha) - F.col("spanned")).drop("coefficients")
