"""Small dense solves on array rows, many rows an Arrow batch: spectra, repair, regressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matrix_rows(m: DataFrame, key: str) -> DataFrame:
    """One row a key: n, and the full matrix (i, j, value) in row order."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "value"))), lambda c: c["value"])
    return m.groupBy(key).agg(F.count_distinct("i").cast("int").alias("n"), cells.alias("cells"))


def _square(n: int, cells: np.ndarray) -> np.ndarray:
    return np.asarray(cells, np.float64).reshape(n, n)


_SPECTRUM = T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("low", "high", "condition", "asymmetry")), T.StructField("positive", T.BooleanType())])
_CELLS = T.ArrayType(T.DoubleType())


@F.pandas_udf(_SPECTRUM)
def spectrum(n: pd.Series, cells: pd.Series) -> pd.DataFrame:
    """Smallest and largest eigenvalue, their ratio, largest asymmetry, and whether all are positive."""
    rows = []
    for k, c in zip(n, cells, strict=True):
        a = _square(k, c)
        e = np.linalg.eigvalsh((a + a.T) / 2)
        rows.append((e[0], e[-1], e[-1] / e[0] if e[0] > 0 else None, np.abs(a - a.T).max(), bool(e[0] > 0)))
    return pd.DataFrame(rows, columns=["low", "high", "condition", "asymmetry", "positive"])


def floored(floor: float = 1e-14):
    """UDF: the matrix with eigenvalues that aren't positive raised to ``floor``; untouched if there are none."""

    @F.pandas_udf(_CELLS)
    def run(n: pd.Series, cells: pd.Series) -> pd.Series:
        out = []
        for k, c in zip(n, cells, strict=True):
            a = _square(k, c)
            e, v = np.linalg.eigh((a + a.T) / 2)
            out.append(c if e[0] > 0 else ((v * np.where(e > 0, e, floor)) @ v.T).ravel())
        return pd.Series(out)

    return run


def denoised(edge_column: bool = True):
    """UDF: a correlation matrix whose eigenvalues under the edge are set to their mean, diagonal restored."""

    @F.pandas_udf(_CELLS)
    def run(n: pd.Series, cells: pd.Series, edge: pd.Series) -> pd.Series:
        out = []
        for k, c, x in zip(n, cells, edge, strict=True):
            e, v = np.linalg.eigh(_square(k, c))
            low = e < x
            if low.any():
                e = np.where(low, e[low].mean(), e)
            a = (v * e) @ v.T
            s = np.sqrt(np.diag(a))
            out.append((a / np.outer(s, s)).ravel())
        return pd.Series(out)

    return run


def _matrix_udf(f: Callable[[np.ndarray], np.ndarray]):
    """UDF of (n, cells) that gives the numbers of f(matrix) in row order."""

    @F.pandas_udf(_CELLS)
    def run(n: pd.Series, cells: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(f(_square(k, c))).ravel() for k, c in zip(n, cells, strict=True)])

    return run


def variance_inflation():
    """UDF: diagonal of the inverse of a correlation matrix (the generalised inverse where it is singular)."""
    return _matrix_udf(lambda a: np.diag(np.linalg.pinv(a)))


def minimum_variance():
    """UDF: weights S^-1 1 / (1' S^-1 1)."""

    def weights(a: np.ndarray) -> np.ndarray:
        x = np.linalg.pinv(a, hermitian=True).sum(axis=1)
        return x / x.sum()

    return _matrix_udf(weights)


def oriented(v: np.ndarray) -> np.ndarray:
    """Columns with the sign that makes their largest entry positive."""
    big = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return v * np.where(big < 0, -1, 1)


def eigen_portfolios():
    """UDF: eigenvectors by falling eigenvalue, oriented, one behind the other."""
    return _matrix_udf(lambda a: oriented(np.linalg.eigh((a + a.T) / 2)[1][:, ::-1]).T)


def detoned(components: int = 1):
    """UDF: a correlation matrix without its leading components, the diagonal restored."""

    def run(a: np.ndarray) -> np.ndarray:
        e, v = np.linalg.eigh((a + a.T) / 2)
        e[len(e) - components :] = 0
        b = (v * e) @ v.T
        s = np.sqrt(np.maximum(np.diag(b), 1e-300))
        return b / np.outer(s, s)

    return _matrix_udf(run)


def parabola(values: np.ndarray) -> np.ndarray:
    """Least-squares polynomial of second degree of a curve on its index."""
    return np.polyval(np.polyfit(np.arange(len(values)), values, min(2, len(values) - 1)), np.arange(len(values)))


def eigen_scaled(a: float = 1.0):
    """UDF of (n, cells, curve): eigenvalues of the correlation times gamma squared, gamma = a (fit - 1) + 1 with
    the parabola through the curve (one number an eigenvalue, smallest first); volatilities restored."""

    @F.pandas_udf(_CELLS)
    def run(n: pd.Series, cells: pd.Series, curve: pd.Series) -> pd.Series:
        out = []
        for k, c, x in zip(n, cells, curve, strict=True):
            m = _square(k, c)
            s = np.sqrt(np.diag(m))
            e, v = np.linalg.eigh(m / np.outer(s, s))
            gamma = a * (parabola(np.asarray(x, np.float64)) - 1) + 1
            out.append((((v * (e * gamma**2)) @ v.T) * np.outer(s, s)).ravel())
        return pd.Series(out)

    return run


def embedded(present: np.ndarray, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """A block put into a zero matrix of ``size`` at the places ``present``."""

    def run(block: np.ndarray) -> np.ndarray:
        out = np.zeros((size, size))
        out[np.ix_(present, present)] = block
        return out

    return run


def present_block(n: Column, cells: Column) -> Column:
    """Indices of the factors with a positive diagonal."""
    return F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.get(cells, k * n + k) > 0)
