"""Rolling, expanding and decay-weighted statistics by key and date.

A decay weight halves every ``h`` rows, the newest row heaviest. It is written as 2**(rn/h) with rn
the row number by key; the scale cancels in every ratio, so a bounded frame of it is the weighted
window. rn/h has to stay below 1023. Windows are complete or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, date: str = "date") -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(date)))


def trailing(key: str, rows: int, date: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(date).rowsBetween(-(rows - 1), 0)


def expanding(key: str, date: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, counted: Column, w: WindowSpec, rows: int) -> Column:
    """``value`` where the window holds ``rows`` non-null entries."""
    return F.when(F.count(counted).over(w) == rows, value)


def decay(half_life: float) -> Column:
    return F.pow(F.lit(2.0), F.col("rn") / F.lit(float(half_life)))


def decay_mean(x: Column, half_life: float, w: WindowSpec) -> Column:
    g = F.when(x.isNotNull(), decay(half_life))
    return F.sum(x * g).over(w) / F.sum(g).over(w)


def decay_sd(x: Column, half_life: float, w: WindowSpec) -> Column:
    m = decay_mean(x, half_life, w)
    return F.sqrt(F.greatest(decay_mean(x * x, half_life, w) - m * m, F.lit(0.0)))


def decay_beta(df: DataFrame, key: str, date: str, y: str, x: str, half_life: float, rows: int) -> DataFrame:
    """``beta``, ``alpha`` and ``resid`` (residual standard deviation) of y on x over complete decayed windows.

    Six window sums are named columns of their own, so that none is spelled out twice.
    """
    w = trailing(key, rows, date)
    d = df.withColumn("_g", decay(half_life))
    sums = {"_my": y, "_mx": x, "_mxx": f"{x} * {x}", "_mxy": f"{x} * {y}", "_myy": f"{y} * {y}"}
    d = d.select(*df.columns, F.count(F.lit(1)).over(w).alias("_n"), F.sum("_g").over(w).alias("_w"), *(F.sum(F.expr(f"_g * {e}")).over(w).alias(n) for n, e in sums.items()))
    d = d.select(*df.columns, "_n", *((F.col(n) / F.col("_w")).alias(n) for n in sums))
    d = d.withColumn("_vx", F.expr("_mxx - _mx * _mx")).withColumn("_c", F.expr("_mxy - _mx * _my"))
    d = d.withColumn("beta", F.when(F.col("_n") == rows, F.try_divide("_c", F.when(F.col("_vx") != 0, F.col("_vx")))))
    d = d.withColumn("alpha", F.expr("_my - beta * _mx")).withColumn("resid", F.sqrt(F.greatest(F.expr("_myy - _my * _my - beta * _c"), F.when(F.col("beta").isNotNull(), 0.0))))
    return d.drop("_n", "_vx", "_c", *sums)
