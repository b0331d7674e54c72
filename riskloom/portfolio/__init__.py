"""Portfolio variance, trading costs, book accounting, attribution and return statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def factor_variance(exposures: DataFrame, cov: DataFrame, key: str, portfolio: str) -> DataFrame:
    """x'Fx by (key, portfolio); exposures (key, portfolio, i, x), cov (key, i, j, value) in both triangles."""
    y = exposures.select(key, portfolio, F.col("i").alias("j"), F.col("x").alias("y"))
    e = exposures.join(cov, [key, "i"]).join(y, [key, portfolio, "j"])
    return e.groupBy(key, portfolio).agg(F.sum(F.col("x") * F.col("y") * F.col("value")).alias("variance"))


def impact_rate(sigma: Column, participation: Column, prefactor: float, exponent: float = 1.5) -> Column:
    """Cost a unit traded: Y * sigma * participation**(exponent - 1)."""
    return prefactor * sigma * F.pow(participation, exponent - 1)


def trade_cost(z: Column, half_spread: Column, sigma: Column, volume: Column, nav: Column, prefactor: float, exponent: float = 1.5) -> tuple[Column, Column]:
    """Spread and impact parts of a trade z (share of NAV); no trade costs nothing and reads no input."""
    size = F.abs(z)
    spread = F.when(z == 0, 0.0).otherwise(half_spread * size)
    impact = F.when(z == 0, 0.0).otherwise(size * impact_rate(sigma, F.try_divide(size, F.try_divide(volume, nav)), prefactor, exponent))
    return spread, impact


def sharpe(r: str) -> Column:
    return F.avg(r) / F.stddev_samp(r)


def brinson(sleeves: DataFrame, date: str) -> DataFrame:
    """Allocation, selection and interaction of each sleeve: weights wp, wb and returns rp, rb."""
    total = F.sum(F.col("wb") * F.col("rb")).over(Window.partitionBy(date))
    return sleeves.withColumn("allocation", (F.col("wp") - F.col("wb")) * (F.col("rb") - total)).withColumn("selection", F.col("wb") * (F.col("rp") - F.col("rb"))).withColumn("interaction", (F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb")))


def linking_factor(r: Column) -> Column:
    """k = ln(1 + r) / r, one at zero."""
    return F.when(r == 0, 1.0).otherwise(F.try_divide(F.log1p(r), r))
