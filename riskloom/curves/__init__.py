"""Curves of a parameter row a date (b0, b1, b2, tau): yields, par bonds, ladders. Yields are percent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION = 1 / 252.0


def curve_yield(n: Column | float) -> Column:
    """Zero-coupon yield at maturity n of the row's curve."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    a = n / F.col("tau")
    h = (1 - F.exp(-a)) / a
    return F.col("b0") + F.col("b1") * h + F.col("b2") * (h - F.exp(-a))


def discount(n: Column | float) -> Column:
    n = n if isinstance(n, Column) else F.lit(float(n))
    return F.exp(-n * curve_yield(n) / 100)


def cashflow_times(maturity: float, frequency: int) -> Column:
    """Coupon times up to maturity, as an array."""
    return F.transform(F.sequence(F.lit(1), F.lit(round(maturity * frequency))), lambda k: k.cast("double") / frequency)


def cashflows(curve: DataFrame, maturity: float, frequency: int) -> DataFrame:
    """A row a date and cash-flow time ``t``."""
    return curve.withColumn("t", F.explode(cashflow_times(maturity, frequency)))


def par_coupon(curve: DataFrame, maturity: float, frequency: int) -> DataFrame:
    f = cashflows(curve, maturity, frequency)
    last = F.max(F.when(F.col("t") == maturity, discount(F.col("t"))))
    return f.groupBy("date").agg(((1 - last) / F.sum(discount(F.col("t")) / frequency)).alias("coupon"))


def _price(f: DataFrame, maturity: float, frequency: int, shorter: float) -> DataFrame:
    left = F.col("t") - shorter
    flow = F.col("coupon") / frequency + F.when(F.col("t") == maturity, 1.0).otherwise(0.0)
    return f.groupBy("date").agg(F.sum(flow * discount(left)).alias("price"))


def par_bond_returns(curve: DataFrame, maturity: float, frequency: int) -> DataFrame:
    """Yesterday's par bond on today's curve, one session shorter. The calendar has a row a session."""
    was = par_coupon(curve, maturity, frequency).select("date", F.lag("coupon").over(Window.orderBy("date")).alias("coupon"))
    return _price(cashflows(curve, maturity, frequency).join(was, "date"), maturity, frequency, SESSION).select("date", (F.col("price") - 1).alias("r"))


def constant_maturity_return(curve: DataFrame, n: float) -> DataFrame:
    """Return of a zero bond held for a session: null on the first date."""
    y = curve.select("date", F.lag(curve_yield(n)).over(Window.orderBy("date")).alias("was"), curve_yield(n - SESSION).alias("now"))
    return y.select("date", F.expm1(n * F.col("was") / 100 - (n - SESSION) * F.col("now") / 100).alias("r"))


def ladder(curve: DataFrame, weights: dict[float, float]) -> DataFrame:
    """Weighted sum of constant-maturity returns; weights are made to sum to one."""
    legs = None
    for n, w in weights.items():
        leg = constant_maturity_return(curve, n).select("date", (F.col("r") * (w / sum(weights.values()))).alias("x"))
        legs = leg if legs is None else legs.union(leg)
    return legs.groupBy("date").agg(F.sum("x").alias("r"))


def seasoned_price(curve: DataFrame, maturity: float, years: int, frequency: int) -> DataFrame:
    """Price of a bond issued at par ``years`` ago; its coupon is the latest one on or before that day."""
    from ..panel import asof

    par = par_coupon(curve, maturity, frequency).select(F.lit(1).alias("k"), "date", "coupon")
    probes = curve.select(F.lit(1).alias("k"), F.add_months("date", -12 * years).alias("date"), F.col("date").alias("today"))
    issued = asof(probes, par, "k", "date", "coupon", "coupon").select(F.col("today").alias("date"), "coupon")
    return _price(cashflows(curve, maturity - years, frequency).join(issued, "date"), maturity - years, frequency, 0.0)
