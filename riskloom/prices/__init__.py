"""Prices with dividends and splits, market values, overrides and drift of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_horizon(df: DataFrame, value: str, days: int) -> DataFrame:
    """Daily ``value`` times days; a row that is on a horizon already (horizon_days over 1) raises."""
    once = F.when(F.col("horizon_days") == 1, F.col(value) * days).otherwise(F.raise_error(F.lit("the value is on a horizon already")))
    return df.withColumn(value, once).withColumn("horizon_days", F.lit(days))


def overridden(df: DataFrame, overrides: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """``value`` taken from ``overrides`` where it has the key."""
    x = df.join(overrides, key, "left")
    return x.select(key, F.coalesce(to, value).alias(value), F.col(to).isNotNull().alias("overridden"))


def later_product(facts: DataFrame, splits: DataFrame, key: str, date: str, value: str, log_ratio: str) -> DataFrame:
    """``adjusted``: value times all ratios of later dates, by a running sum of logarithms over one sorted union."""
    u = facts.select(key, date, value, F.lit(0.0).alias("_l")).unionByName(splits.select(key, date, F.lit(None).cast("double").alias(value), F.col(log_ratio).alias("_l")))
    w = Window.partitionBy(key).orderBy(F.desc(date)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(key, date)
    x = u.withColumn("_sum", F.sum("_l").over(w) - F.sum("_l").over(own)).where(F.col(value).isNotNull())
    return x.select(key, date, (F.col(value) * F.exp("_sum")).alias("adjusted"))


def market_caps(bars: DataFrame, counts: DataFrame, key: str, shares: str) -> DataFrame:
    """``value`` = count times close where the count is positive, and ``status``."""
    x = bars.join(counts.withColumn("_known", F.lit(True)), key, "left")
    status = F.when(F.col("_known").isNull(), "unmapped").when(F.col(shares) <= 0, "screened").otherwise("ok")
    return x.withColumn("status", status).withColumn("value", F.when(status == "ok", F.col(shares) * F.col("close")))


def total_return(prices: DataFrame, actions: DataFrame, key: str, date: str, close: str, dividend: str) -> DataFrame:
    x = prices.join(actions, [key, date], "left")
    w = Window.partitionBy(key).orderBy(date)
    return x.withColumn("r", (F.col(close) + F.coalesce(dividend, F.lit(0.0))) / F.lag(close).over(w) - 1)


def split_not_applied(move: Column, ratio: Column) -> Column:
    """The price fell by about the ratio: the move is nearer to -ln(ratio) than half of it."""
    return F.abs(move + F.log(ratio)) < 0.5 * F.log(ratio)


def drift(df: DataFrame, now: str, first: str, known: str, width: int = 5) -> DataFrame:
    """Null-safe flags: whether the code, and whether its group of ``width`` codes, differs from the first one."""
    group = lambda c: F.floor(F.col(c) / width)
    return df.withColumn("code_differs", F.when(F.col(known), F.col(now) != F.col(first))).withColumn("group_differs", F.when(F.col(known), group(now) != group(first)))
