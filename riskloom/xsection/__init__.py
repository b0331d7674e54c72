"""Transforms of one date's cross-section, as windows partitioned by date."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def winsorise(x: Column, bound: float, date: str = "date") -> Column:
    """Clipped to mean +- bound sd; fewer than two names or a zero sd leave x as it is."""
    w = Window.partitionBy(date)
    m, s = F.avg(x).over(w), F.stddev_samp(x).over(w)
    return F.when((s > 0) & x.isNotNull(), F.greatest(F.least(x, m + bound * s), m - bound * s)).otherwise(x)


def standardise(x: Column, cap: Column, date: str = "date") -> Column:
    """(x - cap-weighted mean) / equal-weighted sd; null without a cap."""
    w = Window.partitionBy(date)
    known = F.when(x.isNotNull(), cap)
    mean = F.sum(x * known).over(w) / F.sum(known).over(w)
    sd = F.stddev_samp(F.when(cap.isNotNull(), x)).over(w)
    return F.when(cap.isNotNull(), F.try_divide(x - mean, F.when(sd > 0, sd)))


def orthogonalise(y: Column, x: Column, weight: Column, date: str = "date") -> Column:
    """Residual of the weighted regression of y on x and a constant."""
    w = Window.partitionBy(date)
    g = F.when(y.isNotNull() & x.isNotNull(), weight)
    s = lambda c: F.sum(g * c).over(w)
    n = F.sum(g).over(w)
    my, mx = s(y) / n, s(x) / n
    slope = F.try_divide(s(x * y) / n - mx * my, F.when(s(x * x) / n - mx * mx > 1e-15, s(x * x) / n - mx * mx))
    return y - my - F.coalesce(slope, F.lit(0.0)) * (x - mx)


def demean(x: Column, date: str = "date") -> Column:
    """x less the date's mean; null for the whole date if any name lacks it."""
    w = Window.partitionBy(date)
    return F.when(F.count(x).over(w) == F.count(F.lit(1)).over(w), x - F.avg(x).over(w))


def buckets(order: list[Column], n: int, date: str = "date") -> Column:
    """floor(rank * n / count), ranks from 0 in a stable order."""
    w = Window.partitionBy(date)
    return F.floor((F.row_number().over(w.orderBy(*order)) - 1) * n / F.count(F.lit(1)).over(w))


def mid_rank(x: Column, partition: list[str]) -> Column:
    w = Window.partitionBy(*partition)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, x))
    return F.rank().over(w.orderBy(x)) + (ties - 1) / 2
