"""Data contracts as jobs: each gives the offending rows or one row of figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A contract is broken."""


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    lost = set(required) - set(df.columns)
    if lost:
        raise ContractError(f"columns missing: {sorted(lost)}")
    return df.select(*required)


def rejected(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which the rule isn't true (null counts as broken)."""
    return df.where(~F.coalesce(rule, F.lit(False)))


def refuse(df: DataFrame, what: str) -> None:
    """Raise if there is any row; only one is fetched."""
    row = df.head(1)
    if row:
        raise ContractError(f"{what}: {row[0].asDict()}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def all_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*((F.count(c) == 0).alias(c) for c in columns))


def missing_periods(df: DataFrame, key: str, month: str) -> DataFrame:
    """Months between a key's first and last that it lacks."""
    want = df.groupBy(key).agg(F.explode(F.sequence(F.min(month), F.max(month), F.expr("interval 1 month"))).alias(month))
    return want.exceptAll(df.select(key, month).distinct())


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count(F.lit(1)).cast("int").alias("differences"))


def digest(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"), F.count(F.lit(1)).alias("n"))


def perturbed(df: DataFrame, date: str, after: str, columns: list[str], seed: int = 1) -> DataFrame:
    """Rows after a date with their numbers multiplied by the exponential of a normal draw."""
    late = F.col(date) > F.to_date(F.lit(after))
    for k, c in enumerate(columns):
        df = df.withColumn(c, F.when(late, F.col(c) * F.exp(F.randn(seed + k))).otherwise(F.col(c)))
    return df


def lookahead(state: Callable[[DataFrame], DataFrame], df: DataFrame, date: str, at: str, columns: list[str]) -> DataFrame:
    """Rows of ``state`` up to a date that change when later rows of ``df`` are perturbed; none if it doesn't look ahead."""
    seen = lambda x: state(x).where(F.col(date) <= F.to_date(F.lit(at)))
    return seen(df).exceptAll(seen(perturbed(df, date, at, columns)))
