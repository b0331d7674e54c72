"""The driver's tables as dated panels, and the same as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .running import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, with the SQL that gives the same rows."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(c: Column | str, n: int = 5) -> Column:
    """Rounded, so that sums in another order give the same value; adding zero unites -0 and 0."""
    return F.round(c, n) + 0.0


def corr(x: str, y: str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation; null where a side doesn't vary (the built-in one raises there)."""
    at = (lambda c: c) if over is None else (lambda c: c.over(over))
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sx, sy = (F.stddev_pop(F.when(both, F.col(c))) for c in (x, y))
    return F.try_divide(at(F.covar_pop(x, y)), at(sx) * at(sy))


def bars(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Daily bars by supplier: volume-weighted price, high, low, quantity, value, trades.

    ``together`` deals lines out by supplier at once: one shuffle also serves the windows over a
    supplier's bars, and a query that reads the bars again shares it. Lines without a date are left out
    then, as those windows would put them first.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem")
    return (lines.where("l_shipdate IS NOT NULL").repartition("l_suppkey") if together else lines).groupBy(F.col("l_suppkey").alias("asset"), F.col("l_shipdate").cast("date").alias("date")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("cap"), F.count(F.lit(1)).alias("trades"),
    )


BARS = """bars AS (SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume,
 sum(l_extendedprice) AS cap, count(*) AS trades FROM lineitem GROUP BY 1, 2)"""


def returns(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Bars with rn (row number by asset) and r, the logarithm of the price over the last bar's."""
    w = Window.partitionBy("asset").orderBy("date")
    return bars(spark, sf_dir, together).withColumn("rn", F.row_number().over(w)).withColumn("r", F.log(F.col("close") / F.lag("close").over(w))).withColumn("lag_cap", F.lag("cap").over(w))


RETURNS = (
    BARS
    + """, rets AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn,
 ln(close / lag(close) OVER (PARTITION BY asset ORDER BY date)) AS r, lag(cap) OVER (PARTITION BY asset ORDER BY date) AS lag_cap FROM bars)"""
)


def market(r: DataFrame) -> DataFrame:
    """Lagged-cap weighted return of each date."""
    ok = F.when(F.col("r").isNotNull(), F.col("lag_cap"))
    return r.groupBy("date").agg((F.sum(ok * F.col("r")) / F.sum(ok)).alias("m"), F.count("r").alias("names"))


MARKET = RETURNS + ", mkt AS (SELECT date, sum(lag_cap * r) / sum(CASE WHEN r IS NOT NULL THEN lag_cap END) AS m, count(r) AS names FROM rets GROUP BY date)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor vectors: label, row number within it (0 the newest, so that decay weights stay finite), and all entries."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("_all"))
    return numbered(e, ["label"], ["vec_id"], F.expr("vec_id div 4096")).join(n, "label").withColumn("rn", F.col("rn") - F.col("_all")).drop("_all")


VECTORS = """vecs AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - count(*) OVER (PARTITION BY label) AS rn, embedding FROM embeddings),
 long AS (SELECT label, rn, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM vecs),
 prs AS (SELECT a.label, a.rn, a.i, b.i AS j, a.x AS xi, b.x AS xj FROM long a JOIN long b ON a.label = b.label AND a.rn = b.rn AND a.i <= b.i)"""
