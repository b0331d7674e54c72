"""Second moments of factor vectors in long form (key, rn, i, x): plain, decayed, lagged, shrunk.

Vectors come in as an array column, so that a pair of factors is formed within a row; all sums are
aggregates by (key, i, j) with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(df: DataFrame, key: str, vector: str, keep: list[str], upper: bool = True) -> DataFrame:
    """Rows (key, ..., i, j, xi, xj) for i <= j (or all i, j)."""
    one = df.select(key, *keep, vector, F.posexplode(vector).alias("i", "xi"))
    rest = F.expr(f"slice({vector}, i + 1, greatest(size({vector}) - i, 0))") if upper else F.col(vector)
    two = one.select(key, *keep, "i", "xi", F.posexplode(rest).alias("_j", "xj"))
    return two.select(key, *keep, "i", (F.col("_j") + (F.col("i") if upper else 0)).cast("int").alias("j"), F.col("xi").cast("double").alias("xi"), F.col("xj").cast("double").alias("xj"))


def second_moment(p: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """About zero: sum w xi xj / sum w."""
    w = F.lit(1.0) if weight is None else weight
    return p.groupBy(key, "i", "j").agg((F.sum(w * F.col("xi") * F.col("xj")) / F.sum(w)).alias("value"))


def both_triangles(m: DataFrame, key: str) -> DataFrame:
    return m.select(key, "i", "j", "value").union(m.where("i <> j").select(key, F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def correlation(m: DataFrame, key: str) -> DataFrame:
    """value / sqrt(value_ii value_jj), the diagonal exactly one."""
    d = m.where("i = j").select(key, "i", F.col("value").alias("vi"))
    e = d.select(key, F.col("i").alias("j"), F.col("vi").alias("vj"))
    r = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.try_divide("value", F.sqrt(F.col("vi") * F.col("vj"))))
    return m.join(d, [key, "i"]).join(e, [key, "j"]).select(key, "i", "j", r.alias("value"))


def lagged(df: DataFrame, key: str, order: str, x: str, lag: int) -> Column:
    return F.lag(x, lag).over(Window.partitionBy(key).orderBy(order))


def newey_west_variance(df: DataFrame, key: str, order: str, x: str, half_life: float, lags: int) -> DataFrame:
    """Decayed variance about zero plus Bartlett-weighted autocovariances; falls back to the plain one if not positive.

    A lag pair takes the newer row's weight and is normalised by the weights of the pairs that exist.
    """
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("_rn", F.row_number().over(w)).withColumn("_w", F.pow(F.lit(2.0), F.col("_rn") / float(half_life)))
    for k in range(1, lags + 1):
        d = d.withColumn(f"_l{k}", F.lag(x, k).over(w))
    terms = [(F.sum(F.col("_w") * F.col(x) * F.col(x)) / F.sum("_w")).alias("c0")]
    for k in range(1, lags + 1):
        has = F.when(F.col(f"_l{k}").isNotNull(), F.col("_w"))
        terms.append(F.try_divide(F.sum(has * F.col(x) * F.col(f"_l{k}")), F.sum(has)).alias(f"c{k}"))
    c = d.groupBy(key).agg(*terms)
    total = F.col("c0")
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(f"c{k}", F.lit(0.0))
    return c.select(key, F.col("c0").alias("plain"), F.when(total > 0, total).otherwise(F.col("c0")).alias("variance"), (total <= 0).alias("fell_back"))
