"""The covariance job as a chain of stages, and the overfitting test by half splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import moments as M
from .. import solve as S


def lag_pairs(vectors: DataFrame, key: str, lag: int) -> DataFrame:
    """(key, rn, i, j, xi, xj) of each row with the row ``lag`` before it."""
    v = vectors.withColumn("_p", F.lag("v", lag).over(Window.partitionBy(key).orderBy("rn"))).where("_p IS NOT NULL")
    one = v.select(key, "rn", "_p", F.posexplode("v").alias("i", "xi"))
    return one.select(key, "rn", "i", "xi", F.posexplode("_p").alias("j", "xj"))


def decay(half_life: float) -> Column:
    return F.pow(F.lit(2.0), F.col("rn") / float(half_life))


def ewma(vectors: DataFrame, key: str, half_life: float) -> DataFrame:
    """Decayed second moment, both triangles."""
    return M.both_triangles(M.second_moment(M.pairs(vectors, key, "v", ["rn"]), key, decay(half_life)), key)


def newey_west(vectors: DataFrame, key: str, half_life: float, lags: int) -> DataFrame:
    """Decayed moment plus Bartlett-weighted lagged moments and their transposes; pairs carry the newer row's weight."""
    parts = ewma(vectors, key, half_life).withColumn("share", F.lit(1.0))
    for k in range(1, lags + 1):
        p = lag_pairs(vectors, key, k)
        c = p.groupBy(key, "i", "j").agg((F.sum(decay(half_life) * F.col("xi") * F.col("xj")) / F.sum(decay(half_life))).alias("value"))
        both = c.union(c.select(key, F.col("j").alias("i"), F.col("i").alias("j"), "value"))
        parts = parts.union(both.withColumn("share", F.lit(1 - k / (lags + 1))))
    return parts.groupBy(key, "i", "j").agg(F.sum(F.col("share") * F.col("value")).alias("value"))


def newey_west_two(vectors: DataFrame, key: str, variance_half_life: float, correlation_half_life: float, lags: int) -> DataFrame:
    """(key, i, j, value, fell_back): variances and correlations corrected apart, each at a half-life of its own.

    A variance that the correction doesn't leave positive gives way to the plain decayed one, and a
    pair with such a side at the correlation's half-life to the plain correlation; ``fell_back`` tells
    rows with either. Both triangles; a pair whose plain variance is zero has no correlation and is null.
    """
    def diagonal(m: DataFrame, name: str, side: str) -> DataFrame:
        return m.where("i = j").select(key, F.col("i").alias(side), F.col("value").alias(name))

    own, plain_own = newey_west(vectors, key, variance_half_life, lags), ewma(vectors, key, variance_half_life)
    corrected, plain = newey_west(vectors, key, correlation_half_life, lags), ewma(vectors, key, correlation_half_life)
    d = corrected.join(plain.withColumnRenamed("value", "plain"), [key, "i", "j"])
    for side in ("i", "j"):
        for name, m in (("c", corrected), ("p", plain), ("v", own), ("w", plain_own)):
            d = d.join(diagonal(m, f"{name}{side}", side), [key, side])
    good = F.expr("ci > 0 AND cj > 0")
    root = lambda a, b: F.sqrt(F.when(F.col(a) * F.col(b) > 0, F.col(a) * F.col(b)))
    r = F.when(F.col("i") == F.col("j"), 1.0).when(good, F.col("value") / root("ci", "cj")).otherwise(F.try_divide(F.col("plain"), root("pi", "pj")))
    sd = [F.sqrt(F.expr(f"if(v{s} > 0, v{s}, w{s})")) for s in ("i", "j")]
    return d.select(key, "i", "j", (r * sd[0] * sd[1]).alias("value"), (~good | F.expr("vi <= 0 OR vj <= 0")).alias("fell_back"))


def repaired(matrices: DataFrame) -> DataFrame:
    return matrices.withColumn("cells", S.floored()("n", "cells"))


def eigen_adjusted(matrices: DataFrame) -> DataFrame:
    """Eigenvalues scaled by the matrix's ``curve`` (one number an eigenvalue), or left alone without one."""
    if "curve" not in matrices.columns:
        matrices = matrices.withColumn("curve", F.transform(F.sequence(F.lit(1), F.col("n")), lambda _: F.lit(1.0)))
    return matrices.withColumn("cells", S.eigen_scaled()("n", "cells", "curve"))


def scaled(multiplier: float) -> Callable[[DataFrame], DataFrame]:
    return lambda m: m.withColumn("cells", F.transform("cells", lambda c: c * multiplier**2))


def covariance_job(vectors: DataFrame, key: str, half_life: float = 84, lags: int = 2, multiplier: float = 1.0) -> dict[str, DataFrame]:
    """All stages by name, one matrix row a key; a stage that nobody reads is never run."""
    out = {"ewma": S.matrix_rows(ewma(vectors, key, half_life), key)}
    out["newey_west"] = S.matrix_rows(newey_west(vectors, key, half_life, lags), key)
    out["psd_repair"] = out["newey_west"].transform(repaired)
    out["eigenfactor"] = out["psd_repair"].transform(eigen_adjusted)
    out["volatility_regime"] = out["eigenfactor"].transform(scaled(multiplier))
    return out


def half_splits(r: DataFrame, trial: str, blocks: int = 8) -> DataFrame:
    """(split, trial, inside, outside): mean over sd in the chosen half of the blocks and in the other.

    ``r`` has trial, block, r. Block sums are made once; a split is a bit mask with half its bits set.
    """
    b = r.groupBy(trial, "block").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    masks = r.sparkSession.range(1 << blocks).where(F.bit_count("id") == blocks // 2).withColumnRenamed("id", "split")
    x = b.crossJoin(masks).withColumn("in", F.expr("(shiftright(split, cast(block as int)) & 1) = 1"))

    def ratio(side: Column) -> Column:
        n, s, q = (F.sum(F.when(side, F.col(c))) for c in ("n", "s", "q"))
        return F.try_divide(s / n, F.sqrt(F.greatest((q - s * s / n) / F.when(n > 1, n - 1), F.lit(0.0))))

    return x.groupBy("split", trial).agg(ratio(F.col("in")).alias("inside"), ratio(~F.col("in")).alias("outside"))


def overfitting(splits: DataFrame, trial: str) -> DataFrame:
    """By split: the best trial inside (the first of equal ones), and its middle rank outside as a share of (trials + 1)."""
    w = Window.partitionBy("split")
    known = splits.where("inside IS NOT NULL AND outside IS NOT NULL")
    ties = F.count(F.lit(1)).over(Window.partitionBy("split", "outside"))
    ranked = known.withColumn("rank", F.rank().over(w.orderBy("outside")) + (ties - 1) / 2).withColumn("trials", F.count(F.lit(1)).over(w))
    return ranked.groupBy("split").agg(F.max_by(F.struct(trial, "rank", "trials", "outside"), F.struct("inside", -F.col(trial))).alias("b")).select("split", F.col(f"b.{trial}").alias("best"), (F.col("b.rank") / (F.col("b.trials") + 1)).alias("share"), F.col("b.outside").alias("outside"))
