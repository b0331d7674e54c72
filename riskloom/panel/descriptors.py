"""Nine raw descriptors of every asset and session as one panel, and the six exposures made of them.

Raw descriptors are windows over an asset's rows, so all of them share one shuffle by asset; exposures
are windows over a session's rows and share one by date. Windows are complete or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import windows as W
from .. import xsection as X

RAW = ["beta", "hsigma", "dastd", "rstr", "cmra", "stom", "stoq", "stoa", "lncap"]
#: Names that a session needs for an orthogonalised exposure.
LEAST_NAMES = 5
FACTORS = ["BETA", "MOMENTUM", "SIZE", "NLSIZE", "RESVOL", "LIQUIDITY"]


def raw_descriptors(df: DataFrame, beta_rows: int, sd_rows: int, momentum_rows: int, half_life: float, lag: int, months: int, month_rows: int, turnover_rows: tuple[int, int, int]) -> DataFrame:
    """(asset, date, cap, raw descriptors) of ``df`` (asset, date, r, m, volume, shares, cap), whose rows all have r and m.

    beta and hsigma: decayed regression of r on m; dastd: decayed sd; rstr: decayed mean, ``lag`` rows
    old; cmra: range of the cumulative returns of 1 to ``months`` months; stom, stoq, stoa: logarithm of
    mean turnover; lncap: logarithm of the cap.
    """
    rows = W.numbered(df, "asset")
    b = W.decay_beta(rows, "asset", "date", "r", "m", half_life, beta_rows)
    by = Window.partitionBy("asset").orderBy("date")
    t42, t40 = W.trailing("asset", sd_rows), W.trailing("asset", momentum_rows)
    whole = lambda value, w, n: F.when(F.count(F.lit(1)).over(w) == n, value)
    turn = lambda n: whole(F.log(F.when(F.avg(F.col("volume") / F.col("shares")).over(W.trailing("asset", n)) > 0, F.avg(F.col("volume") / F.col("shares")).over(W.trailing("asset", n)))), W.trailing("asset", n), n)
    d = b.select(
        "asset", "date", "cap", "beta", F.col("resid").alias("hsigma"),
        whole(W.decay_sd(F.col("r"), half_life, t42), t42, sd_rows).alias("dastd"),
        whole(W.decay_mean(F.col("r"), half_life, t40), t40, momentum_rows).alias("_s"),
        F.sum("r").over(W.expanding("asset")).alias("_c"),
        *(turn(n).alias(c) for c, n in zip(("stom", "stoq", "stoa"), turnover_rows, strict=True)),
        F.log(F.when(F.col("cap") > 0, F.col("cap"))).alias("lncap"),
    )
    ranges = [F.col("_c") - F.lag("_c", month_rows * k).over(by) for k in range(1, months + 1)]
    d = d.withColumn("rstr", F.lag("_s", lag).over(by)).withColumns({f"_z{k}": z for k, z in enumerate(ranges)})
    cols = [f"_z{k}" for k in range(months)]
    return d.withColumn("cmra", F.when(F.col(cols[-1]).isNotNull(), F.greatest(*cols) - F.least(*cols))).select("asset", "date", "cap", *RAW)


def _composite(parts: dict[str, float]) -> Column:
    """Weighted sum of standardised descriptors, null if one is."""
    total = None
    for c, w in parts.items():
        total = F.col(c) * w if total is None else total + F.col(c) * w
    return total


def exposures(raw: DataFrame, bound: float, resvol: dict[str, float], liquidity: dict[str, float]) -> DataFrame:
    """(asset, date, FACTORS): winsorised and standardised by session over the assets with a cap, composed and orthogonalised.

    NLSIZE is the cube of SIZE without SIZE; RESVOL is without BETA and SIZE (one after the other, on
    rows that have all three); both are null in a session with fewer than ``LEAST_NAMES`` names. Regression
    weights are the root of the cap.
    """
    d = raw.where("cap > 0")
    for c in RAW:
        d = d.withColumn(c, X.winsorise(F.col(c), bound))
        d = d.withColumn(c, X.standardise(F.col(c), F.col("cap")))
    d = d.withColumn("_v", _composite(resvol)).withColumn("_l", _composite(liquidity))
    d = d.withColumn("_v", X.standardise(F.col("_v"), F.col("cap"))).withColumn("LIQUIDITY", X.standardise(F.col("_l"), F.col("cap")))
    g = F.sqrt("cap")
    d = d.withColumn("_n", X.orthogonalise(F.pow("lncap", F.lit(3.0)), F.col("lncap"), g))
    d = d.withColumn("_n", X.winsorise(F.col("_n"), bound))
    # A fit that leaves no residual freedom would standardise rounding errors.
    day = Window.partitionBy("date")
    d = d.withColumn("_n", F.when(F.count("lncap").over(day) >= LEAST_NAMES, F.col("_n")))
    all_three = F.col("_v").isNotNull() & F.col("beta").isNotNull() & F.col("lncap").isNotNull()
    d = d.withColumn("_k", F.count(F.when(all_three, 1)).over(day))
    all_three = all_three & (F.col("_k") >= LEAST_NAMES)
    d = d.withColumn("_y", F.when(all_three, F.col("_v"))).withColumn("_b", F.when(all_three, F.col("beta"))).withColumn("_x", F.when(all_three, F.col("lncap")))
    d = d.withColumn("_y1", X.orthogonalise(F.col("_y"), F.col("_x"), g)).withColumn("_b1", X.orthogonalise(F.col("_b"), F.col("_x"), g))
    d = d.withColumn("_r", X.orthogonalise(F.col("_y1"), F.col("_b1"), g))
    return d.select("asset", "date", F.col("beta").alias("BETA"), F.col("rstr").alias("MOMENTUM"), F.col("lncap").alias("SIZE"), X.standardise(F.col("_n"), F.col("cap")).alias("NLSIZE"), X.standardise(F.col("_r"), F.col("cap")).alias("RESVOL"), "LIQUIDITY")
