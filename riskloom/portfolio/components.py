"""A book's return and forecast variance split into factor and specific parts by month, and the contracts that hold them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ContractError
from ..risk.normal import quantile


def component_split(held: DataFrame, exposures: DataFrame, factors: DataFrame, covariance: DataFrame, specific: DataFrame, asset: str = "asset", month: str = "month", date: str = "date") -> DataFrame:
    """One row a month: days, portfolio, factor, specific, regression, factor_variance, specific_variance, total_variance.

    ``held`` has month, date, asset, w, r and e (the regression's residual); a missing r or e counts as zero.
    ``exposures`` has asset, month, i and x; ``factors`` date, i and f; ``covariance`` month, i, j and value in
    both triangles, a day's; ``specific`` asset, month and variance, a day's. ``specific`` of the return is
    what factors leave, ``regression`` what the residuals say; the gap between them is drift of exposures.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    books = held.select(month, asset, "w").distinct()
    loads = books.join(exposures.select(asset, month, "i", "x"), [asset, month]).groupBy(month, "i").agg(F.sum(F.col("w") * F.col("x")).alias("b"))
    daily = held.groupBy(month, date).agg(F.sum(F.col("w") * zero(F.col("r"))).alias("p"), F.sum(F.col("w") * zero(F.col("e"))).alias("u"))
    by_factor = daily.select(month, date).join(factors, date).join(loads, [month, "i"]).groupBy(month).agg(F.sum(F.col("b") * F.col("f")).alias("factor"))
    total = daily.groupBy(month).agg(F.count(F.lit(1)).alias("days"), F.sum("p").alias("portfolio"), F.sum("u").alias("regression"))
    other = loads.select(month, F.col("i").alias("j"), F.col("b").alias("c"))
    fvar = loads.join(covariance, [month, "i"]).join(other, [month, "j"]).groupBy(month).agg(F.sum(F.expr("b * c * value")).alias("_f"))
    svar = books.join(specific.select(asset, month, "variance"), [asset, month]).groupBy(month).agg(F.sum(F.expr("w * w * variance")).alias("_s"))
    d = total.join(by_factor, month, "left").join(fvar, month, "left").join(svar, month, "left").withColumn("factor", zero(F.col("factor")))
    d = d.withColumn("factor_variance", F.col("days") * zero(F.col("_f"))).withColumn("specific_variance", F.col("days") * zero(F.col("_s")))
    return d.select(month, "days", "portfolio", "factor", (F.col("portfolio") - F.col("factor")).alias("specific"), "regression", "factor_variance", "specific_variance", (F.col("factor_variance") + F.col("specific_variance")).alias("total_variance"))


def broken_identities(split: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Rows whose parts don't add up to ``tolerance`` of their size, or that hold a null or negative variance; with ``reason``."""
    off = lambda total, a, b: F.abs(F.col(total) - F.col(a) - F.col(b)) > tolerance * F.greatest(F.abs(F.col(a)), F.abs(F.col(b)), F.lit(1e-300))
    holes = F.lit(False)
    for c in ("portfolio", "factor", "specific", "factor_variance", "specific_variance", "total_variance"):
        holes = holes | F.col(c).isNull() | F.isnan(c)
    reason = F.when(holes, "missing").when(off("portfolio", "factor", "specific"), "return").when(off("total_variance", "factor_variance", "specific_variance"), "variance").when((F.col("factor_variance") < 0) | (F.col("specific_variance") < 0), "negative variance")
    return split.withColumn("reason", reason).where("reason IS NOT NULL")


def require_identities(split: DataFrame, month: str = "month", tolerance: float = 1e-12) -> DataFrame:
    """``split``; ContractError naming the first broken rows if there are any."""
    bad = broken_identities(split, tolerance).orderBy(month).select(month, "reason").limit(5).collect()
    if bad:
        raise ContractError("components don't add up: " + ", ".join(f"{r[0]} ({r[1]})" for r in bad))
    return split


def _chi_square_root(p: Column, n: Column) -> Column:
    """sqrt(chi^2 quantile / n) by the Wilson-Hilferty cube, to about 1e-3 from ten degrees on."""
    k = 2.0 / (9.0 * n)
    return F.sqrt(F.pow(F.greatest(1 - k + quantile(p) * F.sqrt(k), F.lit(0.0)), 3))


def reconcile(split: DataFrame, level: float = 0.95, strict: bool = False) -> DataFrame:
    """(component, periods, bias, low, high, inside): root mean square of each component's return over its forecast, against its interval.

    ``strict`` raises ContractError where a component lies outside.
    """
    parts = (("factor", "factor", "factor_variance"), ("specific", "specific", "specific_variance"), ("total", "portfolio", "total_variance"))
    one = split.select(F.explode(F.array(*(F.struct(F.lit(n).alias("component"), F.try_divide(F.col(r) * F.col(r), F.when(F.col(v) > 0, F.col(v))).alias("z2")) for n, r, v in parts))).alias("c")).select("c.*").where("z2 IS NOT NULL")
    b = one.groupBy("component").agg(F.count(F.lit(1)).alias("periods"), F.sqrt(F.avg("z2")).alias("bias"))
    n = F.col("periods").cast("double")
    tail = (1 - level) / 2
    out = b.withColumn("low", _chi_square_root(F.lit(tail), n)).withColumn("high", _chi_square_root(F.lit(1 - tail), n)).withColumn("inside", F.col("bias").between(F.col("low"), F.col("high")))
    if strict:
        bad = [r for r in out.where("NOT inside").collect()]
        if bad:
            raise ContractError("; ".join(f"{r.component}: bias {r.bias:.3f} outside [{r.low:.3f}, {r.high:.3f}] at {r.periods} periods" for r in bad))
    return out
