"""Queries over specific risk: residuals of suppliers' returns on the market, month ends, one exposure (the logarithm of the month's value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import specific as S
from .base import MARKET, market, query, returns, rnd

_VOL, _LAG, _LAGS, _FLOOR, _Q, _REGIME = 42.0, 84.0, 2, 40, 0.1, 6.0


def residuals(spark, d, together=False):
    """Returns over the market's; ``together`` keeps them where their supplier's lines are (see ``bars``), and the market, a row a date, goes there."""
    r = returns(spark, d, together)
    m = market(r).select("date", "m")
    return r.join(F.broadcast(m) if together else m, "date").where("r IS NOT NULL AND m IS NOT NULL").select("asset", "date", F.trunc("date", "MM").alias("month"), (F.col("r") - F.col("m")).alias("e"), "cap", "trades")


def exposures(spark, d):
    return residuals(spark, d).groupBy("asset", "month").agg(F.log(F.sum("cap")).alias("size"), F.sum("trades").alias("_t")).select("asset", "month", (F.col("asset") % 7).cast("int").alias("bucket"), "size")


_RES = MARKET + ", res AS (SELECT r.asset, r.date, CAST(date_trunc('month', r.date) AS DATE) AS month, r.r - m.m AS e, r.cap FROM rets r JOIN mkt m ON m.date = r.date WHERE r.r IS NOT NULL AND m.m IS NOT NULL)"
_D = {"g": f"pow(2.0, k / {_VOL})", "h": f"pow(2.0, k / {_LAG})"}
_TS = (
    _RES
    + f""", lg AS (SELECT *, row_number() OVER w AS k, lag(e, 1) OVER w AS l1, lag(e, 2) OVER w AS l2, row_number() OVER (PARTITION BY asset, month ORDER BY date DESC) AS back FROM res WINDOW w AS (PARTITION BY asset ORDER BY date)),
run AS (SELECT asset, month, back, count(*) OVER w AS n, sum(CAST(e <> 0 AS INTEGER)) OVER w AS seen, sum({_D['g']} * e * e) OVER w / sum({_D['g']}) OVER w AS plain,
 sum({_D['h']} * e * l1) OVER w / sum(CASE WHEN l1 IS NOT NULL THEN {_D['h']} END) OVER w AS c1, sum({_D['h']} * e * l2) OVER w / sum(CASE WHEN l2 IS NOT NULL THEN {_D['h']} END) OVER w AS c2 FROM lg WINDOW w AS (PARTITION BY asset ORDER BY k)),
ts AS (SELECT asset, month, n, seen, plain, plain + 2 * (2.0 / 3) * coalesce(c1, 0) + 2 * (1.0 / 3) * coalesce(c2, 0) AS total FROM run WHERE back = 1)"""
)
_FIT = (
    _TS
    + f""", x AS (SELECT asset, month, asset % 7 AS bucket, ln(sum(cap)) AS size FROM res GROUP BY 1, 2),
own AS (SELECT x.*, ts.n, CASE WHEN ts.n >= {_FLOOR} AND ts.seen > 0 THEN sqrt(CASE WHEN total > 0 THEN total WHEN plain > 0 THEN plain END) END AS series FROM x LEFT JOIN ts ON ts.asset = x.asset AND ts.month = x.month),
co AS (SELECT month, count(series) AS fitted_rows, regr_slope(ln(series), size) AS b, regr_intercept(ln(series), size) AS a, regr_r2(ln(series), size) AS r2 FROM own GROUP BY 1),
raw AS (SELECT own.*, co.fitted_rows, co.r2, CASE WHEN fitted_rows > 2 THEN exp(a + b * size) END AS raw FROM own JOIN co ON co.month = own.month),
ez AS (SELECT month, sum(CASE WHEN series IS NOT NULL THEN series END) / sum(CASE WHEN series IS NOT NULL THEN raw END) AS e_zero FROM raw GROUP BY 1)"""
)
_RISK = (
    _FIT
    + f""", bl AS (SELECT raw.*, e_zero * raw AS model, coalesce(series, e_zero * raw) AS blended FROM raw JOIN ez ON ez.month = raw.month),
st AS (SELECT month, bucket, avg(blended) AS mean, stddev_pop(blended) AS sd FROM bl GROUP BY 1, 2),
wt AS (SELECT bl.*, mean, CASE WHEN abs(blended - mean) + {_Q} * sd > 0 THEN abs(blended - mean) / (abs(blended - mean) + {_Q} * sd) ELSE 1.0 END AS weight FROM bl JOIN st ON st.month = bl.month AND st.bucket = bl.bucket),
sh AS (SELECT *, weight * blended + (1 - weight) * mean AS shrunk FROM wt),
sc AS (SELECT r.month, avg(pow(r.e / f.shrunk, 2)) AS b FROM res r JOIN sh f ON f.asset = r.asset AND r.month = f.month + INTERVAL 1 MONTH WHERE f.shrunk > 0 GROUP BY 1),
mo AS (SELECT m.month, sc.b, row_number() OVER (ORDER BY m.month) AS k FROM (SELECT DISTINCT month FROM sh) m LEFT JOIN sc ON sc.month = m.month),
mu AS (SELECT month, coalesce(sqrt(sum(CASE WHEN b IS NOT NULL THEN pow(2.0, k / {_REGIME}) * b END) OVER w / sum(CASE WHEN b IS NOT NULL THEN pow(2.0, k / {_REGIME}) END) OVER w), 1.0) AS multiplier FROM mo WINDOW w AS (ORDER BY k))"""
)


@query("v_specific_series", f"WITH {_TS} SELECT asset, month, n, round(plain, 6) AS plain, round(CASE WHEN total > 0 THEN total ELSE plain END, 6) AS variance, total <= 0 AS fell_back FROM ts")
def specific_series(spark, d):
    """Decayed variance of residuals at each month end, lags at a half-life of their own."""
    t = S.time_series(residuals(spark, d), "asset", "date", "month", "e", _VOL, _LAG, _LAGS)
    return t.select("asset", "month", "n", rnd("plain", 6).alias("plain"), rnd("variance", 6).alias("variance"), "fell_back")


@query("v_structural_fit", f"WITH {_FIT} SELECT DISTINCT raw.month, fitted_rows, CASE WHEN fitted_rows > 2 THEN round(r2, 5) END AS r2, round(e_zero, 5) AS e_zero FROM raw JOIN ez ON ez.month = raw.month")
def structural_fit(spark, d):
    """By month the fit of ln volatility on size over assets with enough rows, and the constant that takes the bias of logarithms away."""
    ts = S.time_series(residuals(spark, d), "asset", "date", "month", "e", _VOL, _LAG, _LAGS)
    x = exposures(spark, d).join(ts, ["asset", "month"], "left").withColumn("series", F.when((F.col("n") >= _FLOOR) & (F.col("seen") > 0), F.sqrt("variance")))
    s = S.structural(x, "month", "series", ["size"], F.col("series").isNotNull())
    return s.select("month", "fitted_rows", rnd("r2").alias("r2"), rnd("e_zero").alias("e_zero")).distinct()


@query("v_specific_risk", f"WITH {_RISK} SELECT asset, sh.month, bucket, n, round(series, 5) AS series, round(model, 5) AS structural, round(blended, 5) AS blended, round(shrunk, 5) AS shrunk, round(multiplier, 5) AS multiplier, round(shrunk * multiplier, 5) AS risk FROM sh JOIN mu ON mu.month = sh.month")
def specific_risk(spark, d):
    """Volatility of each asset at each month end: its own or structural, shrunk to its bucket, times the regime's multiplier."""
    r = S.specific_risk(residuals(spark, d).select("asset", "date", "month", "e"), exposures(spark, d), "asset", "date", "month", "e", ["size"], "bucket", _VOL, _LAG, _LAGS, _FLOOR, _Q, _REGIME)
    return r.select("asset", "month", "bucket", "n", *(rnd(c).alias(c) for c in ("series", "structural", "blended", "shrunk", "multiplier", "risk")))
