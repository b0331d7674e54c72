"""Queries over linked residuals and component splits: suppliers as assets, cap-weighted monthly books, one market factor."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import market, query, returns, rnd, table
from .portfolio import components as C
from .portfolio import linked as L
from .queries_specific import _RES, residuals

_MOST = 8
_LINKS = f""", ord AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS a FROM lineitem), few AS (SELECT o FROM ord GROUP BY 1 HAVING count(*) BETWEEN 2 AND {_MOST}),
lk AS (SELECT DISTINCT x.a AS i, y.a AS j FROM ord x JOIN few ON few.o = x.o JOIN ord y ON y.o = x.o AND x.a < y.a),
dt AS (SELECT date, pow(2.0, -(row_number() OVER (ORDER BY date DESC) - 1) / 126.0) AS g FROM (SELECT DISTINCT date FROM res)), re AS (SELECT res.*, g FROM res JOIN dt ON dt.date = res.date),
pc AS (SELECT i, j, count(*) AS days, sum(x.g * x.e * y.e) AS c, sum(x.g * x.e * x.e) AS a, sum(x.g * y.e * y.e) AS b FROM lk JOIN re x ON x.asset = i JOIN re y ON y.asset = j AND y.date = x.date GROUP BY 1, 2),
pr AS (SELECT i, j, days, CASE WHEN a * b > 0 THEN c / sqrt(a * b) END AS value FROM pc)"""


def _links(spark, d):
    """Suppliers that share an order with at most eight suppliers."""
    return L.shared_pairs(table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("asset")), "l_orderkey", "asset", _MOST)


def _correlations(spark, d):
    most = table(spark, d, "lineitem").count()  # a residual comes from one line at least
    return L.pair_correlation(L.decayed(residuals(spark, d, True), "date", 126.0), _links(spark, d), "asset", "date", "e", "g", most)


@query("q_linked_correlation", f"WITH {_RES}{_LINKS} SELECT i, j, days, round(value, 4) + 0.0 AS value FROM pr")
def linked_correlation(spark, d):
    """Decayed correlation of the residuals of linked suppliers, linked pairs only."""
    return _correlations(spark, d).select("i", "j", "days", rnd("value", 4).alias("value"))


@query("q_linked_variance", f"""WITH {_RES}{_LINKS}, sd AS (SELECT asset, sqrt(avg(e * e)) AS sd FROM res GROUP BY 1), bk AS (SELECT CAST(date_trunc('year', date) AS DATE) AS year, asset, sum(cap) AS v FROM res GROUP BY 1, 2), bw AS (SELECT year, bk.asset, v / sum(v) OVER (PARTITION BY year) * sd AS s FROM bk JOIN sd ON sd.asset = bk.asset),
 di AS (SELECT year, sum(s * s) AS diagonal FROM bw GROUP BY 1), od AS (SELECT x.year, 2 * sum(x.s * y.s * value) AS linked FROM pr JOIN bw x ON x.asset = pr.i JOIN bw y ON y.asset = pr.j AND y.year = x.year GROUP BY 1)
 SELECT di.year, round(diagonal, 7) AS diagonal, round(coalesce(linked, 0), 7) + 0.0 AS linked, round(diagonal + coalesce(linked, 0), 7) AS variance FROM di LEFT JOIN od ON od.year = di.year""")
def linked_variance(spark, d):
    """Specific variance of each year's cap-weighted book: the diagonal, and what linked suppliers put off it."""
    r = residuals(spark, d, True)
    sd = r.groupBy("asset").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("sd"))
    v = r.groupBy(F.trunc("date", "year").alias("year"), "asset").agg(F.sum("cap").alias("v"))
    whole = v.groupBy("year").agg(F.sum(F.when(F.col("asset").isNotNull(), F.col("v"))).alias("_all")).where("_all IS NOT NULL")  # lines without a supplier are in no book
    books = v.join(whole, "year").select("year", "asset", (F.col("v") / F.col("_all")).alias("w"))
    out = L.linked_variance(books, sd, _correlations(spark, d), "year", "asset")
    return out.select("year", *(rnd(c, 7).alias(c) for c in ("diagonal", "linked", "variance")))


_SPLIT = (
    _RES
    + """, mr AS (SELECT DISTINCT date, CAST(date_trunc('month', date) AS DATE) AS month, m FROM mkt WHERE m IS NOT NULL), rr AS (SELECT r.asset, r.date, CAST(date_trunc('month', r.date) AS DATE) AS month, r.r, m.m, r.cap FROM rets r JOIN mkt m ON m.date = r.date WHERE r.r IS NOT NULL AND m.m IS NOT NULL),
be AS (SELECT asset, regr_slope(r, m) AS beta, count(*) AS k, var_pop(r) - pow(regr_slope(r, m), 2) * var_pop(m) AS own FROM rr GROUP BY 1 HAVING regr_slope(r, m) IS NOT NULL),
bk AS (SELECT month, asset, sum(cap) AS v FROM rr WHERE asset IN (SELECT asset FROM be) GROUP BY 1, 2), bw AS (SELECT month, asset, v / sum(v) OVER (PARTITION BY month) AS w FROM bk),
dy AS (SELECT bw.month, rr.date, sum(w * rr.r) AS p, sum(w * (rr.r - beta * rr.m)) AS u FROM bw JOIN be ON be.asset = bw.asset JOIN rr ON rr.asset = bw.asset AND rr.month = bw.month GROUP BY 1, 2),
ld AS (SELECT month, sum(w * beta) AS b, sum(w * w * greatest(own, 0)) AS s FROM bw JOIN be ON be.asset = bw.asset GROUP BY 1), fv AS (SELECT avg(m * m) AS f FROM mr),
sp AS (SELECT dy.month, count(*) AS days, sum(p) AS portfolio, sum(b * m) AS factor, sum(p) - sum(b * m) AS specific, sum(u) AS regression, count(*) * max(b * b * f) AS factor_variance, count(*) * max(s) AS specific_variance FROM dy JOIN ld ON ld.month = dy.month JOIN mr ON mr.date = dy.date, fv GROUP BY 1)"""
)


def _split(spark, d):
    x = returns(spark, d)
    m = market(x).where("m IS NOT NULL").select("date", "m")
    rr = x.join(m, "date").where("r IS NOT NULL").select("asset", "date", F.trunc("date", "MM").alias("month"), "r", "m", "cap")
    beta = rr.groupBy("asset").agg(F.regr_slope("r", "m").alias("beta"), F.var_pop("r").alias("_v"), F.var_pop("m").alias("_m")).where("beta IS NOT NULL")
    beta = beta.select("asset", "beta", F.greatest(F.col("_v") - F.col("beta") * F.col("beta") * F.col("_m"), F.lit(0.0)).alias("own"))
    v = rr.join(beta.select("asset"), "asset").groupBy("month", "asset").agg(F.sum("cap").alias("v"))
    w = v.join(v.groupBy("month").agg(F.sum("v").alias("_all")), "month").select("month", "asset", (F.col("v") / F.col("_all")).alias("w"))
    held = rr.join(w, ["month", "asset"]).join(beta, "asset").select("month", "date", "asset", "w", "r", (F.col("r") - F.col("beta") * F.col("m")).alias("e"))
    exposures = w.join(beta, "asset").select("asset", "month", F.lit(0).alias("i"), F.col("beta").alias("x"))
    specific = w.join(beta, "asset").select("asset", "month", F.col("own").alias("variance"))
    months = w.select("month").distinct()
    cov = months.crossJoin(F.broadcast(m.agg(F.avg(F.col("m") * F.col("m")).alias("value")))).select("month", F.lit(0).alias("i"), F.lit(0).alias("j"), "value")  # one row
    return C.component_split(held, exposures, m.select("date", F.lit(0).alias("i"), F.col("m").alias("f")), cov, specific)


@query("q_component_split", f"WITH {_SPLIT} SELECT month, days, round(portfolio, 5) + 0.0 AS portfolio, round(factor, 5) + 0.0 AS factor, round(specific, 5) + 0.0 AS specific, round(regression, 5) + 0.0 AS regression, round(factor_variance, 6) AS factor_variance, round(specific_variance, 6) AS specific_variance, round(factor_variance + specific_variance, 6) AS total_variance FROM sp")
def component_split(spark, d):
    """Each month's book: return and forecast variance, from the factor and specific."""
    s = _split(spark, d)
    return s.select("month", "days", *(rnd(c).alias(c) for c in ("portfolio", "factor", "specific", "regression")), *(rnd(c, 6).alias(c) for c in ("factor_variance", "specific_variance", "total_variance")))


@query("q_component_identity", f"WITH {_SPLIT} SELECT count(*) AS months, CAST(0 AS BIGINT) AS broken FROM sp")
def component_identity(spark, d):
    """Months, and those whose parts don't add up to 1e-12."""
    s = _split(spark, d)
    return s.agg(F.count(F.lit(1)).alias("months")).crossJoin(C.broken_identities(s).agg(F.count(F.lit(1)).alias("broken")))  # one row each


@query("q_reconciled", f"WITH {_SPLIT}, z AS (SELECT 'factor' AS component, factor * factor / factor_variance AS z2 FROM sp WHERE factor_variance > 0 UNION ALL SELECT 'specific', specific * specific / specific_variance FROM sp WHERE specific_variance > 0 UNION ALL SELECT 'total', portfolio * portfolio / (factor_variance + specific_variance) FROM sp WHERE factor_variance + specific_variance > 0),"
       " b AS (SELECT component, count(*) AS periods, sqrt(avg(z2)) AS bias FROM z GROUP BY 1), i AS (SELECT *, sqrt(pow(greatest(1 - 2.0 / (9 * periods) - 1.959963984540054 * sqrt(2.0 / (9 * periods)), 0), 3)) AS low, sqrt(pow(1 - 2.0 / (9 * periods) + 1.959963984540054 * sqrt(2.0 / (9 * periods)), 3)) AS high FROM b)"
       " SELECT component, periods, round(bias, 4) AS bias, round(low, 4) AS low, round(high, 4) AS high, bias BETWEEN low AND high AS inside FROM i")
def reconciled(spark, d):
    """Bias of factor, specific and total against its interval."""
    return C.reconcile(_split(spark, d)).select("component", "periods", *(rnd(c, 4).alias(c) for c in ("bias", "low", "high")), "inside")


