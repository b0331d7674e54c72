"""Queries over risk statistics, regressions, books and attribution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import book as K
from . import moments as M
from . import regress as G
from .base import BARS, MARKET, RETURNS, bars, corr, market, query, returns, rnd, table
from .panel import month
from .queries_moments import _Z, _scores



def _by():
    return Window.partitionBy("asset").orderBy("date")
_ROLL = lambda n: f"OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _with_market(spark, d):
    r = returns(spark, d)
    return r.where("r IS NOT NULL").join(market(r), "date").select("asset", "date", "r", "m", "cap", "volume", "close")


_RM = MARKET + ", rm AS (SELECT asset, rets.date, r, m, cap, volume, close FROM rets JOIN mkt ON rets.date = mkt.date WHERE r IS NOT NULL)"


@query("k_weighted_quantiles", f"""WITH {BARS}, c AS (SELECT asset, close AS x, sum(cap) OVER (PARTITION BY asset ORDER BY close, date) - cap AS cum, sum(cap) OVER (PARTITION BY asset) - cap AS rest, row_number() OVER (PARTITION BY asset ORDER BY close, date) AS k FROM bars),
p AS (SELECT asset, x, k, cum / nullif(rest, 0) AS pos FROM c), q AS (SELECT asset, x, pos, lead(x) OVER w AS x2, lead(pos) OVER w AS pos2 FROM p WINDOW w AS (PARTITION BY asset ORDER BY k)),
z AS (SELECT asset, max(x + (x2 - x) * (0.25 - pos) / (pos2 - pos)) FILTER (WHERE pos <= 0.25 AND pos2 > 0.25) AS a, max(x + (x2 - x) * (0.75 - pos) / (pos2 - pos)) FILTER (WHERE pos <= 0.75 AND pos2 > 0.75) AS b FROM q GROUP BY 1)
SELECT asset, round(a, 4) AS q25, round(b, 4) AS q75, round(0.7413 * (b - a), 4) AS robust FROM z""")
def weighted_quantiles(spark, d):
    """Quartiles by weight with linear interpolation, and the robust deviation."""
    q = K.weighted_quantiles(bars(spark, d), ["asset"], "close", "cap", {"a": 0.25, "b": 0.75}, tie="date")
    return q.select("asset", rnd("a", 4).alias("q25"), rnd("b", 4).alias("q75"), rnd(0.7413 * (F.col("b") - F.col("a")), 4).alias("robust"))


@query("k_fatness", f"WITH {RETURNS}, s AS (SELECT asset, stddev_samp(r) AS sd, 0.7413 * (quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) AS robust, count(r) AS n FROM rets WHERE r IS NOT NULL GROUP BY 1) SELECT asset, n, round(sd / robust, 4) AS ratio, round(abs(sd / robust - 1), 4) AS excess FROM s WHERE robust > 0")
def fatness(spark, d):
    s = returns(spark, d).where("r IS NOT NULL").groupBy("asset").agg(F.stddev_samp("r").alias("sd"), (0.7413 * (F.percentile("r", 0.75) - F.percentile("r", 0.25))).alias("robust"), F.count("r").alias("n"))
    ratio = F.col("sd") / F.col("robust")
    return s.where("robust > 0").select("asset", "n", rnd(ratio, 4).alias("ratio"), rnd(F.abs(ratio - 1), 4).alias("excess"))


@query("k_bias_family", f"WITH {_Z}, b AS (SELECT asset, asset % 4 AS family, stddev_samp(greatest(least(z, 4), -4)) AS b, count(*) AS n FROM z GROUP BY 1, 2) SELECT family, asset, CASE WHEN asset IS NULL THEN round(avg(abs(b - 1)), 4) ELSE round(max(b), 4) END AS b, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY GROUPING SETS ((family), (family, asset))")
def bias_family(spark, d):
    """Bias of each member and, by family, its mean absolute deviation from one."""
    z = _scores(spark, d).groupBy("asset").agg(F.stddev_samp(F.greatest(F.least("z", F.lit(4.0)), F.lit(-4.0))).alias("b"), F.count(F.lit(1)).alias("n"))
    one = z.select((F.col("asset") % 4).alias("family"), "asset", "b", "n")
    by = one.groupBy("family").agg(F.lit(None).cast("long").alias("asset"), rnd(F.avg(F.abs(F.col("b") - 1)), 4).alias("b"), F.sum("n").alias("n"))
    return one.select("family", "asset", rnd("b", 4).alias("b"), "n").unionByName(by)


@query("k_component_bias", f"WITH {_Z} SELECT asset, round(sqrt(var_samp(r) / avg(h * h)), 4) AS b, round(1 - sqrt(2.0 / count(*)), 4) AS low, round(1 + sqrt(2.0 / count(*)), 4) AS high FROM z GROUP BY 1")
def component_bias(spark, d):
    e = F.sqrt(2.0 / F.count(F.lit(1)))
    return _scores(spark, d).groupBy("asset").agg(rnd(F.sqrt(F.var_samp("r") / F.avg(F.col("h") * F.col("h"))), 4).alias("b"), rnd(1 - e, 4).alias("low"), rnd(1 + e, 4).alias("high"))


@query("k_breach_transitions", f"""WITH {_Z}, f AS (SELECT asset, date, CASE WHEN z < -1.645 THEN 1 ELSE 0 END AS b FROM z), t AS (SELECT asset, b, lag(b) OVER (PARTITION BY asset ORDER BY date) AS p FROM f),
n AS (SELECT asset, count(*) FILTER (WHERE p = 0 AND b = 0) AS a, count(*) FILTER (WHERE p = 0 AND b = 1) AS b, count(*) FILTER (WHERE p = 1 AND b = 0) AS c, count(*) FILTER (WHERE p = 1 AND b = 1) AS d FROM t GROUP BY 1),
l AS (SELECT asset, (b + d) / (a + b + c + d) AS pi, b / (a + b) AS p0, d / (c + d) AS p1, a, b, c, d FROM n WHERE a > 0 AND b > 0 AND c > 0)
SELECT asset, round(-2 * ((a + c) * ln(1 - pi) + (b + d) * ln(pi) - a * ln(1 - p0) - b * ln(p0) - c * ln(1 - p1) - CASE WHEN d > 0 THEN d * ln(p1) ELSE 0 END), 4) AS lr FROM l""")
def breach_transitions(spark, d):
    """Likelihood ratio of independence of breaches."""
    f = _scores(spark, d).select("asset", "date", F.when(F.col("z") < -1.645, 1).otherwise(0).alias("b"))
    return K.independence(f, "asset", "date", "b").select("asset", rnd("lr", 4).alias("lr"))


@query("k_mean_hac", f"""WITH {RETURNS}, x AS (SELECT asset, date, r - avg(r) OVER (PARTITION BY asset) AS e, avg(r) OVER (PARTITION BY asset) AS mu FROM rets WHERE r IS NOT NULL), l AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2 FROM x WINDOW w AS (PARTITION BY asset ORDER BY date)),
v AS (SELECT asset, max(mu) AS mu, count(*) AS n, (sum(e * e) + 2 * (2.0 / 3) * coalesce(sum(e * e1), 0) + 2 * (1.0 / 3) * coalesce(sum(e * e2), 0)) / count(*) / count(*) AS v FROM l GROUP BY 1) SELECT asset, n, round(mu, 5) + 0.0 AS mean, round(CASE WHEN v > 0 THEN mu / sqrt(v) END, 3) + 0.0 AS t FROM v""")
def mean_hac(spark, d):
    """Mean with its HAC error by column."""
    x = returns(spark, d).where("r IS NOT NULL").select("asset", "date", "r")
    return G.mean_hac(x, "asset", "date", "r", 2).select("asset", "n", rnd("mean").alias("mean"), rnd("t", 3).alias("t"))


@query("k_large_t", f"""WITH {RETURNS}, x AS (SELECT date, asset % 10 AS f, avg(r) AS m, stddev_samp(r) / sqrt(count(r)) AS se FROM rets WHERE r IS NOT NULL GROUP BY 1, 2) SELECT f, count(*) AS n, round(100 * avg(CASE WHEN abs(m / nullif(se, 0)) > 2 THEN 1.0 ELSE 0.0 END), 4) AS large, round(avg(m), 5) AS mean, round(stddev_samp(m), 5) AS sd, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 3) AS t FROM x GROUP BY 1""")
def large_t(spark, d):
    """By factor: share of days whose t is over two, and the t of the series."""
    x = returns(spark, d).where("r IS NOT NULL").groupBy("date", (F.col("asset") % 10).alias("f")).agg(F.avg("r").alias("m"), (F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("se"))
    big = F.coalesce(F.abs(F.try_divide("m", "se")) > 2, F.lit(False))
    n = F.count(F.lit(1))
    return x.groupBy("f").agg(n.alias("n"), rnd(100 * F.avg(F.when(big, 1.0).otherwise(0.0)), 4).alias("large"), rnd(F.avg("m")).alias("mean"), rnd(F.stddev_samp("m")).alias("sd"), rnd(F.avg("m") / (F.stddev_samp("m") / F.sqrt(n)), 3).alias("t"))


@query("k_rolling_bias", f"WITH {_Z}, n AS (SELECT asset, date, greatest(least(z, 4), -4) AS z, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM z), b AS (SELECT asset, date, rn, stddev_samp(z) {_ROLL(60)} AS b, count(z) {_ROLL(60)} AS c FROM n) SELECT asset, date, round(b, 4) AS b, CAST((rn - 1) // 60 AS BIGINT) AS block FROM b WHERE c = 60 AND rn % 20 = 0")
def rolling_bias(spark, d):
    """Clipped deviation over 60 scores, read every 20; ``block`` tells which reads don't overlap."""
    n = _scores(spark, d).select("asset", "date", F.greatest(F.least("z", F.lit(4.0)), F.lit(-4.0)).alias("z"), F.row_number().over(_by()).alias("rn"))
    w = _by().rowsBetween(-59, 0)
    b = n.withColumn("b", F.stddev_samp("z").over(w)).withColumn("c", F.count("z").over(w)).where("c = 60 AND rn % 20 = 0")
    return b.select("asset", "date", rnd("b", 4).alias("b"), F.expr("(rn - 1) div 60").alias("block"))


@query("k_lagged_multiplier", f"WITH {_Z}, x AS (SELECT date, sqrt(avg(z * z)) AS b, row_number() OVER (ORDER BY date) AS rn FROM z GROUP BY 1), e AS (SELECT date, sqrt(sum(pow(2.0, rn / 42.0) * b * b) OVER (ORDER BY date) / sum(pow(2.0, rn / 42.0)) OVER (ORDER BY date)) AS m FROM x) SELECT date, round(lag(m) OVER (ORDER BY date), 5) AS multiplier FROM e")
def lagged_multiplier(spark, d):
    """Regime multiplier that stands at the session before."""
    b = _scores(spark, d).groupBy("date").agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("b"))
    return K.lagged_multiplier(b, "date", "b", 42).select("date", rnd("multiplier").alias("multiplier"))


@query("k_mean_conventions", f"WITH {RETURNS}, n AS (SELECT asset, date, r, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM rets WHERE r IS NOT NULL), s AS (SELECT asset, date, rn, avg(r) OVER w AS m, sqrt(avg(r * r) OVER w) AS about_zero, sqrt(greatest(avg(r * r) OVER w - avg(r) OVER w * avg(r) OVER w, 0)) AS centred FROM n WINDOW w AS (PARTITION BY asset ORDER BY date)) SELECT asset, date, round(m, 5) AS mean, round(about_zero, 5) AS about_zero, round(centred, 5) AS centred FROM s WHERE rn % 21 = 0")
def mean_conventions(spark, d):
    """Expanding deviation about zero and about the mean, read every 21 rows."""
    w = _by().rowsBetween(Window.unboundedPreceding, 0)
    n = returns(spark, d).where("r IS NOT NULL").select("asset", "date", "r", F.row_number().over(_by()).alias("rn"))
    s = n.withColumn("m", F.avg("r").over(w)).withColumn("q", F.avg(F.col("r") * F.col("r")).over(w)).where("rn % 21 = 0")
    return s.select("asset", "date", rnd("m").alias("mean"), rnd(F.sqrt("q")).alias("about_zero"), rnd(F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))).alias("centred"))


@query("k_jump_band", f"WITH {BARS}, x AS (SELECT asset, date, close / lag(close) OVER (PARTITION BY asset ORDER BY date) AS ratio FROM bars) SELECT asset, date, round(ratio, 5) AS ratio FROM x WHERE (ratio > 1.8 AND ratio < 2.2) OR (ratio > 1 / 2.2 AND ratio < 1 / 1.8)")
def jump_band(spark, d):
    x = bars(spark, d).select("asset", "date", (F.col("close") / F.lag("close").over(_by())).alias("ratio"))
    return x.where(K.in_band(F.col("ratio"), 1.8, 2.2)).select("asset", "date", rnd("ratio").alias("ratio"))


@query("k_composite", f"WITH {RETURNS}, x AS (SELECT asset, date, sum(r) {_ROLL(20)} AS mom, stddev_samp(r) {_ROLL(20)} AS sd, max(close) {_ROLL(20)} / min(close) {_ROLL(20)} AS rng, count(r) {_ROLL(20)} AS n FROM rets), z AS (SELECT asset, date, (mom - avg(mom) OVER w) / stddev_samp(mom) OVER w AS a, (sd - avg(sd) OVER w) / stddev_samp(sd) OVER w AS b, (ln(rng) - avg(ln(rng)) OVER w) / stddev_samp(ln(rng)) OVER w AS c FROM x WHERE n = 20 WINDOW w AS (PARTITION BY date)) SELECT asset, date, round(0.74 * a + 0.16 * b + 0.10 * c, 4) + 0.0 AS composite FROM z WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def composite(spark, d):
    """Three descriptors, standardised by date, to one composite; null parts make it null."""
    w = _by().rowsBetween(-19, 0)
    x = returns(spark, d).select("asset", "date", F.sum("r").over(w).alias("mom"), F.stddev_samp("r").over(w).alias("sd"), F.log(F.max("close").over(w) / F.min("close").over(w)).alias("rng"), F.count("r").over(w).alias("n")).where("n = 20")
    w = Window.partitionBy("date")
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w))
    out = x.select("asset", "date", K.weighted_sum({"a": 0.74, "b": 0.16, "c": 0.10}, {"a": z("mom"), "b": z("sd"), "c": z("rng")}).alias("composite"))
    return out.where("composite IS NOT NULL").select("asset", "date", rnd("composite", 4).alias("composite"))


@query("k_momentum_rate", f"WITH {RETURNS}, x AS (SELECT asset, date, avg(r) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 69 PRECEDING AND 10 PRECEDING) AS rate, count(r) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 69 PRECEDING AND 10 PRECEDING) AS n FROM rets) SELECT asset, date, round(rate, 6) AS rate FROM x WHERE n = 60")
def momentum_rate(spark, d):
    """Mean return of 60 sessions that ended ten sessions ago, by session."""
    w = _by().rowsBetween(-69, -10)
    x = returns(spark, d).select("asset", "date", F.avg("r").over(w).alias("rate"), F.count("r").over(w).alias("n"))
    return x.where("n = 60").select("asset", "date", rnd("rate", 6).alias("rate"))


@query("k_ols_hac", f"""WITH {_RM}, b AS (SELECT asset, regr_slope(r, m) AS beta, regr_intercept(r, m) AS alpha, avg(m) AS mm, count(*) AS n, sum(m) AS sm, sum(m * m) AS smm FROM rm GROUP BY 1), e AS (SELECT rm.asset, date, m, r - alpha - beta * m AS e, n, sm, smm, n * smm - sm * sm AS det, alpha, beta FROM rm JOIN b ON rm.asset = b.asset),
s AS (SELECT *, e * (smm - sm * m) / det AS ga, e * (n * m - sm) / det AS gb FROM e), l AS (SELECT *, lag(ga, 1) OVER w AS ga1, lag(gb, 1) OVER w AS gb1, lag(ga, 2) OVER w AS ga2, lag(gb, 2) OVER w AS gb2 FROM s WINDOW w AS (PARTITION BY asset ORDER BY date))
SELECT asset, max(n) AS n, round(max(alpha), 5) AS alpha, round(max(beta), 4) AS beta, round(sqrt(greatest(sum(ga * ga) + 2 * (2.0 / 3) * sum(coalesce(ga * ga1, 0)) + 2 * (1.0 / 3) * sum(coalesce(ga * ga2, 0)), 0)), 5) AS alpha_error, round(sqrt(greatest(sum(gb * gb) + 2 * (2.0 / 3) * sum(coalesce(gb * gb1, 0)) + 2 * (1.0 / 3) * sum(coalesce(gb * gb2, 0)), 0)), 4) AS beta_error FROM l GROUP BY 1""")
def ols_hac(spark, d):
    """Market regression with HAC errors: sums by asset, then one pass over the residuals."""
    x = G.ols_hac(_with_market(spark, d), "asset", "date", "r", "m", 2)
    return x.select("asset", "n", rnd("alpha").alias("alpha"), rnd("beta", 4).alias("beta"), rnd("alpha_error").alias("alpha_error"), rnd("beta_error", 4).alias("beta_error"))


_TWO = f"""{_RM}, sz AS (SELECT date, avg(CASE WHEN asset % 2 = 0 THEN r END) - avg(CASE WHEN asset % 2 = 1 THEN r END) AS s FROM rm GROUP BY 1), t AS (SELECT asset, rm.date, r AS y, m AS u, s AS v, row_number() OVER (PARTITION BY asset ORDER BY rm.date) AS rn FROM rm JOIN sz ON rm.date = sz.date WHERE s IS NOT NULL),
g AS (SELECT asset, date, rn, count(*) OVER w AS c, """ + ", ".join(f"sum(pow(2.0, rn / 63.0) * {e}) OVER w / sum(pow(2.0, rn / 63.0)) OVER w AS {n}" for n, e in (("my", "y"), ("mu", "u"), ("mv", "v"), ("uu", "u * u"), ("vv", "v * v"), ("uv", "u * v"), ("uy", "u * y"), ("vy", "v * y"), ("yy", "y * y"))) + """ FROM t WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)),
k AS (SELECT asset, date, my, mu, mv, uu - mu * mu AS a, vv - mv * mv AS b, uv - mu * mv AS o, uy - mu * my AS p, vy - mv * my AS q, yy - my * my AS s FROM g WHERE c = 126), bt AS (SELECT *, (p * b - q * o) / (a * b - o * o) AS b1, (q * a - p * o) / (a * b - o * o) AS b2 FROM k)"""


def _two(spark, d):
    x = _with_market(spark, d)
    even = F.col("asset") % 2 == 0
    s = x.groupBy("date").agg((F.avg(F.when(even, F.col("r"))) - F.avg(F.when(~even, F.col("r")))).alias("s")).where("s IS NOT NULL")
    return G.rolling_two(x.join(s, "date").select("asset", "date", F.col("r").alias("y"), F.col("m").alias("u"), F.col("s").alias("v")), "asset", "date", 126, 63)


@query("k_rolling_regression", f"WITH {_TWO} SELECT asset, date, round(b1, 4) + 0.0 AS b1, round(b2, 4) + 0.0 AS b2, round(my - b1 * mu - b2 * mv, 5) + 0.0 AS alpha, round((b1 * p + b2 * q) / s, 4) + 0.0 AS r2 FROM bt")
def rolling_regression(spark, d):
    """Rolling decayed regression on two factors with intercept, at every date."""
    return _two(spark, d).select("asset", "date", rnd("b1", 4).alias("b1"), rnd("b2", 4).alias("b2"), rnd("alpha").alias("alpha"), rnd("r2", 4).alias("r2"))


@query("k_exposure_diagnostics", f"WITH {_TWO}, x AS (SELECT asset, (b1 * p + b2 * q) / s AS r2, b1 FROM bt) SELECT asset, count(*) AS n, round(median(r2), 4) AS mid, round(min(r2), 4) AS low, round(max(r2), 4) AS high, round(avg(CASE WHEN r2 < 0.1 THEN 1.0 ELSE 0.0 END), 5) AS below, round(avg(CASE WHEN abs(b1) > 0.5 THEN 1.0 ELSE 0.0 END), 5) AS exposed FROM x GROUP BY 1")
def exposure_diagnostics(spark, d):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return _two(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), rnd(F.median("r2"), 4).alias("mid"), rnd(F.min("r2"), 4).alias("low"), rnd(F.max("r2"), 4).alias("high"), rnd(share(F.col("r2") < 0.1)).alias("below"), rnd(share(F.abs("b1") > 0.5)).alias("exposed"))


@query("k_exposure_by_year", f"WITH {_TWO} SELECT asset, CAST(year(date) AS INTEGER) AS year, round(avg(b1), 4) AS b1, round(avg(b2), 4) AS b2 FROM bt GROUP BY 1, 2")
def exposure_by_year(spark, d):
    return _two(spark, d).groupBy("asset", F.year("date").alias("year")).agg(rnd(F.avg("b1"), 4).alias("b1"), rnd(F.avg("b2"), 4).alias("b2"))


@query("k_orthogonal_sequence", f"""WITH {_RM}, f AS (SELECT date, max(m) AS a, avg(r) AS b, avg(CASE WHEN volume > 25 THEN r END) AS c FROM rm GROUP BY 1), g AS (SELECT *, row_number() OVER (ORDER BY date) AS rn FROM f WHERE c IS NOT NULL), e AS (SELECT date, a, b, c, rn, regr_slope(b, a) OVER w AS s, regr_intercept(b, a) OVER w AS i FROM g WINDOW w AS (ORDER BY date)), h AS (SELECT date, a, b - i - s * a AS b2, c, rn FROM e WHERE rn >= 60),
k AS (SELECT date, a, b2, c, regr_slope(c, b2) OVER w AS s, regr_intercept(c, b2) OVER w AS i, rn FROM h WINDOW w AS (ORDER BY date)) SELECT date, round(a, 5) AS a, round(b2, 5) AS b, round(c - i - s * b2, 5) AS c FROM k WHERE rn >= 120""")
def orthogonal_sequence(spark, d):
    """Factors one after the other, each the expanding residual on the one before."""
    f = _with_market(spark, d).groupBy("date").agg(F.max("m").alias("a"), F.avg("r").alias("b"), F.avg(F.when(F.col("volume") > 25, F.col("r"))).alias("c")).where("c IS NOT NULL")
    w = Window.orderBy("date")  # a row a session
    g = f.withColumn("rn", F.row_number().over(w))
    g = g.withColumn("b", G.expanding_residual("b", "a", w)).where("rn >= 60")
    g = g.withColumn("c", G.expanding_residual("c", "b", w)).where("rn >= 120")
    return g.select("date", *(rnd(x).alias(x) for x in ("a", "b", "c")))


@query("k_correlation_gates", f"WITH {_RM}, f AS (SELECT date, max(m) AS a, avg(r) AS b, avg(CASE WHEN volume > 25 THEN r END) AS c FROM rm GROUP BY 1), p AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM f WHERE c IS NOT NULL), u AS (SELECT unnest([{{'pair': 'ab', 'v': ab}}, {{'pair': 'ac', 'v': ac}}, {{'pair': 'bc', 'v': bc}}]) AS x FROM p) SELECT x.pair AS pair, round(x.v, 4) AS corr, abs(x.v) <= 0.5 AS passes FROM u")
def correlation_gates(spark, d):
    """Correlation of targeted pairs on complete dates against a limit."""
    f = _with_market(spark, d).groupBy("date").agg(F.max("m").alias("a"), F.avg("r").alias("b"), F.avg(F.when(F.col("volume") > 25, F.col("r"))).alias("c")).where("c IS NOT NULL")
    p = f.agg(*(corr(x[0], x[1]).alias(x) for x in ("ab", "ac", "bc"))).unpivot([], ["ab", "ac", "bc"], "pair", "v")
    return p.select("pair", rnd("v", 4).alias("corr"), (F.abs("v") <= 0.5).alias("passes"))


@query("k_asset_covariance", """WITH c AS (SELECT label, vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), e AS (SELECT label, i, avg(x) AS b FROM c GROUP BY 1, 2),
 f AS (SELECT p.i, q.i AS j, covar_pop(p.x, q.x) AS v FROM c p JOIN c q ON q.vec_id = p.vec_id GROUP BY 1, 2), o AS (SELECT c.label, avg((x - b) * (x - b)) AS own FROM c JOIN e ON e.label = c.label AND e.i = c.i GROUP BY 1),
 h AS (SELECT e.label, f.j, sum(e.b * f.v) AS h FROM e JOIN f ON f.i = e.i GROUP BY 1, 2)
 SELECT h.label AS i, e.label AS j, round(sum(h.h * e.b) + max(CASE WHEN h.label = e.label THEN own ELSE 0 END), 8) AS value FROM h JOIN e ON e.i = h.j JOIN o ON o.label = h.label WHERE h.label <= e.label GROUP BY 1, 2""")
def asset_covariance(spark, d):
    """X F X' over all factors, with each asset's own variance on the diagonal; an asset is a label, its exposures the mean vector."""
    v = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")).withColumn("one", F.lit(1))
    cells = v.select("label", F.posexplode("v").alias("i", "x"))
    b = cells.groupBy("label", "i").agg(F.avg("x").alias("b"))
    mean = cells.groupBy("i").agg(F.avg("x").alias("m"))
    second = M.both_triangles(M.second_moment(M.pairs(v, "one", "v", []), "one"), "one")
    cov = second.join(mean, "i").join(mean.select(F.col("i").alias("j"), F.col("m").alias("n")), "j").select("i", "j", (F.col("value") - F.col("m") * F.col("n")).alias("v"))
    half = b.join(cov, "i").groupBy("label", "j").agg(F.sum(F.col("b") * F.col("v")).alias("h"))
    own = cells.join(b, ["label", "i"]).groupBy("label").agg(F.avg(F.pow(F.col("x") - F.col("b"), 2)).alias("own"))
    p = half.withColumnRenamed("label", "a").join(b.select(F.col("label").alias("c"), F.col("i").alias("j"), F.col("b").alias("y")), "j").where("a <= c")
    p = p.groupBy("a", "c").agg(F.sum(F.col("h") * F.col("y")).alias("s")).join(own.withColumnRenamed("label", "a"), "a")
    return p.select(F.col("a").alias("i"), F.col("c").alias("j"), rnd(F.col("s") + F.when(F.col("a") == F.col("c"), F.col("own")).otherwise(0.0), 8).alias("value"))


@query("k_variance_additive", f"WITH {_RM}, b AS (SELECT asset, regr_slope(r, m) AS beta, var_pop(r) AS total, var_pop(m) AS vm FROM rm GROUP BY 1), e AS (SELECT rm.asset, var_pop(r - beta * m) AS own, max(beta * beta * vm) AS common, max(total) AS total FROM rm JOIN b ON b.asset = rm.asset GROUP BY 1) SELECT asset, round(common / total, 4) AS common_share, abs(common + own - total) <= 1e-9 * total AS adds_up FROM e WHERE total > 0")
def variance_additive(spark, d):
    """Common and own variance add to the total."""
    x = _with_market(spark, d)
    b = x.groupBy("asset").agg(F.regr_slope("r", "m").alias("beta"), F.var_pop("r").alias("total"), F.var_pop("m").alias("vm"))
    e = x.join(b, "asset").groupBy("asset").agg(F.var_pop(F.col("r") - F.col("beta") * F.col("m")).alias("own"), F.max(F.col("beta") * F.col("beta") * F.col("vm")).alias("common"), F.max("total").alias("total")).where("total > 0")
    return e.select("asset", rnd(F.col("common") / F.col("total"), 4).alias("common_share"), (F.abs(F.col("common") + F.col("own") - F.col("total")) <= 1e-9 * F.col("total")).alias("adds_up"))


@query("k_attribution", f"WITH {_RM}, b AS (SELECT asset, regr_slope(r, m) AS beta FROM rm GROUP BY 1), w AS (SELECT rm.asset, date, r, m, beta, cap / sum(cap) OVER (PARTITION BY date) AS w FROM rm JOIN b ON b.asset = rm.asset) SELECT CAST(date_trunc('month', date) AS DATE) AS month, round(sum(w * beta * m), 5) AS factor, round(sum(w * (r - beta * m)), 5) AS specific, round(sum(w * r), 5) AS total FROM w GROUP BY 1")
def attribution(spark, d):
    """Return of the cap-weighted book by month: what the factor explains and what not."""
    x = _with_market(spark, d)
    b = x.groupBy("asset").agg(F.regr_slope("r", "m").alias("beta"))
    w = x.join(b, "asset").withColumn("w", F.col("cap") / F.sum("cap").over(Window.partitionBy("date")))
    common = F.col("w") * F.col("beta") * F.col("m")
    return w.groupBy(month().alias("month")).agg(rnd(F.sum(common)).alias("factor"), rnd(F.sum(F.col("w") * F.col("r") - common)).alias("specific"), rnd(F.sum(F.col("w") * F.col("r"))).alias("total"))


@query("k_effective_spread", f"""WITH {RETURNS}, h AS (SELECT asset, date, ln(close) AS c, (ln(high) + ln(low)) / 2 AS mid FROM bars), p AS (SELECT asset, date, (c - mid) * (c - lead(mid) OVER (PARTITION BY asset ORDER BY date)) AS x FROM h), s AS (SELECT asset, date, 4 * avg(x) {_ROLL(63)} AS s2, count(x) {_ROLL(63)} AS n FROM p)
SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, round(avg(sign(s2) * sqrt(abs(s2))), 5) AS signed, round(avg(sqrt(greatest(s2, 0))) * 10000, 2) AS bp, count(*) FILTER (WHERE s2 < 0) AS negative FROM s WHERE n >= 42 GROUP BY 1, 2""")
def effective_spread(spark, d):
    """Close against the mid of high and low of this bar and the next, over 63 bars; a panel by month."""
    s = K.effective_spread(bars(spark, d), "asset", "date", 63, 42)
    return s.groupBy("asset", month().alias("month")).agg(rnd(F.avg(F.signum("s2") * F.sqrt(F.abs("s2")))).alias("signed"), rnd(F.avg(F.sqrt(F.greatest("s2", F.lit(0.0)))) * 10_000, 2).alias("bp"), F.count_if(F.col("s2") < 0).alias("negative"))


@query("k_spread_series", f"WITH {BARS}, m AS (SELECT asset, date_trunc('month', date) AS month, avg((high - low) / close) * 10000 AS s FROM bars GROUP BY 1, 2), b AS (SELECT asset, median(s) AS base FROM m GROUP BY 1) SELECT m.asset, CAST(month AS DATE) AS month, round((2 + greatest(s - base, 0)) / 2 + 0.5, 3) AS half_low, round((5 + greatest(s - base, 0)) / 2 + 0.5, 3) AS half_high FROM m JOIN b ON m.asset = b.asset")
def spread_series(spark, d):
    """Level at both ends of its interval plus the widening over the median month, halved, with commission."""
    m = bars(spark, d).groupBy("asset", month().alias("month")).agg((F.avg((F.col("high") - F.col("low")) / F.col("close")) * 10_000).alias("s"))
    base = m.groupBy("asset").agg(F.median("s").alias("base"))
    x = m.join(base, "asset").withColumn("widening", F.greatest(F.col("s") - F.col("base"), F.lit(0.0)))
    return x.select("asset", "month", rnd(K.half_spread(2 + F.col("widening"), 0.5), 3).alias("half_low"), rnd(K.half_spread(5 + F.col("widening"), 0.5), 3).alias("half_high"))


@query("k_gap_identity", f"WITH {RETURNS}, m AS (SELECT asset, date_trunc('month', date) AS month, sum(r) AS net, sum(r) + 0.001 * count(*) AS gross, stddev_samp(r) * sqrt(count(*)) AS f FROM rets WHERE r IS NOT NULL GROUP BY 1, 2), s AS (SELECT asset, avg(net) / stddev_samp(net) AS sn, avg(gross) / stddev_samp(gross) AS sg, avg(gross) / sqrt(avg(f * f)) AS sf FROM m GROUP BY 1) SELECT asset, round(sf - sg, 4) + 0.0 AS risk_term, round(sg - sn, 4) + 0.0 AS cost_term, round(sf - sn, 4) + 0.0 AS gap FROM s WHERE sf IS NOT NULL")
def gap_identity(spark, d):
    """Forecast, gross and net ratio of mean to risk; the two terms add to the gap."""
    m = returns(spark, d).where("r IS NOT NULL").groupBy("asset", month().alias("month")).agg(F.sum("r").alias("net"), (F.sum("r") + 0.001 * F.count(F.lit(1))).alias("gross"), (F.stddev_samp("r") * F.sqrt(F.count(F.lit(1)))).alias("f"))
    s = m.groupBy("asset").agg(F.try_divide(F.avg("net"), F.stddev_samp("net")).alias("sn"), F.try_divide(F.avg("gross"), F.stddev_samp("gross")).alias("sg"), F.try_divide(F.avg("gross"), F.sqrt(F.avg(F.col("f") * F.col("f")))).alias("sf")).where("sf IS NOT NULL")
    return s.select("asset", rnd(F.col("sf") - F.col("sg"), 4).alias("risk_term"), rnd(F.col("sg") - F.col("sn"), 4).alias("cost_term"), rnd(F.col("sf") - F.col("sn"), 4).alias("gap"))


@query("k_sharpe_error", f"""WITH {RETURNS}, q AS (SELECT asset, date, r, avg(r) OVER p AS mu, avg(r * r) OVER p - avg(r) OVER p * avg(r) OVER p AS v FROM rets WHERE r IS NOT NULL WINDOW p AS (PARTITION BY asset)), g AS (SELECT asset, date, mu, v, (r - mu) / sqrt(v) - mu / (2 * v * sqrt(v)) * ((r - mu) * (r - mu) - v) AS g FROM q WHERE v > 0), l AS (SELECT *, lag(g, 1) OVER w AS g1, lag(g, 2) OVER w AS g2 FROM g WINDOW w AS (PARTITION BY asset ORDER BY date))
SELECT asset, round(max(mu) / sqrt(max(v)), 5) + 0.0 AS sharpe, round(sqrt(greatest(sum(g * g) + 2 * (2.0 / 3) * sum(coalesce(g * g1, 0)) + 2 * (1.0 / 3) * sum(coalesce(g * g2, 0)), 0)) / count(*), 5) + 0.0 AS error FROM l GROUP BY 1""")
def sharpe_error(spark, d):
    """Sharpe ratio and its HAC error by the delta method on mean and variance."""
    x = returns(spark, d).where("r IS NOT NULL").select("asset", "date", "r")
    return K.sharpe_error(x, "asset", "date", "r", 2).select("asset", rnd("sharpe").alias("sharpe"), rnd("error").alias("error"))


@query("k_moments_of_trials", f"WITH {RETURNS}, s AS (SELECT asset, avg(r) / stddev_samp(r) AS sr, skewness(r) AS skew, kurtosis(r) AS kurt, count(*) AS n FROM rets WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) > 10) SELECT asset, round(sr, 5) + 0.0 AS sr, round(skew, 4) + 0.0 AS skew, round(kurt, 3) + 0.0 AS kurt, round(sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt + 2) / 4 * sr * sr), 4) + 0.0 AS score FROM s")
def moments_of_trials(spark, d):
    """Bias-corrected skewness and excess kurtosis, and the score of the ratio against none."""
    x = returns(spark, d).where("r IS NOT NULL").groupBy("asset").agg(F.count(F.lit(1)).alias("n"), (F.avg("r") / F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2")).where("n > 10")
    skew, kurt = K.corrected_moments(F.col("g1"), F.col("g2"), F.col("n"))
    x = x.withColumn("skew", skew).withColumn("kurt", kurt)
    return x.select("asset", rnd("sr").alias("sr"), rnd("skew", 4).alias("skew"), rnd("kurt", 3).alias("kurt"), rnd(F.col("sr") * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * F.col("sr") + (F.col("kurt") + 2) / 4 * F.col("sr") * F.col("sr")), 4).alias("score"))


@query("k_capacity", f"WITH {RETURNS}, s AS (SELECT asset, avg(r) * 252 AS alpha, avg(trades) AS tau, avg((high - low) / close) / 100 AS kappa FROM rets WHERE r IS NOT NULL GROUP BY 1) SELECT asset, round(CASE WHEN alpha > 0.001 AND kappa > 0 THEN (alpha - 0.001) / (tau * kappa) * ((alpha - 0.001) / (tau * kappa)) END, 3) AS break_even, round(CASE WHEN alpha > 0.001 AND kappa > 0 THEN (alpha - 0.001) / (1.5 * tau * kappa) * ((alpha - 0.001) / (1.5 * tau * kappa)) END, 3) AS effective FROM s")
def capacity(spark, d):
    """Money at which alpha less the fixed drag is gone, and at which one more unit earns nothing; exponent 1.5."""
    s = returns(spark, d).where("r IS NOT NULL").groupBy("asset").agg((F.avg("r") * 252).alias("alpha"), F.avg("trades").alias("tau"), (F.avg((F.col("high") - F.col("low")) / F.col("close")) / 100).alias("kappa"))
    points = K.capacity(F.col("alpha"), F.col("tau"), F.col("kappa"), 1.5, 0.001)
    return s.select("asset", rnd(points[0], 3).alias("break_even"), rnd(points[1], 3).alias("effective"))


@query("k_crossing_interpolated", f"WITH {RETURNS}, s AS (SELECT asset, avg(r) * 252 AS alpha FROM rets WHERE r IS NOT NULL GROUP BY 1), g AS (SELECT asset, i, 6 + i / 2.0 AS la, alpha - 0.01 * pow(2.0, i) AS net FROM s, (SELECT unnest(range(9)) AS i) AS gi), n AS (SELECT *, lag(la) OVER w AS la0, lag(net) OVER w AS net0, row_number() OVER w AS rn FROM g WINDOW w AS (PARTITION BY asset ORDER BY i)), f AS (SELECT asset, min(i) FILTER (WHERE net <= 0) AS k FROM g GROUP BY 1) SELECT f.asset, CASE WHEN k IS NULL THEN NULL WHEN k = 0 THEN round(la, 4) ELSE round(la0 + (la - la0) * net0 / (net0 - net), 4) END AS log_aum FROM f LEFT JOIN n ON n.asset = f.asset AND n.i = f.k")
def crossing_interpolated(spark, d):
    """First point of a grid where the net is used up, linear in the logarithm with the point before; null if none is."""
    s = returns(spark, d).where("r IS NOT NULL").groupBy("asset").agg((F.avg("r") * 252).alias("alpha"))
    g = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("asset", (6 + F.col("i") / 2.0).alias("la"), (F.col("alpha") - 0.01 * F.pow(F.lit(2.0), "i")).alias("net"))
    return K.crossing(g, "asset", "la", "net").select("asset", rnd("at", 4).alias("log_aum"))


@query("k_financing", f"WITH {BARS}, x AS (SELECT asset, date, cap, volume, lag(cap - volume * close * 0.9) OVER (PARTITION BY asset ORDER BY date) AS cash FROM bars), r AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1e9 AS rate FROM orders GROUP BY 1) SELECT asset, round(sum(cash * rate), 4) AS financing, count(cash * rate) AS sessions FROM x LEFT JOIN r ON r.date = x.date GROUP BY 1")
def financing(spark, d):
    """Cash of the session before times the rate of this one."""
    x = bars(spark, d).select("asset", "date", F.lag(F.col("cap") - F.col("volume") * F.col("close") * 0.9).over(_by()).alias("cash"))
    r = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((F.avg("o_totalprice") / 1e9).alias("rate"))
    x = x.join(r, "date", "left").withColumn("leg", F.col("cash") * F.col("rate"))
    return x.groupBy("asset").agg(rnd(F.sum("leg"), 4).alias("financing"), F.count("leg").alias("sessions"))


@query("k_shortfall", "WITH o AS (SELECT l_orderkey, sum(l_extendedprice) AS nav, sum(l_extendedprice * l_tax) AS spread, sum(l_extendedprice * l_discount * 0.1) AS impact, sum(l_quantity) AS traded FROM lineitem GROUP BY 1) SELECT l_orderkey, round(spread / nav * 10000, 3) AS spread_bp, round(impact / nav * 10000, 3) AS impact_bp, round((spread + impact) / nav * 10000, 3) AS total_bp, round(traded, 2) AS traded FROM o")
def shortfall(spark, d):
    """Cost legs of an order over its value in basis points; they add to the total."""
    x = F.col("l_extendedprice")
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(x).alias("nav"), F.sum(x * F.col("l_tax")).alias("spread"), F.sum(x * F.col("l_discount") * 0.1).alias("impact"), F.sum("l_quantity").alias("traded"))
    bp = lambda c: rnd(c / F.col("nav") * 10_000, 3)
    return o.select("l_orderkey", bp(F.col("spread")).alias("spread_bp"), bp(F.col("impact")).alias("impact_bp"), bp(F.col("spread") + F.col("impact")).alias("total_bp"), rnd("traded", 2).alias("traded"))


@query("k_residual_correlation", f"WITH {_RM}, b AS (SELECT asset, regr_slope(r, m) AS beta, regr_intercept(r, m) AS alpha FROM rm GROUP BY 1), g AS (SELECT date, rm.asset % 10 AS g, avg(r - alpha - beta * m) AS e FROM rm JOIN b ON b.asset = rm.asset GROUP BY 1, 2) SELECT x.g AS i, y.g AS j, round(corr(x.e, y.e), 4) AS corr, count(*) AS n FROM g x JOIN g y ON x.date = y.date AND x.g < y.g GROUP BY 1, 2")
def residual_correlation(spark, d):
    """Correlation of the market residuals of groups of assets."""
    x = _with_market(spark, d)
    b = x.groupBy("asset").agg(F.regr_slope("r", "m").alias("beta"), F.regr_intercept("r", "m").alias("alpha"))
    g = x.join(b, "asset").groupBy("date", (F.col("asset") % 10).alias("i")).agg(F.avg(F.col("r") - F.col("alpha") - F.col("beta") * F.col("m")).alias("x"))
    p = g.join(g.select("date", F.col("i").alias("j"), F.col("x").alias("y")), "date").where("i < j")
    return p.groupBy("i", "j").agg(rnd(corr("x", "y"), 4).alias("corr"), F.count(F.lit(1)).alias("n"))


@query("k_round_trip", f"WITH {RETURNS}, d AS (SELECT asset, sum(r) AS s FROM rets WHERE r IS NOT NULL GROUP BY 1), m AS (SELECT asset, sum(x) AS s FROM (SELECT asset, date_trunc('month', date) AS month, sum(r) AS x FROM rets WHERE r IS NOT NULL GROUP BY 1, 2) GROUP BY 1) SELECT d.asset, abs(d.s - m.s) < 1e-9 AS equal, round(d.s, 5) AS total FROM d JOIN m ON d.asset = m.asset")
def round_trip(spark, d):
    """Sum of daily less sum of monthly returns."""
    r = returns(spark, d).where("r IS NOT NULL")
    m = r.groupBy("asset", month().alias("month")).agg(F.sum("r").alias("x")).groupBy("asset").agg(F.sum("x").alias("m"))
    return r.groupBy("asset").agg(F.sum("r").alias("s")).join(m, "asset").select("asset", (F.abs(F.col("s") - F.col("m")) < 1e-9).alias("equal"), rnd("s").alias("total"))


@query("k_anchor_check", f"WITH {_RM}, f AS (SELECT CAST(year(date) AS INTEGER) AS year, date, max(m) AS a, avg(r) AS b FROM rm GROUP BY 1, 2), c AS (SELECT year, corr(a, b) AS c, avg(a - b) AS gap, count(*) AS n FROM f GROUP BY 1) SELECT year, n, round(c, 4) AS corr, round(tanh(atanh(c) - 1.96 / sqrt(n - 3)), 4) AS low, round(tanh(atanh(c) + 1.96 / sqrt(n - 3)), 4) AS high, round(gap, 6) AS gap FROM c WHERE n > 3 AND abs(c) < 1")
def anchor_check(spark, d):
    """Two daily series by year: correlation with its Fisher interval, and mean gap."""
    f = _with_market(spark, d).groupBy("date").agg(F.max("m").alias("a"), F.avg("r").alias("b"))
    c = f.groupBy(F.year("date").alias("year")).agg(corr("a", "b").alias("c"), F.avg(F.col("a") - F.col("b")).alias("gap"), F.count(F.lit(1)).alias("n")).where("n > 3 AND abs(c) < 1")
    low, high = K.fisher_interval(F.col("c"), F.col("n"))
    return c.select("year", "n", rnd("c", 4).alias("corr"), rnd(low, 4).alias("low"), rnd(high, 4).alias("high"), rnd("gap", 6).alias("gap"))


@query("k_volatility_summary", f"WITH {RETURNS}, v AS (SELECT asset, stddev_samp(r) * sqrt(252) AS v FROM rets WHERE r IS NOT NULL GROUP BY 1) SELECT round(min(v), 4) AS low, round(median(v), 4) AS mid, round(max(v), 4) AS high, count(*) FILTER (WHERE v BETWEEN 8 AND 12) AS near, count(*) AS n FROM v")
def volatility_summary(spark, d):
    v = returns(spark, d).where("r IS NOT NULL").groupBy("asset").agg((F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("v"))
    return v.agg(rnd(F.min("v"), 4).alias("low"), rnd(F.median("v"), 4).alias("mid"), rnd(F.max("v"), 4).alias("high"), F.count_if(F.col("v").between(8, 12)).alias("near"), F.count(F.lit(1)).alias("n"))


@query("k_screen_causes", f"WITH {RETURNS}, s AS (SELECT *, count(r) {_ROLL(60)} AS n FROM rets) SELECT date, count(*) AS names, count(*) FILTER (WHERE n < 60) AS short, count(*) FILTER (WHERE n >= 60 AND volume < 10) AS thin, count(*) FILTER (WHERE n >= 60 AND volume >= 10 AND r IS NULL) AS no_return, count(*) FILTER (WHERE n >= 60 AND volume >= 10 AND r IS NOT NULL) AS kept FROM s GROUP BY 1")
def screen_causes(spark, d):
    """Names of a session by the first cause that screens them out."""
    s = returns(spark, d).withColumn("n", F.count("r").over(_by().rowsBetween(-59, 0)))
    cause = F.when(F.col("n") < 60, "short").when(F.col("volume") < 10, "thin").when(F.col("r").isNull(), "no_return").otherwise("kept")
    names = ("short", "thin", "no_return", "kept")
    return s.withColumn("c", cause).groupBy("date").agg(F.count(F.lit(1)).alias("names"), *(F.count_if(F.col("c") == x).alias(x) for x in names))


@query("k_unscored_months", f"WITH {RETURNS}, m AS (SELECT asset, date_trunc('month', date) AS month, count(r) AS n, stddev_samp(r) AS sd, max(abs(r)) AS big FROM rets GROUP BY 1, 2) SELECT asset, count(*) AS months, count(*) FILTER (WHERE n < 5) AS few, count(*) FILTER (WHERE n >= 5 AND NOT sd > 0) AS flat, count(*) FILTER (WHERE n >= 5 AND sd > 0 AND big > 2) AS wild, count(*) FILTER (WHERE n >= 5 AND sd > 0 AND big <= 2) AS scored FROM m GROUP BY 1")
def unscored_months(spark, d):
    m = returns(spark, d).groupBy("asset", month().alias("month")).agg(F.count("r").alias("n"), F.stddev_samp("r").alias("sd"), F.max(F.abs("r")).alias("big"))
    state = F.when(F.col("n") < 5, "few").when(~(F.col("sd") > 0), "flat").when(F.col("big") > 2, "wild").otherwise("scored")
    m = m.withColumn("state", state)
    return m.groupBy("asset").agg(F.count(F.lit(1)).alias("months"), *(F.count_if(F.col("state") == x).alias(x) for x in ("few", "flat", "wild", "scored")))


@query("k_recurring_drag", f"WITH {BARS}, z AS (SELECT asset, date_trunc('month', date) AS month, arg_max(cap, date) AS v FROM bars GROUP BY 1, 2), t AS (SELECT asset, month, v, abs(v - lag(v) OVER w) AS traded, row_number() OVER w AS k FROM z WINDOW w AS (PARTITION BY asset ORDER BY month)), b AS (SELECT month, sum(v) AS nav, sum(CASE WHEN k > 1 THEN traded END) AS traded FROM t GROUP BY 1) SELECT CAST(year(month) AS INTEGER) AS year, round(12 * avg(0.0005 * traded / nav), 7) AS spread, round(12 * avg(traded / nav) / 2, 4) AS turnover, count(traded) AS rebalances FROM b GROUP BY 1")
def recurring_drag(spark, d):
    """Cost and turnover over the book's value by rebalance, the first build left out, by year."""
    z = bars(spark, d).groupBy("asset", month().alias("month")).agg(F.max_by("cap", "date").alias("v"))
    t = z.withColumn("traded", F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("asset").orderBy("month"))))
    b = t.groupBy("month").agg(F.sum("v").alias("nav"), F.sum("traded").alias("traded"))
    share = F.col("traded") / F.col("nav")
    return b.groupBy(F.year("month").alias("year")).agg(rnd(12 * F.avg(0.0005 * share), 7).alias("spread"), rnd(12 * F.avg(share) / 2, 4).alias("turnover"), F.count("traded").alias("rebalances"))


@query("k_top_names", f"WITH {BARS}, s AS (SELECT date, asset, cap, row_number() OVER (PARTITION BY date ORDER BY cap DESC, asset) AS place FROM bars) SELECT date, asset, round(cap, 2) AS cap, place FROM s WHERE place <= 3")
def top_names(spark, d):
    """The three largest names of each session (a top-n listing)."""
    s = bars(spark, d).select("date", "asset", "cap", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("cap"), "asset")).alias("place"))
    return s.where("place <= 3").select("date", "asset", rnd("cap", 2).alias("cap"), "place")


@query("k_first_clean", f"WITH {RETURNS}, f AS (SELECT asset, date, abs(r) > 1 AS flagged FROM rets WHERE r IS NOT NULL), l AS (SELECT asset, max(date) FILTER (WHERE flagged) AS last FROM f GROUP BY 1) SELECT f.asset, min(f.date) AS first_clean, count(*) AS sessions FROM f JOIN l ON l.asset = f.asset WHERE l.last IS NULL OR f.date > l.last GROUP BY 1")
def first_clean(spark, d):
    """First session after the last flagged one."""
    f = returns(spark, d).where("r IS NOT NULL").select("asset", "date", (F.abs("r") > 1).alias("flagged"))
    x = f.withColumn("last", F.max(F.when(F.col("flagged"), F.col("date"))).over(Window.partitionBy("asset"))).where("last IS NULL OR date > last")
    return x.groupBy("asset").agg(F.min("date").alias("first_clean"), F.count(F.lit(1)).alias("sessions"))


@query("k_scored_window", f"WITH {RETURNS}, s AS (SELECT date, count(r) AS n, avg(abs(r)) AS a FROM rets GROUP BY 1), w AS (SELECT date, n >= 5 AS enough, a < 1.5 AS calm, count(*) OVER (ORDER BY date) > 60 AS old FROM s) SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS dates, count(*) FILTER (WHERE enough AND calm AND old) AS scored, count(*) FILTER (WHERE NOT enough) AS few, count(*) FILTER (WHERE enough AND NOT coalesce(calm, false)) AS wild FROM w GROUP BY 1")
def scored_window(spark, d):
    """Dates that meet all three conditions of a forecast window, and counts of those that don't."""
    s = returns(spark, d).groupBy("date").agg(F.count("r").alias("n"), F.avg(F.abs("r")).alias("a"))
    w = s.select("date", (F.col("n") >= 5).alias("enough"), F.coalesce(F.col("a") < 1.5, F.lit(False)).alias("calm"), (F.row_number().over(Window.orderBy("date")) > 60).alias("old"))
    return w.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("dates"), F.count_if(F.expr("enough AND calm AND old")).alias("scored"), F.count_if(F.expr("NOT enough")).alias("few"), F.count_if(F.expr("enough AND NOT calm")).alias("wild"))


@query("k_members_compared", f"WITH {RETURNS}, s AS (SELECT asset, asset % 5 AS bucket, stddev_samp(r) AS s FROM rets WHERE r IS NOT NULL GROUP BY 1), g AS (SELECT bucket, avg(s) AS mu, avg(s) FILTER (WHERE asset % 3 <> 0) AS mu2 FROM s GROUP BY 1) SELECT asset, round(0.5 * s + 0.5 * mu, 5) AS with_all, round(0.5 * s + 0.5 * mu2, 5) AS without, round(100 * ((0.5 * s + 0.5 * mu2) / (0.5 * s + 0.5 * mu) - 1), 3) AS change FROM s JOIN g ON g.bucket = s.bucket")
def members_compared(spark, d):
    """Shrunk volatility with and without some members in the bucket's mean."""
    s = returns(spark, d).where("r IS NOT NULL").groupBy("asset").agg(F.stddev_samp("r").alias("s")).withColumn("bucket", F.col("asset") % 5)
    w = Window.partitionBy("bucket")
    a, b = (0.5 * F.col("s") + 0.5 * F.avg(x).over(w) for x in (F.col("s"), F.when(F.col("asset") % 3 != 0, F.col("s"))))
    return s.withColumn("a", a).withColumn("b", b).select("asset", rnd("a").alias("with_all"), rnd("b").alias("without"), rnd(100 * (F.col("b") / F.col("a") - 1), 3).alias("change"))


@query("k_lags_compared", f"WITH {RETURNS}, x AS (SELECT asset, date, r, lag(r, 1) OVER w AS r1, lag(r, 2) OVER w AS r2 FROM rets WHERE r IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY date)), v AS (SELECT asset, avg(r * r) AS v0, avg(r * r) + 2 * (2.0 / 3) * avg(r * r1) + 2 * (1.0 / 3) * avg(r * r2) AS v2 FROM x GROUP BY 1) SELECT asset, round(sqrt(v0), 5) AS plain, round(CASE WHEN v2 > 0 THEN sqrt(v2 / v0) END, 4) AS ratio FROM v")
def lags_compared(spark, d):
    """Volatility with lag terms over that without."""
    x = returns(spark, d).where("r IS NOT NULL").select("asset", "r", F.lag("r", 1).over(_by()).alias("r1"), F.lag("r", 2).over(_by()).alias("r2"))
    v0 = F.avg(F.col("r") * F.col("r"))
    v = x.groupBy("asset").agg(v0.alias("v0"), (v0 + 2 * (2 / 3) * F.avg(F.col("r") * F.col("r1")) + 2 * (1 / 3) * F.avg(F.col("r") * F.col("r2"))).alias("v2"))
    return v.select("asset", rnd(F.sqrt("v0")).alias("plain"), rnd(F.when(F.col("v2") > 0, F.sqrt(F.col("v2") / F.col("v0"))), 4).alias("ratio"))


_PAIR = f"{_RM}, mo AS (SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, sum(r) AS y, sum(m) AS x, avg(volume) / 100 AS u FROM rm GROUP BY 1, 2)"


def _monthly_pair(spark, d):
    return _with_market(spark, d).groupBy("asset", month().alias("month")).agg(F.sum("r").alias("y"), F.sum("m").alias("x"), (F.avg("volume") / 100).alias("u"))


@query("k_comparand_fit", f"""WITH {_PAIR}, b AS (SELECT asset, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM mo GROUP BY 1), e AS (SELECT mo.asset, month, (y - alpha - beta * x) * (n * x - s) / (n * q - s * s) AS g, beta, n FROM mo JOIN b ON b.asset = mo.asset), l AS (SELECT *, lag(g, 1) OVER w AS g1, lag(g, 2) OVER w AS g2, lag(g, 3) OVER w AS g3 FROM e WINDOW w AS (PARTITION BY asset ORDER BY month))
SELECT asset, max(n) AS months, round(max(beta), 4) + 0.0 AS beta, round(sqrt(greatest(sum(g * g) + 2 * 0.75 * sum(coalesce(g * g1, 0)) + 2 * 0.5 * sum(coalesce(g * g2, 0)) + 2 * 0.25 * sum(coalesce(g * g3, 0)), 0)), 4) AS error FROM l GROUP BY 1""")
def comparand_fit(spark, d):
    """Monthly regression on a published series with HAC errors of three lags."""
    x = G.ols_hac(_monthly_pair(spark, d), "asset", "month", "y", "x", 3)
    return x.select("asset", F.col("n").alias("months"), rnd("beta", 4).alias("beta"), rnd("beta_error", 4).alias("error"))


@query("k_comparands_equal", f"WITH {_PAIR}, s AS (SELECT asset, (y - avg(y) OVER p) / stddev_samp(y) OVER p - (x - avg(x) OVER p) / stddev_samp(x) OVER p AS z, y - x AS raw, y, x FROM mo WINDOW p AS (PARTITION BY asset)) SELECT asset, round(max(abs(z)), 4) AS standardised, round(max(abs(raw)), 4) AS raw, round(corr(y, x), 4) + 0.0 AS corr, max(abs(raw)) > 1e-9 AS are_distinct FROM s GROUP BY 1")
def comparands_equal(spark, d):
    """Largest difference of two series, raw and standardised, their correlation, and whether they are two at all."""
    p = Window.partitionBy("asset")
    z = lambda c: (F.col(c) - F.avg(c).over(p)) / F.stddev_samp(c).over(p)
    s = _monthly_pair(spark, d).select("asset", "y", "x", (z("y") - z("x")).alias("z"), (F.col("y") - F.col("x")).alias("raw"))
    big = F.max(F.abs("raw"))
    return s.groupBy("asset").agg(rnd(F.max(F.abs("z")), 4).alias("standardised"), rnd(big, 4).alias("raw"), rnd(corr("y", "x"), 4).alias("corr"), (big > 1e-9).alias("are_distinct"))


@query("k_alpha_confound", f"""WITH {_PAIR}, s AS (SELECT asset, avg(y) AS my, avg(x) AS mx, avg(u) AS mu, covar_pop(y, x) AS p, covar_pop(y, u) AS q, var_pop(x) AS a, var_pop(u) AS b, covar_pop(x, u) AS o, count(*) AS n FROM mo GROUP BY 1)
SELECT asset, n AS months, round(my - p / a * mx, 4) + 0.0 AS alpha, round(my - (p * b - q * o) / (a * b - o * o) * mx - (q * a - p * o) / (a * b - o * o) * mu, 3) + 0.0 AS alpha_with FROM s""")
def alpha_confound(spark, d):
    """Intercept with and without a second regressor, from sums by asset."""
    s = _monthly_pair(spark, d).groupBy("asset").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"), F.avg("u").alias("mu"), F.covar_pop("y", "x").alias("p"), F.covar_pop("y", "u").alias("q"), F.var_pop("x").alias("a"), F.var_pop("u").alias("b"), F.covar_pop("x", "u").alias("o"), F.count(F.lit(1)).alias("n"))
    return s.select("asset", F.col("n").alias("months"), rnd(F.expr("my - p / a * mx"), 4).alias("alpha"), rnd(F.expr("my - (p * b - q * o) / (a * b - o * o) * mx - (q * a - p * o) / (a * b - o * o) * mu"), 3).alias("alpha_with"))


@query("k_kappa_sensitivity", f"WITH {RETURNS}, s AS (SELECT asset, avg(r) * 252 AS alpha, avg(trades) AS tau, avg((high - low) / close) / 100 AS kappa FROM rets WHERE r IS NOT NULL GROUP BY 1), g AS (SELECT unnest([{{'regime': 'patient', 'k': 0.58}}, {{'regime': 'urgent', 'k': 1.4}}]) AS g) SELECT asset, g.regime AS regime, round(CASE WHEN alpha > 0.001 AND kappa > 0 THEN pow((alpha - 0.001) / (tau * kappa * g.k), 2) END, 3) AS break_even, round(CASE WHEN alpha > 0.001 AND kappa > 0 THEN pow((alpha - 0.001) / (1.5 * tau * kappa * g.k), 2) END, 3) AS effective FROM s, g")
def kappa_sensitivity(spark, d):
    """Both capacity points under two prefactors of the impact."""
    s = returns(spark, d).where("r IS NOT NULL").groupBy("asset").agg((F.avg("r") * 252).alias("alpha"), F.avg("trades").alias("tau"), (F.avg((F.col("high") - F.col("low")) / F.col("close")) / 100).alias("kappa"))
    s = s.withColumn("g", F.explode(F.array(*(F.struct(F.lit(n).alias("regime"), F.lit(k).alias("k")) for n, k in (("patient", 0.58), ("urgent", 1.4))))))
    points = K.capacity(F.col("alpha"), F.col("tau"), F.col("kappa") * F.col("g.k"), 1.5, 0.001)
    return s.select("asset", "g.regime", rnd(points[0], 3).alias("break_even"), rnd(points[1], 3).alias("effective"))


@query("k_excess_panel", f"WITH {RETURNS}, c AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1e8 AS cash FROM orders GROUP BY 1) SELECT asset, rets.date, round(r - cash, 5) + 0.0 AS excess FROM rets JOIN c ON c.date = rets.date WHERE r IS NOT NULL")
def excess_panel(spark, d):
    """Return less the cash rate on shared dates."""
    c = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((F.avg("o_totalprice") / 1e8).alias("cash"))
    return returns(spark, d).where("r IS NOT NULL").join(c, "date").select("asset", "date", rnd(F.col("r") - F.col("cash")).alias("excess"))


@query("k_complete_panel", f"WITH {RETURNS}, g AS (SELECT date, asset % 4 AS g, avg(r) AS r FROM rets WHERE r IS NOT NULL GROUP BY 1, 2), n AS (SELECT date FROM g GROUP BY 1 HAVING count(*) = 4) SELECT g, count(*) AS dates, round(avg(r), 5) + 0.0 AS mean, round(stddev_samp(r), 5) AS sd FROM g JOIN n ON n.date = g.date GROUP BY 1")
def complete_panel(spark, d):
    """Groups of assets on the dates on which all four have a return."""
    g = returns(spark, d).where("r IS NOT NULL").groupBy("date", (F.col("asset") % 4).alias("g")).agg(F.avg("r").alias("r"))
    g = g.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date"))).where("n = 4")
    return g.groupBy("g").agg(F.count(F.lit(1)).alias("dates"), rnd(F.avg("r")).alias("mean"), rnd(F.stddev_samp("r")).alias("sd"))


@query("k_return_cross_check", f"WITH {_RM}, f AS (SELECT date, CAST(year(date) AS INTEGER) AS year, max(m) AS a, avg(r) AS b FROM rm GROUP BY 1, 2) SELECT year, count(*) AS n, round(avg(a - b) * 252, 4) + 0.0 AS gap, round(regr_slope(a, b), 4) + 0.0 AS slope, round(regr_intercept(a, b), 5) + 0.0 AS intercept, round(corr(a, b), 4) + 0.0 AS corr FROM f GROUP BY 1")
def return_cross_check(spark, d):
    """One return against another by year: gap, slope, intercept, correlation."""
    f = _with_market(spark, d).groupBy("date").agg(F.max("m").alias("a"), F.avg("r").alias("b"))
    return f.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(F.col("a") - F.col("b")) * 252, 4).alias("gap"), rnd(F.regr_slope("a", "b"), 4).alias("slope"), rnd(F.regr_intercept("a", "b")).alias("intercept"), rnd(corr("a", "b"), 4).alias("corr"))
