"""Queries over second moments, regressions, risk tests and the small solves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import moments as M
from . import solve as S
from .base import BARS, MARKET, RETURNS, VECTORS, bars, market, query, returns, rnd, vectors
from .running import numbered

_W = "pow(2.0, rn / 84.0)"
_COV = f"cov AS (SELECT label, i, j, sum({_W} * xi * xj) / sum({_W}) AS value FROM prs GROUP BY 1, 2, 3)"


def _cov(spark, d):
    p = M.pairs(vectors(spark, d), "label", "v", ["rn"])
    return M.second_moment(p, "label", F.pow(F.lit(2.0), F.col("rn") / 84.0))


@query("m_equal_second_moment", f"WITH {VECTORS} SELECT label, i, j, round(sum(xi * xj) / count(*), 5) + 0.0 AS value FROM prs GROUP BY 1, 2, 3")
def equal_second_moment(spark, d):
    return M.second_moment(M.pairs(vectors(spark, d), "label", "v", ["rn"]), "label").select("label", "i", "j", rnd("value").alias("value"))


@query("m_ewma_second_moment", f"WITH {VECTORS}, {_COV} SELECT label, i, j, round(value, 5) + 0.0 AS value FROM cov")
def ewma_second_moment(spark, d):
    return _cov(spark, d).select("label", "i", "j", rnd("value").alias("value"))


_CORR = "cor AS (SELECT a.label, a.i, a.j, CASE WHEN a.i = a.j THEN 1.0 ELSE a.value / sqrt(b.value * c.value) END AS value FROM cov a JOIN cov b ON a.label = b.label AND b.i = a.i AND b.j = a.i JOIN cov c ON a.label = c.label AND c.i = a.j AND c.j = a.j)"


@query("m_correlation", f"WITH {VECTORS}, {_COV}, {_CORR} SELECT label, i, j, round(value, 5) AS value FROM cor")
def correlation(spark, d):
    return M.correlation(_cov(spark, d), "label").select("label", "i", "j", rnd("value").alias("value"))


@query("m_two_half_lives", f"WITH {VECTORS}, v AS (SELECT label, i, sqrt(sum(pow(2.0, rn / 21.0) * xi * xi) / sum(pow(2.0, rn / 21.0))) AS s FROM prs WHERE i = j GROUP BY 1, 2), {_COV}, {_CORR} SELECT cor.label, cor.i, cor.j, round(cor.value * a.s * b.s, 5) + 0.0 AS value FROM cor JOIN v a ON a.label = cor.label AND a.i = cor.i JOIN v b ON b.label = cor.label AND b.i = cor.j")
def two_half_lives(spark, d):
    p = M.pairs(vectors(spark, d), "label", "v", ["rn"])
    w = F.pow(F.lit(2.0), F.col("rn") / 21.0)
    s = p.where("i = j").groupBy("label", "i").agg(F.sqrt(F.sum(w * F.col("xi") * F.col("xi")) / F.sum(w)).alias("si"))
    c = M.correlation(M.second_moment(p, "label", F.pow(F.lit(2.0), F.col("rn") / 84.0)), "label")
    return c.join(s, ["label", "i"]).join(s.select("label", F.col("i").alias("j"), F.col("si").alias("sj")), ["label", "j"]).select("label", "i", "j", rnd(F.col("value") * F.col("si") * F.col("sj")).alias("value"))


@query("m_newey_west", f"WITH {RETURNS}, x AS (SELECT asset, r, row_number() OVER w AS k, lag(r, 1) OVER w AS l1, lag(r, 2) OVER w AS l2 FROM rets WHERE r IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY date)), c AS (SELECT asset, sum(pow(2.0, k / 84.0) * r * r) / sum(pow(2.0, k / 84.0)) AS c0, " + ", ".join(f"sum(pow(2.0, k / 84.0) * r * l{q}) / sum(CASE WHEN l{q} IS NOT NULL THEN pow(2.0, k / 84.0) END) AS c{q}" for q in (1, 2)) + " FROM x GROUP BY 1), t AS (SELECT asset, c0, c0 + 2 * (2.0 / 3) * coalesce(c1, 0) + 2 * (1.0 / 3) * coalesce(c2, 0) AS nw FROM c) SELECT asset, round(c0, 5) AS plain, round(CASE WHEN nw > 0 THEN nw ELSE c0 END, 5) AS variance, nw <= 0 AS fell_back FROM t")
def newey_west(spark, d):
    x = M.newey_west_variance(returns(spark, d).where("r IS NOT NULL").select("asset", "date", "r"), "asset", "date", "r", 84, 2)
    return x.select("asset", rnd("plain").alias("plain"), rnd("variance").alias("variance"), "fell_back")


@query("m_effective_size", f"WITH {BARS}, n AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM bars) SELECT asset, round(pow(sum(pow(2.0, rn / 84.0)), 2) / sum(pow(2.0, rn / 42.0)), 4) AS size, round(2 * 84 / ln(2.0), 5) AS limit_size FROM n GROUP BY 1")
def effective_size(spark, d):
    n = returns(spark, d)
    w = F.pow(F.lit(2.0), F.col("rn") / 84.0)
    return n.groupBy("asset").agg(rnd(F.pow(F.sum(w), 2) / F.sum(F.pow(F.lit(2.0), F.col("rn") / 42.0)), 4).alias("size"), rnd(F.lit(2.0) * 84 / F.log(F.lit(2.0))).alias("limit_size"))


@query("m_bucket_dispersion", f"WITH {BARS}, v AS (SELECT asset, stddev_samp(ln(close)) AS s, avg(cap) AS cap FROM bars GROUP BY 1), b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY cap, asset) - 1) * 5 / count(*) OVER ()) AS INTEGER) AS bucket FROM v), g AS (SELECT bucket, avg(s) AS mu, stddev_pop(s) AS sd FROM b GROUP BY 1) SELECT asset, b.bucket, round(CASE WHEN abs(s - mu) + 0.1 * sd = 0 THEN s ELSE (abs(s - mu) / (abs(s - mu) + 0.1 * sd)) * 0 + s * (sd / (sd + 0.1 * abs(s - mu))) + (1 - sd / (sd + 0.1 * abs(s - mu))) * mu END, 5) AS shrunk FROM b JOIN g ON b.bucket = g.bucket WHERE sd > 0")
def bucket_dispersion(spark, d):
    """Volatility of each asset, drawn to its size bucket's mean by v = sd / (sd + q |s - mean|)."""
    v = bars(spark, d).groupBy("asset").agg(F.stddev_samp(F.log("close")).alias("s"), F.avg("cap").alias("cap"))
    # Ranks within classes of the cap's logarithm, and sums over the classes.
    n = v.agg(F.count(F.lit(1)).alias("_all"))  # one row
    b = numbered(v, [], ["cap", "asset"], F.floor(16 * F.log2("cap"))).crossJoin(F.broadcast(n)).withColumn("bucket", F.floor((F.col("rn") - 1) * 5 / F.col("_all")).cast("int")).drop("rn", "_all")
    w = Window.partitionBy("bucket")
    g = b.withColumn("mu", F.avg("s").over(w)).withColumn("sd", F.stddev_pop("s").over(w)).where("sd > 0")
    keep = F.col("sd") / (F.col("sd") + 0.1 * F.abs(F.col("s") - F.col("mu")))
    return g.select("asset", "bucket", rnd(F.col("s") * keep + (1 - keep) * F.col("mu")).alias("shrunk"))


@query("m_bias_statistic", f"WITH {RETURNS}, s AS (SELECT asset, date, r, stddev_samp(r) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s FROM rets WHERE r IS NOT NULL), z AS (SELECT asset, r / lag(s) OVER (PARTITION BY asset ORDER BY date) AS z FROM s) SELECT asset, round(stddev_samp(greatest(least(z, 4), -4)), 4) AS bias, count(z) AS n, round(avg(CASE WHEN abs(z) > 4 THEN 1.0 ELSE 0.0 END), 5) AS clipped FROM z WHERE z IS NOT NULL GROUP BY 1")
def bias_statistic(spark, d):
    z = _scores(spark, d)
    c = F.greatest(F.least("z", F.lit(4.0)), F.lit(-4.0))
    return z.groupBy("asset").agg(rnd(F.stddev_samp(c), 4).alias("bias"), F.count("z").alias("n"), rnd(F.avg(F.when(F.abs("z") > 4, 1.0).otherwise(0.0))).alias("clipped"))


def _scores(spark, d):
    w = Window.partitionBy("asset").orderBy("date")
    s = returns(spark, d).where("r IS NOT NULL").withColumn("s", F.stddev_samp("r").over(w.rowsBetween(-19, 0)))
    return s.select("asset", "date", "r", F.lag("s").over(w).alias("h"), (F.col("r") / F.lag("s").over(w)).alias("z")).where("z IS NOT NULL")


_Z = f"{RETURNS}, s AS (SELECT asset, date, r, stddev_samp(r) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s FROM rets WHERE r IS NOT NULL), z0 AS (SELECT asset, date, r, lag(s) OVER (PARTITION BY asset ORDER BY date) AS h FROM s), z AS (SELECT asset, date, r, h, r / h AS z FROM z0 WHERE h IS NOT NULL)"


@query("m_cross_sectional_bias", f"WITH {_Z} SELECT date, round(sqrt(avg(z * z)), 5) AS b, count(*) AS n FROM z GROUP BY 1")
def cross_sectional_bias(spark, d):
    return _scores(spark, d).groupBy("date").agg(rnd(F.sqrt(F.avg(F.col("z") * F.col("z")))).alias("b"), F.count(F.lit(1)).alias("n"))


@query("m_qlike", f"WITH {_Z} SELECT asset, round(avg(ln(h * h) + r * r / (h * h)), 4) AS loss FROM z GROUP BY 1")
def qlike(spark, d):
    h = F.col("h") * F.col("h")
    return _scores(spark, d).groupBy("asset").agg(rnd(F.avg(F.log(h) + F.col("r") * F.col("r") / h), 4).alias("loss"))


@query("m_breach_tests", f"WITH {_Z}, f AS (SELECT asset, date, CASE WHEN z < -1.645 THEN 1 ELSE 0 END AS b FROM z), t AS (SELECT asset, b, lag(b) OVER (PARTITION BY asset ORDER BY date) AS p FROM f) SELECT asset, count(*) AS n, sum(b) AS x, count(*) FILTER (WHERE p = 0 AND b = 0) AS n00, count(*) FILTER (WHERE p = 0 AND b = 1) AS n01, count(*) FILTER (WHERE p = 1 AND b = 0) AS n10, count(*) FILTER (WHERE p = 1 AND b = 1) AS n11, round(CASE WHEN sum(b) > 0 AND sum(b) < count(*) THEN 2 * (sum(b) * ln(sum(b) / count(*) / 0.05) + (count(*) - sum(b)) * ln((1 - sum(b) / count(*)) / 0.95)) END, 4) AS lr FROM t GROUP BY 1")
def breach_tests(spark, d):
    f = _scores(spark, d).select("asset", "date", F.when(F.col("z") < -1.645, 1).otherwise(0).alias("b"))
    t = f.withColumn("p", F.lag("b").over(Window.partitionBy("asset").orderBy("date")))
    n, x = F.count(F.lit(1)), F.sum("b")
    share = x / n
    lr = F.when((x > 0) & (x < n), 2 * (x * F.log(share / 0.05) + (n - x) * F.log((1 - share) / 0.95)))
    cell = lambda p, b: F.count_if((F.col("p") == p) & (F.col("b") == b)).alias(f"n{p}{b}")
    return t.groupBy("asset").agg(n.alias("n"), x.alias("x"), cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1), rnd(lr, 4).alias("lr"))


@query("m_calibration", f"WITH {_Z} SELECT asset, round(regr_slope(r * r, h * h), 3) AS slope, round(regr_intercept(r * r, h * h), 4) AS intercept, round(regr_r2(r * r, h * h), 4) AS r2, regr_count(r * r, h * h) AS n FROM z GROUP BY 1")
def calibration(spark, d):
    z = _scores(spark, d).withColumn("y", F.col("r") * F.col("r")).withColumn("x", F.col("h") * F.col("h"))
    return z.groupBy("asset").agg(rnd(F.regr_slope("y", "x"), 3).alias("slope"), rnd(F.regr_intercept("y", "x"), 4).alias("intercept"), rnd(F.regr_r2("y", "x"), 4).alias("r2"), F.regr_count("y", "x").alias("n"))


@query("m_tail_statistics", f"WITH {_Z} SELECT asset, round(sum(CASE WHEN z < -1.645 THEN z ELSE 0 END) / (count(*) * 0.05), 4) AS z2, round(quantile_cont(z, 0.05), 4) AS q05, round(avg(greatest(-1.645 - z, 0)), 5) AS ridge FROM z GROUP BY 1")
def tail_statistics(spark, d):
    z = F.col("z")
    return _scores(spark, d).groupBy("asset").agg(rnd(F.sum(F.when(z < -1.645, z).otherwise(0.0)) / (F.count(F.lit(1)) * 0.05), 4).alias("z2"), rnd(F.percentile("z", 0.05), 4).alias("q05"), rnd(F.avg(F.greatest(-1.645 - z, F.lit(0.0)))).alias("ridge"))


@query("m_weighted_quantile", f"WITH {BARS}, c AS (SELECT asset, close, date, cap, sum(cap) OVER (PARTITION BY asset ORDER BY close, date) AS cum, sum(cap) OVER (PARTITION BY asset) AS tot, first_value(cap) OVER (PARTITION BY asset ORDER BY close, date) AS w1 FROM bars), p AS (SELECT asset, close, (cum - cap) / nullif(tot - cap, 0) AS pos FROM c) SELECT asset, round(max(close) FILTER (WHERE pos <= 0.5), 5) AS low_median, count(*) AS n FROM p GROUP BY 1")
def weighted_quantile(spark, d):
    w = Window.partitionBy("asset")
    c = bars(spark, d).withColumn("cum", F.sum("cap").over(w.orderBy("close", "date").rowsBetween(Window.unboundedPreceding, 0))).withColumn("tot", F.sum("cap").over(w))
    p = c.withColumn("pos", F.try_divide(F.col("cum") - F.col("cap"), F.col("tot") - F.col("cap")))
    return p.groupBy("asset").agg(rnd(F.max(F.when(F.col("pos") <= 0.5, F.col("close")))).alias("low_median"), F.count(F.lit(1)).alias("n"))


@query("m_ols_market", f"WITH {MARKET} SELECT asset, round(regr_slope(r, m), 4) AS beta, round(regr_intercept(r, m), 5) AS alpha, round(regr_r2(r, m), 4) AS r2, count(*) AS n FROM rets JOIN mkt ON rets.date = mkt.date WHERE r IS NOT NULL GROUP BY 1")
def ols_market(spark, d):
    r = returns(spark, d)
    x = r.where("r IS NOT NULL").join(market(r), "date")
    return x.groupBy("asset").agg(rnd(F.regr_slope("r", "m"), 4).alias("beta"), rnd(F.regr_intercept("r", "m")).alias("alpha"), rnd(F.regr_r2("r", "m"), 4).alias("r2"), F.count(F.lit(1)).alias("n"))


@query("m_identity_shrinkage", f"WITH {VECTORS}, n AS (SELECT label, count(*) AS t FROM vecs GROUP BY 1), s AS (SELECT label, i, j, sum(xi * xj) / count(*) AS v FROM prs GROUP BY 1, 2, 3), q AS (SELECT label, count(*) FILTER (WHERE i = j) AS p, avg(v) FILTER (WHERE i = j) AS mu, sum(CASE WHEN i = j THEN v * v ELSE 2 * v * v END) AS sq FROM s GROUP BY 1) SELECT q.label, round(mu, 5) AS mu, round(least(1, ((1 - 2.0 / p) * sq + p * p * mu * mu) / ((t + 1 - 2.0 / p) * (sq - p * mu * mu))), 5) AS intensity FROM q JOIN n ON q.label = n.label")
def identity_shrinkage(spark, d):
    v = vectors(spark, d)
    s = M.second_moment(M.pairs(v, "label", "v", ["rn"]), "label")
    n = v.groupBy("label").agg(F.count(F.lit(1)).alias("t"))
    own, sq = F.col("i") == F.col("j"), F.col("value") * F.col("value")
    q = s.groupBy("label").agg(F.count_if(own).alias("p"), F.avg(F.when(own, F.col("value"))).alias("mu"), F.sum(F.when(own, sq).otherwise(2 * sq)).alias("sq")).join(n, "label")
    p, mu = F.col("p"), F.col("mu")
    top = (1 - 2.0 / p) * F.col("sq") + p * p * mu * mu
    return q.select("label", rnd("mu").alias("mu"), rnd(F.least(F.lit(1.0), top / ((F.col("t") + 1 - 2.0 / p) * (F.col("sq") - p * mu * mu)))).alias("intensity"))


@query("m_noise_edges", f"WITH {VECTORS} SELECT label, round(pow(1 - sqrt(max(len(embedding)) / count(*)), 2), 5) AS low, round(pow(1 + sqrt(max(len(embedding)) / count(*)), 2), 5) AS high FROM vecs GROUP BY 1")
def noise_edges(spark, d):
    q = F.sqrt(F.max(F.size("v")) / F.count(F.lit(1)))
    return vectors(spark, d).groupBy("label").agg(rnd(F.pow(1 - q, 2)).alias("low"), rnd(F.pow(1 + q, 2)).alias("high"))


@query("m_pairs_by_size", f"WITH {VECTORS}, {_COV}, {_CORR} SELECT label, i, j, round(value, 5) AS value FROM cor WHERE i < j AND abs(value) > 0.1")
def pairs_by_size(spark, d):
    return M.correlation(_cov(spark, d), "label").where("i < j AND abs(value) > 0.1").orderBy(F.abs("value").desc(), "label", "i", "j").select("label", "i", "j", rnd("value").alias("value"))


def _matrices(spark, d, corr=False):
    c = _cov(spark, d)
    return S.matrix_rows(M.both_triangles(M.correlation(c, "label") if corr else c, "label"), "label")


@query("s_spectrum")
def spectrum(spark, d):
    """Extreme eigenvalues, condition number and symmetry of each label's covariance."""
    return _matrices(spark, d).select("label", S.spectrum("n", "cells").alias("s")).select("label", *(rnd(f"s.{c}", 6).alias(c) for c in ("low", "high", "condition", "asymmetry")), "s.positive")


@query("s_psd_repair")
def psd_repair(spark, d):
    """Trace before and after the floor of eigenvalues that aren't positive."""
    m = _matrices(spark, d).withColumn("fixed", S.floored()("n", "cells"))
    trace = lambda c: F.expr(f"aggregate(sequence(0, n - 1), 0D, (a, k) -> a + {c}[k * n + k])")
    return m.select("label", rnd(trace("cells"), 5).alias("trace"), rnd(trace("fixed"), 5).alias("fixed"))


@query("s_denoise")
def denoise(spark, d):
    """Correlation of the first two factors before and after denoising at the noise edge."""
    n = vectors(spark, d).groupBy("label").agg(F.pow(1 + F.sqrt(F.max(F.size("v")) / F.count(F.lit(1))), 2).alias("edge"))
    m = _matrices(spark, d, True).join(n, "label").withColumn("clean", S.denoised()("n", "cells", "edge"))
    return m.select("label", rnd(F.expr("cells[1]")).alias("raw"), rnd(F.expr("clean[1]")).alias("clean"))


@query("s_variance_inflation")
def variance_inflation(spark, d):
    """Largest and mean variance inflation of each label's correlation."""
    v = _matrices(spark, d, True).select("label", S.variance_inflation()("n", "cells").alias("v"))
    return v.select("label", rnd(F.array_max("v"), 3).alias("most"), rnd(F.expr("aggregate(v, 0D, (a, x) -> a + x) / size(v)"), 3).alias("mean"))


@query("s_minimum_variance")
def minimum_variance(spark, d):
    """Weights of least variance: their sum, the largest, and the variance they have."""
    m = _matrices(spark, d).withColumn("w", S.minimum_variance()("n", "cells"))
    var = F.expr("aggregate(sequence(0, n - 1), 0D, (a, i) -> a + w[i] * aggregate(sequence(0, n - 1), 0D, (b, j) -> b + cells[i * n + j] * w[j]))")
    return m.select("label", rnd(F.expr("aggregate(w, 0D, (a, x) -> a + x)"), 6).alias("total"), rnd(F.array_max("w"), 4).alias("largest"), rnd(var, 6).alias("variance"))


@query("s_eigen_portfolios")
def eigen_portfolios(spark, d):
    """Weights of the first eigen portfolio, scaled to a sum of absolute weights of one."""
    m = _matrices(spark, d).select("label", "n", S.eigen_portfolios()("n", "cells").alias("v")).select("label", F.slice("v", F.lit(1), F.col("n")).alias("v"))
    return m.select("label", F.posexplode(F.expr("transform(v, x -> x / aggregate(v, 0D, (a, y) -> a + abs(y)))")).alias("factor", "w")).select("label", "factor", rnd("w", 4).alias("weight"))


@query("s_detoned")
def detoned(spark, d):
    """Mean correlation before and after the leading component is taken out."""
    m = _matrices(spark, d, True).withColumn("clean", S.detoned(1)("n", "cells"))
    mean = lambda c: F.expr(f"(aggregate({c}, 0D, (a, x) -> a + x) - n) / (n * (n - 1))")
    return m.select("label", rnd(mean("cells")).alias("raw"), rnd(mean("clean")).alias("clean"))


@query("s_eigen_scaled")
def eigen_scaled(spark, d):
    """Spectrum after scaling by a curve that falls from 1.2 to 0.9 over the eigenvalues."""
    m = _matrices(spark, d).withColumn("curve", F.expr("transform(sequence(0, n - 1), k -> 1.2D - 0.3D * k / (n - 1))"))
    m = m.withColumn("cells", S.eigen_scaled(1.4)("n", "cells", "curve"))
    return m.select("label", S.spectrum("n", "cells").alias("s")).select("label", rnd("s.low", 6).alias("low"), rnd("s.high", 6).alias("high"))


@query("s_present_factors")
def present_factors(spark, d):
    """Factors with a variance of their own, by label."""
    return _matrices(spark, d).select("label", "n", F.size(S.present_block(F.col("n"), F.col("cells"))).alias("present"))
