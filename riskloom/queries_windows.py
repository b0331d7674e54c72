"""Queries over rolling, expanding and decay windows, and cross-sections by date."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import windows as W
from . import xsection as X
from .base import BARS, MARKET, RETURNS, bars, corr, market, query, returns, rnd

_T20 = "PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
_EXP = "PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("w_lag_return", f"WITH {RETURNS} SELECT asset, date, round(exp(r) - 1, 5) AS r FROM rets WHERE r IS NOT NULL")
def lag_return(spark, d):
    return returns(spark, d).where("r IS NOT NULL").select("asset", "date", rnd(F.expm1("r")).alias("r"))


@query("w_backward_adjustment", f"""WITH {BARS}, x AS (SELECT asset, date, close, low / high AS k FROM bars)
SELECT asset, date, round(close * coalesce(exp(sum(ln(1 - 0.001 * k)) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1), 4) AS adjusted FROM x""")
def backward_adjustment(spark, d):
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    x = bars(spark, d).withColumn("k", F.col("low") / F.col("high"))
    return x.select("asset", "date", rnd(F.col("close") * F.coalesce(F.exp(F.sum(F.log(1 - 0.001 * F.col("k"))).over(w)), F.lit(1.0)), 4).alias("adjusted"))


@query("w_rolling_median_volume", f"WITH {BARS} SELECT asset, date, CASE WHEN count(cap) OVER w = 20 THEN round(quantile_cont(cap, 0.5) OVER w, 3) END AS median FROM bars WINDOW w AS ({_T20})")
def rolling_median(spark, d):
    w = W.trailing("asset", 20)
    return bars(spark, d).select("asset", "date", W.full(rnd(F.percentile("cap", 0.5).over(w), 3), F.col("cap"), w, 20).alias("median"))


@query("w_rolling_sd", f"WITH {RETURNS} SELECT asset, date, CASE WHEN count(r) OVER w = 20 THEN round(stddev_samp(r) OVER w, 5) END AS sd FROM rets WINDOW w AS ({_T20})")
def rolling_sd(spark, d):
    w = W.trailing("asset", 20)
    return returns(spark, d).select("asset", "date", rnd(W.full(F.stddev_samp("r").over(w), F.col("r"), w, 20)).alias("sd"))


@query("w_rolling_count_screen", f"WITH {BARS}, s AS (SELECT asset, date, sum(CASE WHEN trades >= 1 AND close > 0 THEN 1 ELSE 0 END) OVER w AS valid, avg(cap) OVER w AS adv FROM bars WINDOW w AS ({_T20})) SELECT date, count(*) FILTER (WHERE valid = 20) AS full_window, count(*) FILTER (WHERE valid = 20 AND adv > 40000) AS liquid, count(*) AS names FROM s GROUP BY 1")
def rolling_count_screen(spark, d):
    w = W.trailing("asset", 20)
    s = bars(spark, d).select("date", F.sum(F.when((F.col("trades") >= 1) & (F.col("close") > 0), 1).otherwise(0)).over(w).alias("valid"), F.avg("cap").over(w).alias("adv"))
    return s.groupBy("date").agg(F.count_if(F.col("valid") == 20).alias("full_window"), F.count_if((F.col("valid") == 20) & (F.col("adv") > 40_000)).alias("liquid"), F.count(F.lit(1)).alias("names"))


def _decay(x: str, h: int, w: str = "w") -> str:
    return f"(sum({x} * pow(2.0, rn / {h}.0)) OVER {w} / sum(CASE WHEN ({x}) IS NOT NULL THEN pow(2.0, rn / {h}.0) END) OVER {w})"


@query("w_decay_mean_sd", f"WITH {RETURNS} SELECT asset, date, round({_decay('r', 21)}, 5) AS mean, round(sqrt(greatest({_decay('r * r', 21)} - {_decay('r', 21)} * {_decay('r', 21)}, 0)), 5) AS sd FROM rets WHERE r IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def decay_mean_sd(spark, d):
    w = W.trailing("asset", 60)
    r = returns(spark, d).where("r IS NOT NULL")
    return r.select("asset", "date", rnd(W.decay_mean(F.col("r"), 21, w)).alias("mean"), rnd(W.decay_sd(F.col("r"), 21, w)).alias("sd"))


def _beta_frame(spark, d, rows: int, h: int):
    r = returns(spark, d)
    # The market's return of a date by a window, so that the bars are made once.
    ok, day = F.when(F.col("r").isNotNull(), F.col("lag_cap")), Window.partitionBy("date")
    x = r.withColumn("m", F.sum(ok * F.col("r")).over(day) / F.sum(ok).over(day)).where("r IS NOT NULL")
    return W.decay_beta(x.select("asset", "date", "rn", "lag_cap", "r", "m"), "asset", "date", "r", "m", h, rows).select("asset", "date", "lag_cap", "beta", "alpha", "resid")


def _beta_sql(rows: int, h: int) -> str:
    my, mx, mxx, mxy, myy = (_decay(c, h) for c in ("r", "m", "m * m", "r * m", "r * r"))
    return f"""{MARKET}, mom AS (SELECT asset, date, lag_cap, count(*) OVER w AS n, {my} AS my, {mx} AS mx, {mxx} AS mxx, {mxy} AS mxy, {myy} AS myy FROM (SELECT rets.*, mkt.m FROM rets JOIN mkt ON rets.date = mkt.date WHERE r IS NOT NULL) WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)),
beta AS (SELECT asset, date, lag_cap, CASE WHEN n = {rows} THEN (mxy - mx * my) / nullif(mxx - mx * mx, 0) END AS beta, n, my, mx, mxx, mxy, myy FROM mom)"""


@query("w_rolling_beta", f"WITH {_beta_sql(60, 21)} SELECT asset, date, round(beta, 4) AS beta, round(CASE WHEN n = 60 THEN my - beta * mx END, 5) AS alpha, round(CASE WHEN n = 60 THEN sqrt(greatest(myy - my * my - beta * (mxy - mx * my), 0)) END, 5) AS resid FROM beta")
def rolling_beta(spark, d):
    return _beta_frame(spark, d, 60, 21).select("asset", "date", rnd("beta", 4).alias("beta"), rnd("alpha").alias("alpha"), rnd("resid").alias("resid"))


_CLIP = """clipped AS (SELECT asset, date, lag_cap, beta, avg(beta) OVER d AS mu, stddev_samp(beta) OVER d AS sd FROM beta WHERE beta IS NOT NULL WINDOW d AS (PARTITION BY date)),
win AS (SELECT asset, date, lag_cap, CASE WHEN sd > 0 THEN greatest(least(beta, mu + 3 * sd), mu - 3 * sd) ELSE beta END AS x FROM clipped),
std AS (SELECT asset, date, (x - sum(x * lag_cap) OVER d / sum(lag_cap) OVER d) / nullif(stddev_samp(x) OVER d, 0) AS z FROM win WINDOW d AS (PARTITION BY date))"""


@query("flagship_exposures", f"WITH {_beta_sql(60, 21)}, {_CLIP} SELECT date, count(z) AS names, round(avg(z), 4) AS mean, round(stddev_samp(z), 4) AS sd FROM std GROUP BY 1")
def flagship(spark, d):
    """Market beta of each supplier, winsorised and standardised by session: names, mean and spread."""
    b = _beta_frame(spark, d, 60, 21).where("beta IS NOT NULL")
    x = b.withColumn("x", X.winsorise(F.col("beta"), 3.0))
    z = x.withColumn("z", X.standardise(F.col("x"), F.col("lag_cap")))
    return z.groupBy("date").agg(F.count("z").alias("names"), rnd(F.avg("z"), 4).alias("mean"), rnd(F.stddev_samp("z"), 4).alias("sd"))


@query("w_lagged_momentum", f"WITH {RETURNS}, x AS (SELECT asset, date, rn, {_decay('r', 21)} AS s, count(*) OVER w AS n FROM rets WHERE r IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)) SELECT asset, date, round(lag(CASE WHEN n = 40 THEN s END, 5) OVER (PARTITION BY asset ORDER BY date), 5) AS momentum FROM x")
def lagged_momentum(spark, d):
    w = W.trailing("asset", 40)
    x = returns(spark, d).where("r IS NOT NULL").withColumn("s", F.when(F.count(F.lit(1)).over(w) == 40, W.decay_mean(F.col("r"), 21, w)))
    return x.select("asset", "date", rnd(F.lag("s", 5).over(Window.partitionBy("asset").orderBy("date"))).alias("momentum"))


@query("w_cumulative_range", f"WITH {RETURNS}, c AS (SELECT asset, date, sum(coalesce(r, 0)) OVER ({_EXP}) AS c FROM rets), t AS (SELECT asset, date, " + ", ".join(f"c - lag(c, {10 * t}) OVER (PARTITION BY asset ORDER BY date) AS t{t}" for t in range(1, 5)) + " FROM c) SELECT asset, date, CASE WHEN t4 IS NOT NULL THEN round(greatest(t1, t2, t3, t4) - least(t1, t2, t3, t4), 5) END AS rng FROM t")
def cumulative_range(spark, d):
    w = Window.partitionBy("asset").orderBy("date")
    c = returns(spark, d).withColumn("c", F.sum(F.coalesce("r", F.lit(0.0))).over(W.expanding("asset")))
    t = c.select("asset", "date", *((F.col("c") - F.lag("c", 10 * k).over(w)).alias(f"t{k}") for k in range(1, 5)))
    cols = [f"t{k}" for k in range(1, 5)]
    return t.select("asset", "date", rnd(F.when(F.col("t4").isNotNull(), F.greatest(*cols) - F.least(*cols))).alias("rng"))


@query("w_log_turnover", f"WITH {BARS} SELECT asset, date, " + ", ".join(f"round(ln(avg(volume) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) / trades), 5) AS t{n}" for n in (5, 15, 60)) + " FROM bars")
def log_turnover(spark, d):
    return bars(spark, d).select("asset", "date", *(rnd(F.log(F.avg("volume").over(W.trailing("asset", n)) / F.col("trades"))).alias(f"t{n}") for n in (5, 15, 60)))


@query("w_cap_weighted_market", f"WITH {MARKET} SELECT date, round(m, 5) AS m, names FROM mkt")
def cap_weighted_market(spark, d):
    return market(returns(spark, d)).select("date", rnd("m").alias("m"), "names")


@query("w_rolling_correlation", f"WITH {MARKET} SELECT asset, rets.date, CASE WHEN count(*) OVER w = 36 THEN round(corr(r, m) OVER w, 4) END AS corr FROM rets JOIN mkt ON rets.date = mkt.date WHERE r IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY rets.date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)")
def rolling_correlation(spark, d):
    r = returns(spark, d)
    x = r.where("r IS NOT NULL").join(market(r), "date")
    w = W.trailing("asset", 36)
    return x.select("asset", "date", F.when(F.count(F.lit(1)).over(w) == 36, rnd(corr("r", "m", w), 4)).alias("corr"))


@query("w_expanding_moments", f"WITH {MARKET} SELECT asset, rets.date, CASE WHEN count(*) OVER w >= 24 THEN round(covar_samp(r, m) OVER w, 5) END AS cov, CASE WHEN count(*) OVER w >= 24 THEN round(stddev_samp(r) OVER w, 5) END AS sd FROM rets JOIN mkt ON rets.date = mkt.date WHERE r IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY rets.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def expanding_moments(spark, d):
    r = returns(spark, d)
    x = r.where("r IS NOT NULL").join(market(r), "date")
    w = W.expanding("asset")
    ok = F.count(F.lit(1)).over(w) >= 24
    return x.select("asset", "date", F.when(ok, rnd(F.covar_samp("r", "m").over(w))).alias("cov"), F.when(ok, rnd(F.stddev_samp("r").over(w))).alias("sd"))


@query("w_expanding_residual", f"WITH {MARKET}, x AS (SELECT asset, rets.date, r, m, count(*) OVER w AS n, avg(r) OVER w AS my, avg(m) OVER w AS mx, avg(r * m) OVER w AS mxy, avg(m * m) OVER w AS mxx FROM rets JOIN mkt ON rets.date = mkt.date WHERE r IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY rets.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT asset, date, CASE WHEN n >= 24 THEN round(r - my - (mxy - mx * my) / (mxx - mx * mx) * (m - mx), 5) END AS residual FROM x")
def expanding_residual(spark, d):
    r = returns(spark, d)
    x = r.where("r IS NOT NULL").join(market(r), "date")
    w = W.expanding("asset")
    my, mx, mxy, mxx = (F.avg(c).over(w) for c in (F.col("r"), F.col("m"), F.col("r") * F.col("m"), F.col("m") * F.col("m")))
    res = F.col("r") - my - (mxy - mx * my) / (mxx - mx * mx) * (F.col("m") - mx)
    return x.select("asset", "date", rnd(F.when(F.count(F.lit(1)).over(w) >= 24, res)).alias("residual"))


@query("w_jumps", f"WITH {BARS}, x AS (SELECT asset, date, close / lag(close) OVER (PARTITION BY asset ORDER BY date) AS ratio FROM bars) SELECT asset, date, round(ratio, 5) AS ratio FROM x WHERE ratio > 1.8 OR ratio < 1 / 1.8")
def jumps(spark, d):
    x = bars(spark, d).select("asset", "date", (F.col("close") / F.lag("close").over(Window.partitionBy("asset").orderBy("date"))).alias("ratio"))
    return x.where((F.col("ratio") > 1.8) | (F.col("ratio") < F.lit(1.0) / 1.8)).select("asset", "date", rnd("ratio").alias("ratio"))


@query("w_consistency_screen", f"WITH {BARS}, m AS (SELECT asset, quantile_cont(volume, 0.5) AS med FROM bars GROUP BY 1) SELECT bars.asset, count(*) FILTER (WHERE volume BETWEEN med / 2 AND med * 2) AS kept, count(*) FILTER (WHERE NOT (volume BETWEEN med / 2 AND med * 2)) AS dropped FROM bars JOIN m ON bars.asset = m.asset GROUP BY 1")
def consistency_screen(spark, d):
    b = bars(spark, d)
    m = b.groupBy("asset").agg(F.percentile("volume", 0.5).alias("med"))
    ok = F.col("volume").between(F.col("med") / 2, F.col("med") * 2)
    return b.join(m, "asset").groupBy("asset").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query("w_size_buckets", f"WITH {BARS} SELECT asset, date, CAST(floor((row_number() OVER (PARTITION BY date ORDER BY cap, asset) - 1) * 5 / count(*) OVER (PARTITION BY date)) AS BIGINT) AS bucket FROM bars")
def size_buckets(spark, d):
    return bars(spark, d).select("asset", "date", X.buckets([F.col("cap"), F.col("asset")], 5).alias("bucket"))


@query("w_autocorrelations", f"WITH {RETURNS}, c AS (SELECT asset, date, r - avg(r) OVER (PARTITION BY asset) AS x FROM rets WHERE r IS NOT NULL), l AS (SELECT asset, x, " + ", ".join(f"lag(x, {k}) OVER (PARTITION BY asset ORDER BY date) AS l{k}" for k in range(1, 6)) + " FROM c) SELECT asset, " + ", ".join(f"round(sum(x * l{k}) / sum(x * x), 4) AS rho{k}" for k in range(1, 6)) + ", round(count(*) * (count(*) + 2) * (" + " + ".join(f"pow(sum(x * l{k}) / sum(x * x), 2) / (count(*) - {k})" for k in range(1, 6)) + "), 3) AS q FROM l GROUP BY 1")
def autocorrelations(spark, d):
    r = returns(spark, d).where("r IS NOT NULL")
    c = r.select("asset", "date", (F.col("r") - F.avg("r").over(Window.partitionBy("asset"))).alias("x"))
    w = Window.partitionBy("asset").orderBy("date")
    c = c.select("asset", "x", *(F.lag("x", k).over(w).alias(f"l{k}") for k in range(1, 6)))
    rho = {k: F.sum(F.col("x") * F.col(f"l{k}")) / F.sum(F.col("x") * F.col("x")) for k in range(1, 6)}
    n = F.count(F.lit(1))
    q = n * (n + 2) * sum(F.pow(rho[k], 2) / (n - k) for k in rho)
    return c.groupBy("asset").agg(*(rnd(rho[k], 4).alias(f"rho{k}") for k in rho), rnd(q, 3).alias("q"))


@query("w_traffic_blocks", f"WITH {RETURNS}, s AS (SELECT asset, date, r, stddev_samp(r) OVER ({_T20}) AS s, count(r) OVER ({_T20}) AS c FROM rets WHERE r IS NOT NULL), z0 AS (SELECT asset, date, r / lag(s) OVER (PARTITION BY asset ORDER BY date) AS z FROM s), z AS (SELECT asset, z, row_number() OVER (PARTITION BY asset ORDER BY date) AS k, count(*) OVER (PARTITION BY asset) AS n FROM z0 WHERE z IS NOT NULL), b AS (SELECT asset, CAST(floor((k - 1) / 50) AS BIGINT) AS block, count(*) FILTER (WHERE z < -1.645) AS breaches FROM z WHERE floor((k - 1) / 50) < floor(n / 50) GROUP BY 1, 2) SELECT asset, block, breaches, CASE WHEN breaches <= 4 THEN 'green' WHEN breaches <= 7 THEN 'yellow' ELSE 'red' END AS zone FROM b")
def traffic_blocks(spark, d):
    """Breaches of a lagged rolling sd by non-overlapping block of 50 rows; the incomplete last block is left out."""
    w = Window.partitionBy("asset").orderBy("date")
    z = returns(spark, d).where("r IS NOT NULL").withColumn("s", F.stddev_samp("r").over(W.trailing("asset", 20)))
    z = z.withColumn("z", F.col("r") / F.lag("s").over(w)).where("z IS NOT NULL").withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("asset")))
    b = z.withColumn("block", F.floor((F.col("k") - 1) / 50)).where(F.col("block") < F.floor(F.col("n") / 50)).groupBy("asset", "block").agg(F.count_if(F.col("z") < -1.645).alias("breaches"))
    return b.withColumn("zone", F.when(F.col("breaches") <= 4, "green").when(F.col("breaches") <= 7, "yellow").otherwise("red"))


@query("x_winsorise", f"WITH {RETURNS}, s AS (SELECT asset, date, r, avg(r) OVER d AS m, stddev_samp(r) OVER d AS sd FROM rets WHERE r IS NOT NULL WINDOW d AS (PARTITION BY date)) SELECT asset, date, round(CASE WHEN sd > 0 THEN greatest(least(r, m + 1.5 * sd), m - 1.5 * sd) ELSE r END, 5) AS x FROM s")
def winsorise(spark, d):
    return returns(spark, d).where("r IS NOT NULL").select("asset", "date", rnd(X.winsorise(F.col("r"), 1.5)).alias("x"))


@query("x_standardise", f"WITH {BARS}, s AS (SELECT asset, date, (ln(volume) - sum(ln(volume) * cap) OVER d / sum(cap) OVER d) / nullif(stddev_samp(ln(volume)) OVER d, 0) AS z FROM bars WINDOW d AS (PARTITION BY date)) SELECT asset, date, round(z, 4) AS z FROM s")
def standardise(spark, d):
    return bars(spark, d).select("asset", "date", rnd(X.standardise(F.log("volume"), F.col("cap")), 4).alias("z"))


@query("x_orthogonalise", f"WITH {BARS}, x AS (SELECT asset, date, ln(close) AS y, ln(volume) AS x, sqrt(cap) AS w FROM bars), s AS (SELECT *, sum(w) OVER d AS n, sum(w * y) OVER d / sum(w) OVER d AS my, sum(w * x) OVER d / sum(w) OVER d AS mx, sum(w * x * y) OVER d / sum(w) OVER d AS mxy, sum(w * x * x) OVER d / sum(w) OVER d AS mxx FROM x WINDOW d AS (PARTITION BY date)) SELECT asset, date, round(y - my - coalesce(CASE WHEN mxx - mx * mx > 1e-15 THEN (mxy - mx * my) / (mxx - mx * mx) END, 0) * (x - mx), 4) AS residual FROM s WHERE mxx - mx * mx > 1e-6")
def orthogonalise(spark, d):
    x = bars(spark, d).select("asset", "date", F.log("close").alias("y"), F.log("volume").alias("x"), F.sqrt("cap").alias("w"))
    wd = Window.partitionBy("date")
    n = F.sum("w").over(wd)
    spread = F.sum(F.col("w") * F.col("x") * F.col("x")).over(wd) / n - F.pow(F.sum(F.col("w") * F.col("x")).over(wd) / n, 2)
    return x.withColumn("s", spread).withColumn("e", X.orthogonalise(F.col("y"), F.col("x"), F.col("w"))).where("s > 1e-6").select("asset", "date", rnd("e", 4).alias("residual"))


@query("x_demean", f"WITH {RETURNS} SELECT asset, date, CASE WHEN count(r) OVER (PARTITION BY date) = count(*) OVER (PARTITION BY date) THEN round(r - avg(r) OVER (PARTITION BY date), 5) END AS x FROM rets")
def demean(spark, d):
    return returns(spark, d).select("asset", "date", rnd(X.demean(F.col("r"))).alias("x"))


@query("x_daily_correlation", f"WITH {BARS}, c AS (SELECT date, corr(ln(close), ln(volume)) AS c, count(*) AS n FROM bars GROUP BY 1) SELECT round(avg(c), 5) AS mean, count(*) AS dates FROM c WHERE n >= 10")
def daily_correlation(spark, d):
    b = bars(spark, d).select("date", F.log("close").alias("x"), F.log("volume").alias("y"))
    c = b.groupBy("date").agg(corr("x", "y").alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    return c.agg(rnd(F.avg("c")).alias("mean"), F.count(F.lit(1)).alias("dates"))


@query("x_rank_correlation", f"WITH {BARS}, r AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0 AS b FROM bars) SELECT date, round(corr(a, b), 5) AS rho, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 10 AND stddev_pop(b) > 0 AND stddev_pop(a) > 0")
def rank_correlation(spark, d):
    b = bars(spark, d)
    r = b.select("date", X.mid_rank(F.col("close"), ["date"]).alias("a"), X.mid_rank(F.col("volume"), ["date"]).alias("b"))
    return r.groupBy("date").agg(corr("a", "b").alias("rho"), F.count(F.lit(1)).alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb")).where("n >= 10 AND sa > 0 AND sb > 0").select("date", rnd("rho").alias("rho"), "n")
