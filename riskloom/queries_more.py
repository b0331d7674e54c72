"""Further queries: scenarios, coverage, blocks, panels of estimates, books of weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import book as K
from . import moments as M
from . import regress as G
from . import windows as W
from .base import BARS, MARKET, RETURNS, VECTORS, bars, corr, market, query, returns, rnd, table, vectors


@query("e_lagged_pairs", f"WITH {VECTORS} SELECT a.label, a.i, b.i AS j, round(sum(a.x * b.x) / count(*), 5) + 0.0 AS value FROM long a JOIN long b ON a.label = b.label AND a.rn = b.rn + 1 GROUP BY 1, 2, 3")
def lagged_pairs(spark, d):
    """Lag-one second moments over all pairs of factors: the lag is a window over the vector column."""
    v = vectors(spark, d).withColumn("p", F.lag("v").over(Window.partitionBy("label").orderBy("rn"))).where("p IS NOT NULL")
    x = v.select("label", "p", F.posexplode("v").alias("i", "a")).select("label", "i", "a", F.posexplode("p").alias("j", "b"))
    return x.groupBy("label", "i", "j").agg(rnd(F.sum(F.col("a") * F.col("b")) / F.count(F.lit(1))).alias("value"))


@query("e_scenarios", "SELECT r_name AS variant, n_name AS treatment, r_regionkey * 100 + n_nationkey AS id FROM region, nation")
def scenarios(spark, d):
    """Every variant with every treatment: two dimensions of fixed size."""
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select(F.col("r_name").alias("variant"), F.col("n_name").alias("treatment"), (F.col("r_regionkey") * 100 + F.col("n_nationkey")).alias("id"))


@query("e_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))")
def grouping_sets(spark, d):
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))", orders=table(spark, d, "orders"))


@query("e_rollup_years", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def rollup_years(spark, d):
    return table(spark, d, "orders").withColumn("year", F.year("o_orderdate")).rollup("year", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("e_crisis_multiple", f"WITH {BARS}, m AS (SELECT date, quantile_cont((high - low) / close, 0.5) AS s FROM bars GROUP BY 1), w(name, s0, s1) AS (VALUES ('first', DATE '1996-03-01', DATE '1996-06-01'), ('second', DATE '1998-03-01', DATE '1998-06-01')) SELECT name, round(quantile_cont(s, 0.5) FILTER (WHERE date < s0), 5) AS before, round(max(s) FILTER (WHERE date >= s0), 5) AS peak FROM m JOIN w ON date >= s0 - INTERVAL 12 MONTH AND date < s1 GROUP BY 1")
def crisis_multiple(spark, d):
    m = bars(spark, d).withColumn("x", (F.col("high") - F.col("low")) / F.col("close")).groupBy("date").agg(F.percentile("x", 0.5).alias("s"))
    w = spark.createDataFrame([("first", "1996-03-01", "1996-06-01"), ("second", "1998-03-01", "1998-06-01")], "name string, a string, b string").select("name", F.to_date("a").alias("s0"), F.to_date("b").alias("s1"))
    j = m.join(w, (F.col("date") >= F.add_months("s0", -12)) & (F.col("date") < F.col("s1")))
    early = F.col("date") < F.col("s0")
    return j.groupBy("name").agg(rnd(F.percentile(F.when(early, F.col("s")), 0.5)).alias("before"), rnd(F.max(F.when(~early, F.col("s")))).alias("peak"))


@query("e_negative_share", f"WITH {RETURNS} SELECT asset, count(r) AS n, count(*) FILTER (WHERE r < 0) AS negative, round(min(r), 5) AS lowest FROM rets GROUP BY 1")
def negative_share(spark, d):
    return returns(spark, d).groupBy("asset").agg(F.count("r").alias("n"), F.count_if(F.col("r") < 0).alias("negative"), rnd(F.min("r")).alias("lowest"))


@query("e_off_scale_cells", f"WITH {BARS}, m AS (SELECT asset, quantile_cont(volume, 0.5) AS med, count(*) AS base FROM bars GROUP BY 1) SELECT m.asset, base, count(*) FILTER (WHERE volume > 3 * med) AS high, count(*) FILTER (WHERE volume < med / 3) AS low FROM bars JOIN m ON bars.asset = m.asset GROUP BY 1, 2")
def off_scale_cells(spark, d):
    b = bars(spark, d)
    m = b.groupBy("asset").agg(F.percentile("volume", 0.5).alias("med"), F.count(F.lit(1)).alias("base"))
    return b.join(m, "asset").groupBy("asset", "base").agg(F.count_if(F.col("volume") > 3 * F.col("med")).alias("high"), F.count_if(F.col("volume") < F.col("med") / 3).alias("low"))


@query("e_dollar_share", f"WITH {BARS} SELECT date, round(sum(CASE WHEN trades = 1 THEN cap ELSE 0 END) / sum(cap), 5) AS share FROM bars GROUP BY 1")
def dollar_share(spark, d):
    return bars(spark, d).groupBy("date").agg(rnd(F.sum(F.when(F.col("trades") == 1, F.col("cap")).otherwise(0.0)) / F.sum("cap")).alias("share"))


@query("e_year_end_totals", f"WITH {BARS}, t AS (SELECT date, sum(cap) AS total, count(*) AS names FROM bars GROUP BY 1), y AS (SELECT max(date) AS date FROM t GROUP BY year(date)) SELECT t.date, round(total, 2) AS total, names FROM t JOIN y ON t.date = y.date")
def year_end_totals(spark, d):
    t = bars(spark, d).groupBy("date").agg(F.sum("cap").alias("total"), F.count(F.lit(1)).alias("names"))
    last = t.groupBy(F.year("date").alias("y")).agg(F.max_by(F.struct("date", "total", "names"), "date").alias("x"))
    return last.select("x.date", rnd("x.total", 2).alias("total"), "x.names")


@query("e_holding_spells", f"WITH {BARS}, m AS (SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS stop FROM bars GROUP BY 1, 2) SELECT asset, lag(stop) OVER (PARTITION BY asset ORDER BY month) AS start, stop FROM m")
def holding_spells(spark, d):
    m = bars(spark, d).groupBy("asset", F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("stop"))
    return m.select("asset", F.lag("stop").over(Window.partitionBy("asset").orderBy("month")).alias("start"), "stop")


@query("e_regime_multiplier", f"""WITH {RETURNS}, s AS (SELECT asset, date, r, stddev_samp(r) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s FROM rets WHERE r IS NOT NULL), z AS (SELECT date, r / lag(s) OVER (PARTITION BY asset ORDER BY date) AS z FROM s),
b AS (SELECT date, avg(z * z) AS b2, row_number() OVER (ORDER BY date) AS rn FROM z WHERE z IS NOT NULL GROUP BY 1) SELECT date, round(sqrt(sum(b2 * pow(2.0, rn / 42.0)) OVER w / sum(pow(2.0, rn / 42.0)) OVER w), 4) AS lambda FROM b WINDOW w AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
def regime_multiplier(spark, d):
    """Decayed mean of the squared daily bias: one row a date is left before the ordered window."""
    w = Window.partitionBy("asset").orderBy("date")
    s = returns(spark, d).where("r IS NOT NULL").withColumn("s", F.stddev_samp("r").over(w.rowsBetween(-19, 0)))
    b = s.withColumn("z", F.col("r") / F.lag("s").over(w)).where("z IS NOT NULL").groupBy("date").agg(F.avg(F.col("z") * F.col("z")).alias("b2")).withColumn("one", F.lit(1))
    b = W.numbered(b, "one")
    return b.select("date", rnd(F.sqrt(W.decay_mean(F.col("b2"), 42, W.trailing("one", 252))), 4).alias("lambda"))


@query("e_sub_periods", f"WITH {RETURNS}, k AS (SELECT asset, r, CAST(floor((year(date) * 12 + month(date) - 1) / 6) AS BIGINT) AS block FROM rets WHERE r IS NOT NULL) SELECT asset, block, round(stddev_samp(r), 5) AS sd, count(*) AS n FROM k GROUP BY 1, 2")
def sub_periods(spark, d):
    k = returns(spark, d).where("r IS NOT NULL").withColumn("block", F.floor((F.year("date") * 12 + F.month("date") - 1) / 6))
    return k.groupBy("asset", "block").agg(rnd(F.stddev_samp("r")).alias("sd"), F.count(F.lit(1)).alias("n"))


@query("e_constant_correlation", f"WITH {VECTORS}, s AS (SELECT label, i, j, sum(xi * xj) / count(*) AS v FROM prs GROUP BY 1, 2, 3), c AS (SELECT a.label, a.i, a.j, a.v / sqrt(b.v * c.v) AS rho FROM s a JOIN s b ON a.label = b.label AND b.i = a.i AND b.j = a.i JOIN s c ON a.label = c.label AND c.i = a.j AND c.j = a.j WHERE a.i < a.j) SELECT label, round(avg(rho), 5) AS rbar, count(*) AS pairs FROM c GROUP BY 1")
def constant_correlation(spark, d):
    s = M.second_moment(M.pairs(vectors(spark, d), "label", "v", ["rn"]), "label")
    return M.correlation(s, "label").where("i < j").groupBy("label").agg(rnd(F.avg("value")).alias("rbar"), F.count(F.lit(1)).alias("pairs"))


@query("e_placebo_matrix", f"WITH {VECTORS}, p AS (SELECT a.label, a.i, b.i AS j, a.x AS x, b.x AS y FROM long a JOIN long b ON a.label = b.label AND a.rn = b.rn WHERE a.i <> b.i) SELECT label, i, j, round(regr_r2(y, x), 5) AS r2 FROM p GROUP BY 1, 2, 3")
def placebo_matrix(spark, d):
    v = vectors(spark, d)
    x = v.select("label", "v", F.posexplode("v").alias("i", "x"))
    p = x.select("label", "i", "x", F.posexplode("v").alias("j", "y")).where("i <> j")
    return p.groupBy("label", "i", "j").agg(rnd(F.regr_r2("y", "x")).alias("r2"))


@query("e_shepard_table", "WITH h AS (SELECT DISTINCT p_size AS k FROM part), t AS (SELECT unnest([120, 252, 504]) AS t) SELECT k, t, round(1 / pow(1 - k / t, 2) - 1, 6) AS understated, round(1 / (1 - k / t) - 1, 6) AS volatility FROM h, t")
def shepard_table(spark, d):
    h = table(spark, d, "part").select(F.col("p_size").alias("k")).distinct()
    t = h.withColumn("t", F.explode(F.array(F.lit(120), F.lit(252), F.lit(504))))
    return t.select("k", "t", rnd(1 / F.pow(1 - F.col("k") / F.col("t"), 2) - 1, 6).alias("understated"), rnd(1 / (1 - F.col("k") / F.col("t")) - 1, 6).alias("volatility"))


@query("e_vintage_collapse", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS last_observation, min(o_orderkey) AS first_seen, count(*) AS n FROM orders GROUP BY 1, 2")
def vintage_collapse(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("last_observation")).agg(F.min("o_orderkey").alias("first_seen"), F.count(F.lit(1)).alias("n"))


@query("e_limit_summary", f"WITH {RETURNS} SELECT asset, count(*) FILTER (WHERE abs(r) > 0.2) AS binding, count(*) FILTER (WHERE abs(r) <= 0.2) AS relaxed, round(quantile_cont(abs(r), 0.5), 5) AS median, round(quantile_cont(abs(r), 0.8), 5) AS p80, round(max(abs(r)), 5) AS largest FROM rets WHERE r IS NOT NULL GROUP BY 1")
def limit_summary(spark, d):
    x = F.abs("r")
    return returns(spark, d).where("r IS NOT NULL").groupBy("asset").agg(F.count_if(x > 0.2).alias("binding"), F.count_if(x <= 0.2).alias("relaxed"), rnd(F.percentile(x, 0.5)).alias("median"), rnd(F.percentile(x, 0.8)).alias("p80"), rnd(F.max(x)).alias("largest"))


@query("e_tracking_split", f"WITH {MARKET}, b AS (SELECT asset, regr_slope(r, m) AS beta, var_samp(r) AS total, var_samp(m) AS vm, corr(r, m) AS rho FROM rets JOIN mkt ON rets.date = mkt.date WHERE r IS NOT NULL GROUP BY 1) SELECT asset, round(beta * beta * vm, 5) AS factor, round(total - beta * beta * vm, 5) AS specific, round(rho, 4) AS rho FROM b")
def tracking_split(spark, d):
    r = returns(spark, d)
    x = r.where("r IS NOT NULL").join(market(r), "date")
    b = x.groupBy("asset").agg(F.regr_slope("r", "m").alias("beta"), F.var_samp("r").alias("total"), F.var_samp("m").alias("vm"), corr("r", "m").alias("rho"))
    part = F.col("beta") * F.col("beta") * F.col("vm")
    return b.select("asset", rnd(part).alias("factor"), rnd(F.col("total") - part).alias("specific"), rnd("rho", 4).alias("rho"))


@query("e_crossing", f"WITH {RETURNS}, c AS (SELECT asset, date, sum(r) OVER (PARTITION BY asset ORDER BY date) AS c FROM rets WHERE r IS NOT NULL) SELECT asset, min(date) FILTER (WHERE c <= 0) AS first_loss, arg_max(date, c) AS peak FROM c GROUP BY 1")
def crossing(spark, d):
    c = returns(spark, d).where("r IS NOT NULL").withColumn("c", F.sum("r").over(W.expanding("asset")))
    return c.groupBy("asset").agg(F.min(F.when(F.col("c") <= 0, F.col("date"))).alias("first_loss"), F.max_by("date", "c").alias("peak"))


@query("e_book_accounting", f"WITH {RETURNS}, m AS (SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, exp(sum(r)) - 1 AS r, avg(abs(r)) AS t FROM rets WHERE r IS NOT NULL GROUP BY 1, 2), c AS (SELECT asset, month, r, 0.001 * t + 0.002 * t * sqrt(t) AS c FROM m), n AS (SELECT asset, month, c, exp(sum(ln((1 - c) * (1 + r))) OVER (PARTITION BY asset ORDER BY month)) AS nav FROM c) SELECT asset, month, round(nav, 5) AS nav, round(coalesce(lag(nav) OVER (PARTITION BY asset ORDER BY month), 1) * c, 7) AS cost FROM n")
def book_accounting(spark, d):
    """NAV of each book over its monthly rebalances; costs are a share of the NAV before."""
    r = returns(spark, d).where("r IS NOT NULL").groupBy("asset", F.trunc("date", "MM").alias("month")).agg(F.expm1(F.sum("r")).alias("r"), F.avg(F.abs("r")).alias("t"))
    out = K.book(r.withColumn("c", 0.001 * F.col("t") + 0.002 * F.col("t") * F.sqrt("t")), "asset", "month", "r", "c")
    return out.select("asset", "month", rnd("nav").alias("nav"), rnd("cost", 7).alias("cost"))


def _day_panel(spark, d):
    """Return of a session with the region, size and value of the one before; sessions with ten names and more."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("asset"), F.col("n_regionkey").alias("industry"))
    r = returns(spark, d).where("r IS NOT NULL").withColumn("style", F.log("lag_cap")).join(s, "asset")
    wd = Window.partitionBy("date")
    r = r.withColumn("style", F.col("style") - F.avg("style").over(wd)).withColumn("n", F.count(F.lit(1)).over(wd)).where("n >= 10")
    return r.select("date", "asset", "industry", F.col("lag_cap").alias("cap"), "style", "r")


@query("e_constrained_regression")
def constrained_regression(spark, d):
    """Daily cross-sectional regression on country, regions and size, all known the session before."""
    out = G.constrained_wls(_day_panel(spark, d), "date", "r", "industry", ["style"], "cap")
    rows = out.select("date", "country", "r2", "condition", "eliminated", F.explode(F.map_concat(F.map_from_arrays("industries", "industry_returns"), F.create_map(F.lit(-1), F.col("style_returns")[0]))).alias("k", "v"))
    return rows.select("date", rnd("country", 6).alias("country"), F.when(F.col("k") == -1, "style").otherwise(F.concat(F.lit("industry "), F.col("k"))).alias("factor"), rnd("v", 6).alias("value"), rnd("r2", 5).alias("r2"))


@query("e_regression_sums", f"""WITH {RETURNS}, p AS (SELECT date, asset, n_regionkey AS g, lag_cap AS cap, r, ln(lag_cap) - avg(ln(lag_cap)) OVER (PARTITION BY date) AS s, count(*) OVER (PARTITION BY date) AS n FROM rets JOIN supplier ON s_suppkey = asset JOIN nation ON n_nationkey = s_nationkey WHERE r IS NOT NULL),
e AS (SELECT date, asset, sqrt(cap) AS w, r, unnest([{{'i': 0, 'x': 1.0}}, {{'i': 1, 'x': s}}, {{'i': 2 + g, 'x': 1.0}}]) AS e FROM p WHERE n >= 10) SELECT a.date, a.e.i AS i, b.e.i AS j, round(sum(a.w * a.e.x * b.e.x), 2) + 0.0 AS xx FROM e a JOIN e b ON a.date = b.date AND a.asset = b.asset AND a.e.i <= b.e.i GROUP BY 1, 2, 3""")
def regression_sums(spark, d):
    """The weighted cross products of country (0), style (1) and regions (2 and more) that the regression solves."""
    x = G.design_sums(_day_panel(spark, d), "date", "r", "industry", ["style"], "cap")
    return x.where("j >= 0").select("date", "i", "j", (rnd("value", 2)).alias("xx"))


@query("e_residual_dispersion")
def residual_dispersion(spark, d):
    """Residuals of the daily regression: weighted deviation and the share of value not explained."""
    p = _day_panel(spark, d)
    res = G.residuals(p, G.constrained_wls(p, "date", "r", "industry", ["style"], "cap"), "date", "r", "industry", ["style"])
    w = F.sqrt("cap")
    return res.groupBy("date").agg(F.count(F.lit(1)).alias("n"), rnd(F.sqrt(F.sum(w * F.col("residual") ** 2) / F.sum(w)), 5).alias("sd"), rnd(F.sum(F.col("cap") * F.col("residual")) / F.sum("cap"), 6).alias("specific"))
