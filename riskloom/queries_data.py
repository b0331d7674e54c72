"""Queries over cleaning rules, calendars, market values, curves and ladders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import curves as C
from . import panel as P
from . import prices as PR
from . import sources as S
from .base import BARS, RETURNS, bars, query, returns, rnd, table



def _by():
    return Window.partitionBy("asset").orderBy("date")


@query("d_trading_dates", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice IS NOT NULL OR o_orderstatus IS NOT NULL")
def trading_dates(spark, d):
    """Dates with at least one non-null column."""
    return P.trading_dates(table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_totalprice", "o_orderstatus"))


@query("d_numeric_with_unit", "SELECT l_orderkey, l_linenumber, round(l_tax, 4) AS value, 'USD' AS unit FROM lineitem")
def numeric_with_unit(spark, d):
    """Text such as "0.01 USD" to a number and its unit."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.format_string("%.4f", "l_tax"), F.lit(" USD")).alias("v"))
    return x.select("l_orderkey", "l_linenumber", *S.number_and_unit("v"))


@query("d_symbols", "SELECT c_custkey, replace(upper(c_mktsegment) || '.' || chr(65 + c_nationkey), '.', '-') AS vendor, lower(replace(upper(c_mktsegment) || '.' || chr(65 + c_nationkey), '.', '-')) || '.us' AS listed, length(c_mktsegment) <= 9 AS fits FROM customer")
def symbols(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws(".", F.upper("c_mktsegment"), F.char(F.col("c_nationkey") + 65)).alias("s"), (F.length("c_mktsegment") <= 9).alias("fits"))
    return c.select("c_custkey", S.vendor_symbol(F.col("s")).alias("vendor"), S.listed_symbol(S.vendor_symbol(F.col("s")), "%s.us").alias("listed"), "fits")


@query("d_clean_cells", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS cell FROM orders")
def clean_cells(spark, d):
    """Blank cells, NaN and the text "nan" are null; others are trimmed."""
    raw = F.when(F.col("o_orderstatus") == "P", "  ").when(F.col("o_orderkey") % 3 == 0, " NaN").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return table(spark, d, "orders").select("o_orderkey", S.blank_to_null(raw).alias("cell"))


@query("d_factor_tidy", "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, count(*) > 1 AS repeated, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def factor_tidy(spark, d):
    """Periods written as yyyymmdd to dates, columns to double, dates that repeat flagged."""
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("period"), F.col("o_totalprice").cast("string").alias("value"))
    t = o.select(F.to_date("period", "yyyyMMdd").alias("date"), F.expr("try_cast(value AS double)").alias("value"))
    return t.groupBy("date").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 1).alias("repeated"), rnd(F.sum("value"), 2).alias("value"))


@query("d_quarter_sequence", "WITH s AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1) SELECT o_custkey, CAST(unnest(generate_series(date_trunc('quarter', a), date_trunc('quarter', b), INTERVAL 3 MONTH)) AS DATE) AS quarter FROM s")
def quarter_sequence(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return s.select("o_custkey", P.quarters("a", "b").alias("quarter"))


@query("d_horizons", f"WITH {RETURNS} SELECT asset, round(avg(r) * 252, 5) AS annual, round(avg(r) * 21, 5) AS month, round(var_samp(r) * 21, 6) AS month_variance, 21 AS horizon_days FROM rets GROUP BY 1")
def horizons(spark, d):
    """Daily rate and variance on a horizon; the days are kept beside, so that scaling twice can be refused."""
    x = returns(spark, d).groupBy("asset").agg(F.avg("r").alias("rate"), F.var_samp("r").alias("value"), F.lit(1).alias("horizon_days"))
    x = PR.to_horizon(x, "value", 21)
    return x.select("asset", rnd(F.col("rate") * 252).alias("annual"), rnd(F.col("rate") * 21).alias("month"), rnd("value", 6).alias("month_variance"), "horizon_days")


@query("d_reindex", f"WITH {BARS}, cal AS (SELECT DISTINCT date FROM bars WHERE asset = (SELECT min(asset) FROM bars)), a AS (SELECT DISTINCT asset FROM bars) SELECT a.asset, count(*) AS sessions, count(bars.close) AS known FROM a CROSS JOIN cal LEFT JOIN bars ON bars.asset = a.asset AND bars.date = cal.date GROUP BY 1")
def reindex(spark, d):
    """Each asset on the sessions of the first one; gaps stay null."""
    b = bars(spark, d)
    first = b.agg(F.min("asset").alias("_a"))
    cal = b.join(F.broadcast(first), F.col("asset") == F.col("_a")).select("date").distinct()
    grid = b.select("asset").distinct().join(F.broadcast(cal.agg(F.collect_list("date").alias("dates"))), F.lit(True)).select("asset", F.explode("dates").alias("date"))
    return P.reindex(b.select("asset", "date", "close"), grid, ["asset", "date"]).groupBy("asset").agg(F.count(F.lit(1)).alias("sessions"), F.count("close").alias("known"))


@query("d_calendar_refused", f"WITH {BARS}, m AS (SELECT asset, max(date) AS date FROM bars GROUP BY asset, date_trunc('month', date)), n AS (SELECT asset, date, CAST(date + INTERVAL 7 DAY AS DATE) AS want FROM m) SELECT n.asset, n.want FROM n LEFT JOIN bars ON bars.asset = n.asset AND bars.date = n.want WHERE bars.close IS NULL")
def calendar_refused(spark, d):
    """Rebalance dates, a week after each month end, that have no bar: refused, never filled."""
    b = bars(spark, d)
    want = P.month_ends(b, ["asset"]).select("asset", F.date_add("month_end", 7).alias("want"))
    return want.join(b.select("asset", F.col("date").alias("want"), "close"), ["asset", "want"], "left").where("close IS NULL").select("asset", "want")


@query("d_three_states", f"""WITH {BARS}, sp AS (SELECT asset, min(date) AS s, max(date) AS e FROM bars WHERE volume > 20 GROUP BY 1), cal AS (SELECT DISTINCT date FROM bars), a AS (SELECT DISTINCT asset FROM bars)
SELECT a.asset, count(*) FILTER (WHERE sp.s IS NULL OR cal.date < sp.s OR cal.date >= sp.e) AS outside, count(*) FILTER (WHERE cal.date >= sp.s AND cal.date < sp.e AND b.close IS NOT NULL) AS with_bar, count(*) FILTER (WHERE cal.date >= sp.s AND cal.date < sp.e AND b.close IS NULL) AS without_bar
FROM a CROSS JOIN cal LEFT JOIN sp ON sp.asset = a.asset LEFT JOIN bars b ON b.asset = a.asset AND b.date = cal.date GROUP BY 1""")
def three_states(spark, d):
    """Sessions of each asset by state: no member, member with a bar, member without."""
    b = bars(spark, d)
    spells = b.where("volume > 20").groupBy("asset").agg(F.min("date").alias("s"), F.max("date").alias("e"))
    cal = b.select("date").distinct().agg(F.collect_list("date").alias("dates"))
    grid = b.select("asset").distinct().join(F.broadcast(cal), F.lit(True)).select("asset", F.explode("dates").alias("date"))
    g = grid.join(spells, "asset", "left").join(b.select("asset", "date", "close"), ["asset", "date"], "left")
    state = P.three_states(F.col("date"), F.col("s"), F.col("e"), F.col("close"))
    return g.withColumn("state", state).groupBy("asset").agg(*(F.count_if(F.col("state") == k).alias(n) for k, n in enumerate(("outside", "with_bar", "without_bar"))))


@query("d_override_join", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey - 1 ELSE s_nationkey END AS key, s_suppkey % 7 = 0 AS overridden FROM supplier")
def override_join(spark, d):
    """A mapping with some of its keys taken from a table of overrides."""
    s = table(spark, d, "supplier")
    over = s.where("s_suppkey % 7 = 0").select("s_suppkey", (F.col("s_suppkey") - 1).alias("to"))
    return PR.overridden(s.select("s_suppkey", F.col("s_nationkey").cast("long").alias("key")), over, "s_suppkey", "key", "to")


_SPLITS = "facts AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS shares FROM orders), sp AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS ex, 1.0 + o_orderkey % 3 AS ratio FROM orders WHERE o_orderpriority LIKE '1%')"


@query("d_split_product", f"WITH {_SPLITS}, f AS (SELECT k, d, max(shares) AS shares FROM facts GROUP BY 1, 2) SELECT f.k, f.d, round(any_value(shares) * exp(coalesce(sum(ln(ratio)), 0)), 2) AS adjusted FROM f LEFT JOIN sp ON sp.k = f.k AND sp.ex > f.d GROUP BY 1, 2")
def split_product(spark, d):
    """Counts times the product of all later ratios, as a running product from the newest date back."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), "o_totalprice", "o_orderkey", "o_orderpriority")
    f = o.groupBy("k", "d").agg(F.max("o_totalprice").alias("shares"))
    s = o.where(F.col("o_orderpriority").startswith("1")).groupBy("k", "d").agg(F.sum(F.log(1.0 + F.col("o_orderkey") % 3)).alias("lr"))
    return PR.later_product(f, s, "k", "d", "shares", "lr").select("k", "d", rnd("adjusted", 2).alias("adjusted"))


@query("d_market_cap", f"""WITH {BARS}, c AS (SELECT s_suppkey AS asset, s_acctbal AS shares, s_nationkey AS nation FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT bars.asset, count(*) AS sessions, round(sum(CASE WHEN c.shares > 0 THEN c.shares * close END), 2) AS cap, CASE WHEN any_value(c.asset) IS NULL THEN 'unmapped' WHEN any_value(c.shares) <= 0 THEN 'screened' ELSE 'ok' END AS status FROM bars LEFT JOIN c ON c.asset = bars.asset GROUP BY 1""")
def market_cap(spark, d):
    """Mapping, counts, screen and close to a value by asset with a status."""
    c = table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("asset"), F.col("s_acctbal").alias("shares"))
    x = PR.market_caps(bars(spark, d), c, "asset", "shares")
    return x.groupBy("asset").agg(F.count(F.lit(1)).alias("sessions"), rnd(F.sum("value"), 2).alias("cap"), F.first("status").alias("status"))


@query("d_month_join", f"WITH {RETURNS}, a AS (SELECT asset, date_trunc('month', date) AS m, max(date) AS stamp, sum(r) AS r FROM rets GROUP BY 1, 2), b AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) / 1e9 AS v FROM orders GROUP BY 1) SELECT asset, count(b.v) AS matched, count(*) FILTER (WHERE b.v IS NULL) AS lost, round(corr(r, v), 4) AS corr FROM a LEFT JOIN b ON a.m = b.m GROUP BY 1")
def month_join(spark, d):
    from .base import corr

    a = returns(spark, d).groupBy("asset", P.month().alias("m")).agg(F.sum("r").alias("r"))
    b = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("m")).agg((F.sum("o_totalprice") / 1e9).alias("v"))
    x = a.join(b, "m", "left")
    return x.groupBy("asset").agg(F.count("v").alias("matched"), F.count_if(F.col("v").isNull()).alias("lost"), rnd(corr("r", "v"), 4).alias("corr"))


@query("d_month_end_positions", f"WITH {BARS}, n AS (SELECT asset, date, row_number() OVER w AS rn, lead(date) OVER w AS nxt FROM bars WINDOW w AS (PARTITION BY asset ORDER BY date)) SELECT asset, date, rn FROM n WHERE nxt IS NULL OR date_trunc('month', nxt) <> date_trunc('month', date)")
def month_end_positions(spark, d):
    n = bars(spark, d).select("asset", "date", F.row_number().over(_by()).alias("rn"), F.lead("date").over(_by()).alias("nxt"))
    return n.where(F.col("nxt").isNull() | (P.month("nxt") != P.month())).select("asset", "date", "rn")


@query("d_monthly_factor", f"WITH {RETURNS}, b AS (SELECT date_trunc('month', min(date)) AS lo, date_trunc('month', max(date)) AS hi FROM rets) SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, round(exp(sum(r)) - 1, 5) AS compound, round(sum(r) * 10000, 2) AS bp FROM rets, b WHERE r IS NOT NULL AND date_trunc('month', date) > lo AND date_trunc('month', date) < hi GROUP BY 1, 2")
def monthly_factor(spark, d):
    """Monthly factor returns, the first and last month of the calendar left out."""
    r = returns(spark, d)
    b = r.agg(F.trunc(F.min("date"), "MM").alias("lo"), F.trunc(F.max("date"), "MM").alias("hi"))
    x = r.where("r IS NOT NULL").withColumn("month", P.month()).join(F.broadcast(b), F.expr("month > lo AND month < hi"))
    return x.groupBy("asset", "month").agg(rnd(F.expm1(F.sum("r"))).alias("compound"), rnd(F.sum("r") * 10_000, 2).alias("bp"))


@query("d_monthly_hold", f"WITH {RETURNS}, s AS (SELECT asset, date, r, lag(sd) OVER (PARTITION BY asset ORDER BY date) AS f FROM (SELECT asset, date, r, stddev_samp(r) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd FROM rets WHERE r IS NOT NULL)) SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, round(sum(r), 5) AS r, round(arg_min(f, date) * sqrt(count(*)), 5) AS sigma FROM s WHERE f IS NOT NULL GROUP BY 1, 2")
def monthly_hold(spark, d):
    """Summed return of a month and the volatility forecast at its start on that horizon."""
    s = returns(spark, d).where("r IS NOT NULL").withColumn("sd", F.stddev_samp("r").over(_by().rowsBetween(-19, 0)))
    s = s.withColumn("f", F.lag("sd").over(_by())).where("f IS NOT NULL")
    return s.groupBy("asset", P.month().alias("month")).agg(rnd(F.sum("r")).alias("r"), rnd(F.min_by("f", "date") * F.sqrt(F.count(F.lit(1)))).alias("sigma"))


@query("d_holding_periods", f"WITH {BARS}, m AS (SELECT asset, date_trunc('month', date) AS month, arg_max(close, date) AS nav, sum(cap) * 1e-9 AS cost FROM bars GROUP BY 1, 2) SELECT asset, CAST(month AS DATE) AS month, round(lead(nav) OVER w / nav - 1, 5) AS net, round(lead(nav) OVER w / nav - 1 + lead(cost) OVER w, 5) AS gross FROM m WINDOW w AS (PARTITION BY asset ORDER BY month)")
def holding_periods(spark, d):
    """Ratio of the marks of two rebalances; gross adds back the cost of the period."""
    m = bars(spark, d).groupBy("asset", P.month().alias("month")).agg(F.max_by("close", "date").alias("nav"), (F.sum("cap") * 1e-9).alias("cost"))
    w = Window.partitionBy("asset").orderBy("month")
    net = F.lead("nav").over(w) / F.col("nav") - 1
    return m.select("asset", "month", rnd(net).alias("net"), rnd(net + F.lead("cost").over(w)).alias("gross"))


@query("d_code_drift", "SELECT s_suppkey, s_nationkey AS code, s_suppkey % 25 AS first_code, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey <> s_suppkey % 25 END AS code_differs, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey // 5 <> (s_suppkey % 25) // 5 END AS group_differs FROM supplier")
def code_drift(spark, d):
    return PR.drift(_codes(spark, d), "code", "first_code", "known").select("s_suppkey", "code", "first_code", "code_differs", "group_differs")


def _codes(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("code"), (F.col("s_suppkey") % 25).alias("first_code"), (F.col("s_suppkey") % 4 != 0).alias("known"))


@query("d_drift_counts", "SELECT count(*) FILTER (WHERE s_suppkey % 4 <> 0) AS compared, count(*) FILTER (WHERE s_suppkey % 4 <> 0 AND s_nationkey <> s_suppkey % 25) AS code_differs, count(*) FILTER (WHERE s_suppkey % 4 <> 0 AND s_nationkey // 5 <> (s_suppkey % 25) // 5) AS group_differs FROM supplier")
def drift_counts(spark, d):
    x = PR.drift(_codes(spark, d), "code", "first_code", "known")
    return x.agg(F.count("code_differs").alias("compared"), F.count_if("code_differs").alias("code_differs"), F.count_if("group_differs").alias("group_differs"))


@query("d_gaps_by_year", f"WITH {BARS}, g AS (SELECT asset, date, date - lag(date) OVER (PARTITION BY asset ORDER BY date) AS gap FROM bars), y AS (SELECT CAST(unnest(range((SELECT min(year(date)) FROM bars), (SELECT max(year(date)) FROM bars) + 1)) AS INTEGER) AS year) SELECT y.year, count(g.gap) FILTER (WHERE gap > 7) AS long, count(g.gap) FILTER (WHERE gap BETWEEN 2 AND 7) AS short FROM y LEFT JOIN g ON year(g.date) = y.year GROUP BY 1")
def gaps_by_year(spark, d):
    g = bars(spark, d).select("asset", "date", F.datediff("date", F.lag("date").over(_by())).alias("gap"))
    spine = g.agg(F.sequence(F.year(F.min("date")), F.year(F.max("date"))).alias("y")).select(F.explode("y").alias("year"))
    n = g.groupBy(F.year("date").alias("year")).agg(F.count_if(F.col("gap") > 7).alias("long"), F.count_if(F.col("gap").between(2, 7)).alias("short"))
    return spine.join(n, "year", "left").fillna(0)


@query("d_cause_counts", f"WITH {BARS} SELECT date, count(*) AS universe, count(*) FILTER (WHERE volume >= 30) AS with_cap, count(*) FILTER (WHERE volume < 30 AND trades = 1) AS one_trade, count(*) FILTER (WHERE volume < 30 AND trades > 1) AS thin FROM bars GROUP BY 1")
def cause_counts(spark, d):
    """Names of a session with a value, and without by cause."""
    cause = F.when(F.col("volume") >= 30, "with_cap").when(F.col("trades") == 1, "one_trade").otherwise("thin")
    x = bars(spark, d).withColumn("cause", cause).groupBy("date").pivot("cause", ["with_cap", "one_trade", "thin"]).count().fillna(0)
    return x.select("date", (F.col("with_cap") + F.col("one_trade") + F.col("thin")).alias("universe"), "with_cap", "one_trade", "thin")


@query("d_approximated_share", f"WITH {BARS} SELECT CAST(year(date) AS INTEGER) AS year, count(*) FILTER (WHERE trades = 1) AS single, round(100 * avg(CASE WHEN trades = 1 THEN 1.0 ELSE 0.0 END), 4) AS share FROM bars GROUP BY 1")
def approximated_share(spark, d):
    one = F.col("trades") == 1
    return bars(spark, d).groupBy(F.year("date").alias("year")).agg(F.count_if(one).alias("single"), rnd(100 * F.avg(F.when(one, 1.0).otherwise(0.0)), 4).alias("share"))


@query("d_year_end_bound", f"WITH {BARS}, l AS (SELECT year(date) AS year, max(date) AS date FROM bars GROUP BY 1) SELECT CAST(l.year AS INTEGER) AS year, round(sum(cap), 2) AS total, round(coalesce(sum(cap) FILTER (WHERE volume >= 30), 0), 2) AS screened, sum(cap) <= 1.25 * coalesce(sum(cap) FILTER (WHERE volume >= 30), 0) AS within FROM l JOIN bars ON bars.date = l.date GROUP BY 1")
def year_end_bound(spark, d):
    """Totals of each year's last session with and without the screen, against a bound."""
    b = bars(spark, d)
    last = b.groupBy(F.year("date").alias("year")).agg(F.max("date").alias("date"))
    ok = F.coalesce(F.sum(F.when(F.col("volume") >= 30, F.col("cap"))), F.lit(0.0))
    return b.join(F.broadcast(last), "date").groupBy("year").agg(rnd(F.sum("cap"), 2).alias("total"), rnd(ok, 2).alias("screened"), (F.sum("cap") <= 1.25 * ok).alias("within"))


@query("d_total_return", f"WITH {BARS}, a AS (SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS date, sum(l_tax) AS dividend FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2) SELECT bars.asset, bars.date, round((close + coalesce(dividend, 0)) / lag(close) OVER (PARTITION BY bars.asset ORDER BY bars.date) - 1, 5) + 0.0 AS r FROM bars LEFT JOIN a ON a.asset = bars.asset AND a.date = bars.date")
def total_return(spark, d):
    a = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("asset"), F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_tax").alias("dividend"))
    return PR.total_return(bars(spark, d), a, "asset", "date", "close", "dividend").select("asset", "date", rnd("r").alias("r"))


@query("d_split_check", f"WITH {BARS}, x AS (SELECT asset, date, trades, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY date)) AS move FROM bars) SELECT asset, date, round(move, 5) AS move, abs(move + ln(trades)) < 0.5 * ln(trades) AS not_applied FROM x WHERE trades > 1 AND move IS NOT NULL")
def split_check(spark, d):
    """Whether the log move across a split date is nearer to the split than half its size."""
    x = bars(spark, d).withColumn("move", F.log(F.col("close") / F.lag("close").over(_by()))).where("trades > 1 AND move IS NOT NULL")
    return x.select("asset", "date", rnd("move").alias("move"), PR.split_not_applied(F.col("move"), F.col("trades")).alias("not_applied"))


@query("d_price_sanity", f"WITH {BARS} SELECT asset, count(*) FILTER (WHERE close IS NULL) AS nulls, count(*) FILTER (WHERE close <= 0) AS not_positive, count(*) - count(DISTINCT date) AS repeated, count(*) FILTER (WHERE date >= DATE '1998-01-01') AS past_boundary FROM bars GROUP BY 1")
def price_sanity(spark, d):
    return bars(spark, d).groupBy("asset").agg(F.count_if(F.col("close").isNull()).alias("nulls"), F.count_if(F.col("close") <= 0).alias("not_positive"), (F.count(F.lit(1)) - F.count_distinct("date")).alias("repeated"), F.count_if(F.col("date") >= F.to_date(F.lit("1998-01-01"))).alias("past_boundary"))


@query("d_period_coverage", f"WITH {BARS}, m AS (SELECT DISTINCT asset, date_trunc('month', date) AS m FROM bars), b AS (SELECT min(m) AS lo, max(m) AS hi FROM m), s AS (SELECT asset, min(m) AS a, max(m) AS z, count(*) AS n FROM m GROUP BY 1) SELECT asset, a > lo AS late_start, z < hi AS early_end, date_diff('month', a, z) + 1 - n AS missing FROM s, b")
def period_coverage(spark, d):
    """Against the span of all: whether an asset starts late or ends early, and months missing between."""
    m = bars(spark, d).select("asset", P.month().alias("m")).distinct()
    s = m.groupBy("asset").agg(F.min("m").alias("a"), F.max("m").alias("z"), F.count(F.lit(1)).alias("n"))
    b = m.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    k = lambda c: F.year(c) * 12 + F.month(c)
    return s.join(F.broadcast(b), F.lit(True)).select("asset", (F.col("a") > F.col("lo")).alias("late_start"), (F.col("z") < F.col("hi")).alias("early_end"), (k("z") - k("a") + 1 - F.col("n")).cast("long").alias("missing"))


@query("d_vintage_coverage", "WITH v AS (SELECT o_custkey AS series, CAST(o_orderdate AS DATE) AS d, count(*) AS releases FROM orders GROUP BY 1, 2) SELECT series, count(*) AS vintages, min(d) AS first, max(d) AS last, count(*) FILTER (WHERE releases = 1) AS single FROM v GROUP BY 1")
def vintage_coverage(spark, d):
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("series"), F.col("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("releases"))
    return v.groupBy("series").agg(F.count(F.lit(1)).alias("vintages"), F.min("d").alias("first"), F.max("d").alias("last"), F.count_if(F.col("releases") == 1).alias("single"))


@query("d_first_releases", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def first_releases(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_orderkey")
    return o.groupBy("o_custkey", "date").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("d_dividends_wide", "SELECT CAST(l_shipdate AS DATE) AS date, round(coalesce(sum(l_tax) FILTER (WHERE l_returnflag = 'A'), 0), 4) AS a, round(coalesce(sum(l_tax) FILTER (WHERE l_returnflag = 'N'), 0), 4) AS n, round(coalesce(sum(l_tax) FILTER (WHERE l_returnflag = 'R'), 0), 4) AS r FROM lineitem GROUP BY 1")
def dividends_wide(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.lower("l_returnflag").alias("k"), "l_tax")
    w = x.groupBy("date").pivot("k", ["a", "n", "r"]).agg(F.sum("l_tax")).fillna(0.0)
    return w.select("date", *(rnd(c, 4).alias(c) for c in ("a", "n", "r")))


@query("d_vendor_check", f"WITH {BARS}, v AS (SELECT asset, date, close, high, close - high AS gap FROM bars) SELECT asset, round(corr(close, high), 4) AS corr, round(avg(gap), 4) AS mean_gap, round(max(abs(gap)), 4) AS largest, arg_max(date, struct_pack(g := abs(gap), d := date)) AS at FROM v GROUP BY 1")
def vendor_check(spark, d):
    """Two series of one asset: correlation, mean gap, largest gap and its date."""
    from .base import corr

    v = bars(spark, d).withColumn("gap", F.col("close") - F.col("high"))
    return v.groupBy("asset").agg(rnd(corr("close", "high"), 4).alias("corr"), rnd(F.avg("gap"), 4).alias("mean_gap"), rnd(F.max(F.abs("gap")), 4).alias("largest"), F.max_by("date", F.struct(F.abs("gap").alias("g"), "date")).alias("at"))


@query("d_rehash", "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'untracked' ELSE 'modified' END AS state FROM (SELECT * FROM orders WHERE o_orderkey % 11 <> 0) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 13 <> 0) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderkey % 17 = 0")
def rehash(spark, d):
    """Rows recorded with a hash against rows found: missing, modified, untracked."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    seen = o.where("o_orderkey % 11 <> 0").select("o_orderkey", F.xxhash64("o_totalprice").alias("was"))
    now = o.where("o_orderkey % 13 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 17 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).select("o_orderkey", F.xxhash64("o_totalprice").alias("is"))
    x = seen.join(now, "o_orderkey", "full").where("was IS NULL OR is IS NULL OR was <> is")
    return x.select("o_orderkey", F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "untracked").otherwise("modified").alias("state"))


# Curves: a three-parameter curve a day, from the orders of the day.
_H = lambda n: f"((1 - exp(-{n} / tau)) / ({n} / tau))"
_Y = lambda n: f"(b0 + b1 * {_H(n)} + b2 * ({_H(n)} - exp(-{n} / tau)))"
_CURVE = "curve AS (SELECT CAST(o_orderdate AS DATE) AS date, 3 + avg(o_totalprice) / 200000 AS b0, -1 - count(*) / 100.0 AS b1, 0.5 AS b2, 1.5 + max(o_orderkey % 7) / 4.0 AS tau FROM orders GROUP BY 1)"


def _curve(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"))
    return o.agg((3 + F.avg("o_totalprice") / 200_000).alias("b0"), (-1 - F.count(F.lit(1)) / 100.0).alias("b1"), F.lit(0.5).alias("b2"), (1.5 + F.max(F.col("o_orderkey") % 7) / 4.0).alias("tau"))


_CW = "WINDOW w AS (ORDER BY date)"


@query("d_published_mask", f"WITH {_CURVE} SELECT date, tau > 2 AND b0 IS NOT NULL AS published, CASE WHEN tau > 2 THEN round({_Y(7.5)}, 5) END AS y FROM curve")
def published_mask(spark, d):
    """Yield at 7.5 years where the curve of the day reaches that far (here: its tau is over two)."""
    ok = F.col("tau") > 2
    return _curve(spark, d).select("date", (ok & F.col("b0").isNotNull()).alias("published"), F.when(ok, rnd(C.curve_yield(7.5))).alias("y"))


@query("d_breakeven", f"WITH {_CURVE} SELECT date, round({_Y(10.0)} - (0.6 * b0), 5) AS breakeven FROM curve WHERE tau > 2")
def breakeven(spark, d):
    """Nominal less real yield where both are published; the real curve has its own days."""
    c = _curve(spark, d)
    real = c.where("tau > 2").select("date", (0.6 * F.col("b0")).alias("real"))
    return c.select("date", C.curve_yield(10.0).alias("nominal")).join(real, "date").select("date", rnd(F.col("nominal") - F.col("real")).alias("breakeven"))


@query("d_yield_changes", f"WITH {_CURVE} SELECT date, round(100 * ({_Y(2.0)} - lag({_Y(2.0)}) OVER w), 4) AS y2, round(100 * ({_Y(10.0)} - lag({_Y(10.0)}) OVER w), 4) AS y10 FROM curve {_CW}")
def yield_changes(spark, d):
    """Daily change of two yields in basis points."""
    w = Window.orderBy("date")  # a row a session
    c = _curve(spark, d).select("date", C.curve_yield(2.0).alias("a"), C.curve_yield(10.0).alias("b"))
    return c.select("date", rnd(100 * (F.col("a") - F.lag("a").over(w)), 4).alias("y2"), rnd(100 * (F.col("b") - F.lag("b").over(w)), 4).alias("y10"))


@query("d_constant_maturity", f"WITH {_CURVE}, y AS (SELECT date, lag({_Y(10.0)}) OVER w AS was, {_Y('(10 - 1/252.0)')} AS now FROM curve {_CW}) SELECT date, round(exp(10 * was / 100 - (10 - 1/252.0) * now / 100) - 1, 6) AS r FROM y")
def constant_maturity(spark, d):
    """Return of a zero bond bought at ten years and sold a session shorter: carry, roll-down and rate change together."""
    return C.constant_maturity_return(_curve(spark, d), 10.0).select("date", rnd("r", 6).alias("r"))


_PAR = "f AS (SELECT date, b0, b1, b2, tau, CAST(unnest(range(1, 11)) AS DOUBLE) / 2 AS t FROM curve), p AS (SELECT date, (1 - exp(-max(CASE WHEN t = 5 THEN t * {Y} / 100 END))) / sum(exp(-t * {Y} / 100) / 2) AS coupon FROM f GROUP BY 1)".replace("{Y}", _Y("t"))


@query("d_par_coupons", f"WITH {_CURVE}, {_PAR} SELECT date, round(coupon, 6) AS coupon FROM p")
def par_coupons(spark, d):
    """Par coupon of a five-year bond with two coupons a year, from the discounted cash flows."""
    return C.par_coupon(_curve(spark, d), 5.0, 2).select("date", rnd("coupon", 6).alias("coupon"))


@query("d_par_bond", f"WITH {_CURVE}, {_PAR}, c AS (SELECT date, lag(coupon) OVER (ORDER BY date) AS coupon FROM p), g AS (SELECT f.date, sum((coupon / 2 + CASE WHEN t = 5 THEN 1 ELSE 0 END) * exp(-(t - 1/252.0) * {_Y('(t - 1/252.0)')} / 100)) AS price FROM f JOIN c ON f.date = c.date GROUP BY 1) SELECT date, round(price - 1, 6) AS r FROM g")
def par_bond(spark, d):
    """Yesterday's five-year par bond on today's curve, a session shorter."""
    return C.par_bond_returns(_curve(spark, d), 5.0, 2).select("date", rnd("r", 6).alias("r"))


_LAD = lambda n: f"(exp({n} * lag({_Y(n)}) OVER w / 100 - ({n} - 1/252.0) * {_Y(f'({n} - 1/252.0)')} / 100) - 1)"


@query("d_ladder", f"WITH {_CURVE} SELECT date, round((1.0 * {_LAD(2.0)} + 2.0 * {_LAD(5.0)} + 3.0 * {_LAD(10.0)}) / 6, 6) AS r FROM curve {_CW}")
def ladder(spark, d):
    """Zero-bond ladder with weights made to sum to one; a leg that is missing counts as nothing."""
    return C.ladder(_curve(spark, d), {2.0: 1.0, 5.0: 2.0, 10.0: 3.0}).select("date", rnd("r", 6).alias("r"))


@query("d_seasoned", f"""WITH {_CURVE}, {_PAR}, m AS (SELECT date, coupon FROM p), s AS (SELECT a.date, (SELECT arg_max(m.coupon, m.date) FROM m WHERE m.date <= a.date - INTERVAL 1 YEAR) AS coupon FROM curve a),
g AS (SELECT f.date, sum((coupon / 2 + CASE WHEN t = 4 THEN 1 ELSE 0 END) * exp(-t * {_Y('t')} / 100)) AS price FROM f JOIN s ON f.date = s.date WHERE t <= 4 GROUP BY 1) SELECT date, round(price, 6) AS price FROM g""")
def seasoned(spark, d):
    """Price of a bond issued at par a year ago with five years then: its coupon by an as-of join."""
    return C.seasoned_price(_curve(spark, d), 5.0, 1, 2).select("date", rnd("price", 6).alias("price"))


@query("d_curve_inventory", f"WITH {_CURVE}, y AS (SELECT date, unnest([2.0, 5.0, 10.0]) AS n, b0, b1, b2, tau FROM curve), z AS (SELECT date, n, {_Y('n')} AS y FROM y), r AS (SELECT date, n, y, y - lag(y) OVER (PARTITION BY n ORDER BY date) AS dy FROM z) SELECT n, count(*) AS days, min(date) AS first, max(date) AS last, round(stddev_samp(dy) * sqrt(252), 5) AS vol, round(avg(y), 5) AS carry FROM r GROUP BY 1")
def curve_inventory(spark, d):
    y = _curve(spark, d).withColumn("n", F.explode(F.array(F.lit(2.0), F.lit(5.0), F.lit(10.0)))).withColumn("y", C.curve_yield(F.col("n")))
    y = y.withColumn("dy", F.col("y") - F.lag("y").over(Window.partitionBy("n").orderBy("date")))
    return y.groupBy("n").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first"), F.max("date").alias("last"), rnd(F.stddev_samp("dy") * F.sqrt(F.lit(252.0))).alias("vol"), rnd(F.avg("y")).alias("carry"))
