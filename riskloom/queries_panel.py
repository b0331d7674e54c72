"""Queries over calendars, joins, aggregates, contracts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import panel as P
from . import contracts as C
from .base import BARS, RETURNS, bars, query, returns, rnd, table

BOUNDARY = "1998-01-01"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))


@query("p_scan_before_boundary", f"SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_shipdate < DATE '{BOUNDARY}'")
def scan_before(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_shipdate") < F.to_timestamp(F.lit(BOUNDARY))).select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_shipdate").cast("date").alias("date"))


@query("p_is_truncated", f"SELECT max(l_shipdate) < DATE '{BOUNDARY}' AS truncated FROM lineitem")
def is_truncated(spark, d):
    return table(spark, d, "lineitem").agg((F.max("l_shipdate") < F.to_timestamp(F.lit(BOUNDARY))).alias("truncated"))


@query("p_valid_bars", f"WITH {BARS} SELECT asset, date, coalesce(close > 0 AND volume > 0, false) AS valid FROM bars")
def valid_bars(spark, d):
    return bars(spark, d).select("asset", "date", F.coalesce((F.col("close") > 0) & (F.col("volume") > 0), F.lit(False)).alias("valid"))


@query("p_ohlc_rejects", f"WITH {BARS}, o AS (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY date) AS open FROM bars) SELECT asset, date FROM o WHERE NOT coalesce(low > 0 AND low <= close + 1e-9 AND close <= high + 1e-9 AND low <= open AND open <= high, false)")
def ohlc_rejects(spark, d):
    """Bars without a bar before, or whose low and high don't hold the close and the close before."""
    o = bars(spark, d).withColumn("open", F.lag("close").over(Window.partitionBy("asset").orderBy("date")))
    good = (F.col("low") > 0) & (F.col("low") <= F.col("close") + 1e-9) & (F.col("close") <= F.col("high") + 1e-9) & (F.col("low") <= F.col("open")) & (F.col("open") <= F.col("high"))
    return C.rejected(o, good).select("asset", "date")


@query("p_basis_points", "SELECT l_orderkey, l_linenumber, round(l_discount * 10000, 4) AS bp, round(l_tax * 252, 6) AS annual FROM lineitem")
def basis_points(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rnd(F.col("l_discount") * 10_000, 4).alias("bp"), rnd(F.col("l_tax") * 252, 6).alias("annual"))


@query("p_log_excess", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_tax) - ln(1 + l_discount), 8) AS x, round(greatest(l_tax - l_discount, 0), 6) AS clipped FROM lineitem")
def log_excess(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rnd(F.log1p("l_tax") - F.log1p("l_discount"), 8).alias("x"), rnd(F.greatest(F.col("l_tax") - F.col("l_discount"), F.lit(0.0)), 6).alias("clipped"))


@query("p_unit_scaling", "SELECT event_id, CASE WHEN event_type = 'click' THEN value ELSE value * 10000 END AS x FROM events")
def unit_scaling(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", F.col("value")).otherwise(F.col("value") * 10_000).alias("x"))


@query("p_name_normalised", "SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(p_name), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name, replace(lower(p_brand), '#', '.') AS symbol FROM part")
def name_normalised(spark, d):
    return table(spark, d, "part").select("p_partkey", F.trim(F.regexp_replace(F.regexp_replace(F.upper("p_name"), "[^A-Z0-9 ]", " "), " +", " ")).alias("name"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(".")).alias("symbol"))


@query("p_numeric_with_unit", "SELECT s_suppkey, CAST(regexp_extract(s_name, '[0-9]+') AS DOUBLE) AS v FROM supplier")
def numeric_with_unit(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.expr("try_cast(regexp_extract(s_name, '[0-9]+', 0) as double)").alias("v"))


@query("p_quarter_labels", "SELECT o_orderkey, concat(CAST(year(o_orderdate) AS VARCHAR), 'Q', CAST(quarter(o_orderdate) AS VARCHAR)) AS q FROM orders")
def quarter_labels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.quarter_label("o_orderdate").alias("q"))


@query("p_quarter_counts", """WITH q AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter FROM orders)
SELECT quarter, (SELECT count(*) FROM orders WHERE CAST(date_trunc('quarter', o_orderdate) AS DATE) = quarter) AS n FROM q""")
def quarter_counts(spark, d):
    o = table(spark, d, "orders").withColumn("quarter", F.trunc("o_orderdate", "quarter"))
    return o.groupBy("quarter").agg(F.count(F.lit(1)).alias("n"))


@query("p_asof_orders", """WITH f AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS v FROM orders GROUP BY 1, 2),
p AS (SELECT c_custkey AS k, DATE '1997-06-30' AS date FROM customer)
SELECT p.k, p.date, f.v FROM p LEFT JOIN f ON f.k = p.k AND f.date = (SELECT max(g.date) FROM f g WHERE g.k = p.k AND g.date <= p.date)""")
def asof_orders(spark, d):
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.to_date(F.lit("1997-06-30")).alias("date"))
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("x"))
    return P.asof(probes, facts, "k", "date", "x", "v")


@query("p_asof_with_head", """WITH f AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS v FROM orders GROUP BY 1, 2),
h AS (SELECT k, arg_min(v, date) AS head FROM f GROUP BY k), p AS (SELECT c_custkey AS k, DATE '1996-01-31' AS date FROM customer),
a AS (SELECT p.k, p.date, f.v FROM p LEFT JOIN f ON f.k = p.k AND f.date = (SELECT max(g.date) FROM f g WHERE g.k = p.k AND g.date <= p.date))
SELECT a.k, a.date, coalesce(v, head) AS v, (v IS NULL AND head IS NOT NULL) AS approximated FROM a LEFT JOIN h ON a.k = h.k""")
def asof_with_head(spark, d):
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.to_date(F.lit("1996-01-31")).alias("date"))
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("x"))
    return P.asof_with_head(probes, facts, "k", "date", "x", "v")


@query("p_code_groups", """WITH r(label, low, high) AS (VALUES ('small', 1, 10), ('middle', 11, 25), ('large', 30, 45))
SELECT p_partkey, p_size, CASE WHEN p_size IS NULL THEN NULL ELSE coalesce(label, 'other') END AS label FROM part LEFT JOIN r ON p_size BETWEEN low AND high""")
def code_groups(spark, d):
    r = spark.createDataFrame([("small", 1, 10), ("middle", 11, 25), ("large", 30, 45)], "label string, low int, high int")
    return P.code_group(table(spark, d, "part").select("p_partkey", "p_size"), r, "p_size", "other")




def _spells(spark, d):
    return _items(spark, d).groupBy(F.col("l_partkey").alias("asset")).agg(F.min("date").alias("start"), F.max("date").alias("end"))


@query("p_spell_days_by_month", """WITH spells AS (SELECT l_partkey AS asset, min(CAST(l_shipdate AS DATE)) AS s, max(CAST(l_shipdate AS DATE)) AS e FROM lineitem GROUP BY 1),
days AS (SELECT asset, CAST(unnest(generate_series(greatest(s, DATE '1992-01-01'), least(e, DATE '1999-01-01') - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM spells WHERE greatest(s, DATE '1992-01-01') < least(e, DATE '1999-01-01'))
SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS days, count(DISTINCT asset) AS assets FROM days GROUP BY 1""")
def spell_days(spark, d):
    return P.spells_to_days(_spells(spark, d), "1992-01-01", "1999-01-01").groupBy(P.month().alias("month")).agg(F.count(F.lit(1)).alias("days"), F.countDistinct("asset").alias("assets"))


@query("p_membership_states", """WITH spells AS (SELECT l_partkey AS asset, min(CAST(l_shipdate AS DATE)) AS s, max(CAST(l_shipdate AS DATE)) AS e FROM lineitem GROUP BY 1),
days AS (SELECT asset, CAST(unnest(generate_series(greatest(s, DATE '1992-01-01'), least(e, DATE '1999-01-01') - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM spells WHERE greatest(s, DATE '1992-01-01') < least(e, DATE '1999-01-01')),
b AS (SELECT DISTINCT l_partkey AS asset, CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT days.date, CASE WHEN b.asset IS NULL THEN 2 ELSE 1 END AS state, count(*) AS n FROM days LEFT JOIN b ON days.asset = b.asset AND days.date = b.date GROUP BY 1, 2""")
def membership_states(spark, d):
    b = _items(spark, d).select(F.col("l_partkey").alias("asset"), "date")
    return P.state_counts(_spells(spark, d), b, ["asset"], "1992-01-01", "1999-01-01")


@query("p_month_ends", f"WITH {BARS} SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS month_end FROM bars GROUP BY 1, 2")
def month_ends(spark, d):
    return P.month_ends(bars(spark, d), ["asset"])


@query("p_month_sample", f"WITH {BARS} SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS month_end, round(arg_max(close, date), 5) AS close FROM bars GROUP BY 1, 2")
def month_sample(spark, d):
    return P.month_sample(bars(spark, d), ["asset"], "close").withColumn("close", rnd("close"))


@query("p_monthly_compound", f"WITH {RETURNS} SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, round(CASE WHEN count(r) > 0 THEN exp(sum(r)) - 1 END, 5) AS r, count(r) AS n FROM rets GROUP BY 1, 2")
def monthly_compound(spark, d):
    return returns(spark, d).groupBy("asset", P.month().alias("month")).agg(rnd(F.when(F.count("r") > 0, F.expm1(F.sum("r")))).alias("r"), F.count("r").alias("n"))


@query("p_year_summary", f"WITH {RETURNS} SELECT asset, CAST(year(date) AS INTEGER) AS year, round(sum(r), 5) AS total, round(stddev_samp(r), 5) AS sd, round(avg(r), 6) AS mean, count(r) AS n FROM rets GROUP BY 1, 2")
def year_summary(spark, d):
    return returns(spark, d).groupBy("asset", F.year("date").alias("year")).agg(rnd(F.sum("r")).alias("total"), rnd(F.stddev_samp("r")).alias("sd"), rnd(F.avg("r"), 6).alias("mean"), F.count("r").alias("n"))


@query("p_union_calendar", f"""WITH {BARS}, a AS (SELECT date, round(sum(cap), 2) AS a FROM bars WHERE asset % 2 = 0 GROUP BY 1), b AS (SELECT date, round(sum(cap), 2) AS b FROM bars WHERE asset % 2 = 1 GROUP BY 1)
SELECT coalesce(a.date, b.date) AS date, a, b FROM a FULL JOIN b ON a.date = b.date""")
def union_calendar(spark, d):
    x = bars(spark, d)
    side = lambda k, name: x.where(F.col("asset") % 2 == k).groupBy("date").agg(rnd(F.sum("cap"), 2).alias(name))
    return P.union_calendar(side(0, "a"), side(1, "b"), ["date"])


@query("p_calendar_gaps", f"""WITH {BARS}, cal AS (SELECT DISTINCT date FROM bars), span AS (SELECT asset, min(date) AS s, max(date) AS e FROM bars GROUP BY 1)
SELECT span.asset, count(*) AS sessions, count(*) - count(b.date) AS gaps FROM span JOIN cal ON cal.date BETWEEN s AND e LEFT JOIN bars b ON b.asset = span.asset AND b.date = cal.date GROUP BY 1""")
def calendar_gaps(spark, d):
    b = bars(spark, d)
    # Sessions are numbered once; an asset's span holds last - first + 1 of them: nothing is expanded.
    cal = b.select("date").distinct().withColumn("y", F.year("date"))
    per = cal.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    base = per.select("y", F.coalesce(F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    num = cal.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("date"))).join(base, "y").select("date", (F.col("k") + F.col("base")).alias("session"))
    s = b.select("asset", "date").join(num, "date").groupBy("asset").agg((F.max("session") - F.min("session") + 1).alias("sessions"), F.count(F.lit(1)).alias("bars"))
    return s.select("asset", "sessions", (F.col("sessions") - F.col("bars")).alias("gaps"))


@query("p_bar_runs", f"""WITH {BARS}, x AS (SELECT asset, date, date - CAST(row_number() OVER (PARTITION BY asset ORDER BY date) AS INTEGER) AS g FROM bars)
SELECT asset, min(date) AS first, max(date) AS last, count(*) AS length FROM x GROUP BY asset, g HAVING count(*) >= 3""")
def bar_runs(spark, d):
    w = Window.partitionBy("asset").orderBy("date")
    x = bars(spark, d).select("asset", "date", F.expr("date_sub(date, cast(row_number() over (partition by asset order by date) as int))").alias("g"))
    return x.groupBy("asset", "g").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("length")).where("length >= 3").drop("g")


@query("p_flag_episodes", f"""WITH {BARS}, n AS (SELECT asset, date, trades >= 2 AS flag, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM bars),
g AS (SELECT asset, date, rn - row_number() OVER (PARTITION BY asset ORDER BY date) AS g FROM n WHERE flag)
SELECT asset, min(date) AS first, max(date) AS last, count(*) AS length FROM g GROUP BY asset, g""")
def flag_episodes(spark, d):
    return P.runs(bars(spark, d).withColumn("flag", F.col("trades") >= 2), ["asset"], "date", "flag")


@query("p_missing_months", f"""WITH {BARS}, m AS (SELECT DISTINCT asset, CAST(date_trunc('month', date) AS DATE) AS month FROM bars), s AS (SELECT asset, min(month) AS a, max(month) AS b FROM m GROUP BY 1),
e AS (SELECT asset, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM s) SELECT * FROM e EXCEPT SELECT * FROM m""")
def missing_months(spark, d):
    m = bars(spark, d).select("asset", P.month().alias("month")).distinct()
    return C.missing_periods(m, "asset", "month")


@query("p_common_dates", f"WITH {BARS}, g AS (SELECT DISTINCT asset % 10 AS k, date FROM bars) SELECT date FROM g GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT k) FROM g)")
def common_dates(spark, d):
    """Dates on which every group of assets has a bar."""
    g = bars(spark, d).select((F.col("asset") % 10).alias("k"), "date").distinct()
    n = g.agg(F.count_distinct("k").alias("groups"))
    return g.groupBy("date").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n), F.col("n") == F.col("groups")).select("date")


@query("p_complete_dates", f"WITH {BARS}, n AS (SELECT count(DISTINCT asset) AS n FROM bars) SELECT date, count(*) AS assets, count(*) = n.n AS complete FROM bars, n GROUP BY date, n.n")
def complete_dates(spark, d):
    """Assets on each date, and whether all have a bar."""
    b = bars(spark, d)
    n = b.agg(F.countDistinct("asset").alias("n"))
    return b.groupBy("date").agg(F.count(F.lit(1)).alias("assets")).join(F.broadcast(n), F.lit(True)).select("date", "assets", (F.col("assets") == F.col("n")).alias("complete"))


@query("p_distinct_universe", "SELECT DISTINCT s_nationkey AS nation FROM supplier UNION SELECT DISTINCT c_nationkey FROM customer")
def distinct_universe(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@query("p_both_ways_equal", """WITH a AS (SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS date, count(*) AS trades FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), b AS (SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS date, count(*) AS trades FROM lineitem GROUP BY 1, 2)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS differences""")
def both_ways_equal(spark, d):
    """Bars without returned lines against all bars: rows that only one of them has."""
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("asset"), F.col("l_shipdate").cast("date").alias("date"), "l_returnflag")
    trades = lambda x: x.groupBy("asset", "date").agg(F.count(F.lit(1)).alias("trades"))
    return C.differences(trades(items.where("l_returnflag <> 'R'")), trades(items))


@query("p_unmatched_parts", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < DATE '1995-07-01')")
def unmatched_parts(spark, d):
    return table(spark, d, "part").select("p_partkey").join(table(spark, d, "lineitem").where("l_shipdate < timestamp '1995-07-01'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("p_two_step_match", """WITH n AS (SELECT n_name, min(n_nationkey) AS k, count(*) AS c FROM nation GROUP BY 1), s AS (SELECT s_suppkey, s_nationkey, (SELECT n_name FROM nation n2 WHERE n2.n_nationkey = (s_suppkey * 7) % 40) AS nm FROM supplier)
SELECT s_suppkey, coalesce(a.n_nationkey, n.k) AS matched, CASE WHEN a.n_nationkey IS NOT NULL THEN 'exact' WHEN n.c = 1 THEN 'name' WHEN n.c > 1 THEN 'ambiguous' ELSE 'unmapped' END AS method
FROM s LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) a ON a.n_nationkey = s.s_nationkey LEFT JOIN n ON n.n_name = s.nm""")
def two_step_match(spark, d):
    nation = table(spark, d, "nation")
    label = nation.select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("nm"))
    s = table(spark, d, "supplier").join(label, F.col("s_suppkey") * 7 % 40 == F.col("_k"), "left").select("s_suppkey", "s_nationkey", "nm")
    exact = nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("a"))
    named = nation.groupBy("n_name").agg(F.min("n_nationkey").alias("k"), F.count(F.lit(1)).alias("c"))
    j = s.join(exact, s["s_nationkey"] == exact["a"], "left").join(named, s["nm"] == named["n_name"], "left")
    method = F.when(F.col("a").isNotNull(), "exact").when(F.col("c") == 1, "name").when(F.col("c") > 1, "ambiguous").otherwise("unmapped")
    return j.select("s_suppkey", F.coalesce("a", "k").alias("matched"), method.alias("method"))


@query("p_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return C.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("p_shape_check", "SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice IS NULL) AS null_prices, count(DISTINCT o_orderkey) AS orders, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders")
def shape_check(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice").isNull()).alias("null_prices"), F.countDistinct("o_orderkey").alias("orders"), F.min(F.col("o_orderdate").cast("date")).alias("first"), F.max(F.col("o_orderdate").cast("date")).alias("last"))


@query("p_all_null_columns", "SELECT count(l_tax) = 0 AS l_tax, count(l_discount) = 0 AS l_discount, count(l_returnflag) = 0 AS l_returnflag FROM lineitem")
def all_null_columns(spark, d):
    return C.all_null(table(spark, d, "lineitem"), ["l_tax", "l_discount", "l_returnflag"])


@query("p_status_identity", "SELECT count(*) AS requested, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS other FROM orders")
def status_identity(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("requested"), F.count_if(s == "O").alias("open"), F.count_if(s == "F").alias("finished"), F.count_if(~s.isin("O", "F")).alias("other"))


@query("p_pivot_status", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (WHERE o_orderpriority NOT LIKE '1%') AS other FROM orders GROUP BY 1""")
def pivot_status(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("other").alias("k"))
    return o.groupBy("year").pivot("k", ["urgent", "other"]).count().fillna(0)


@query("p_unpivot_prices", "SELECT l_orderkey, l_linenumber, 'tax' AS name, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem")
def unpivot_prices(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return x.unpivot(["l_orderkey", "l_linenumber"], ["tax", "discount"], "name", "value")


@query("p_first_release", "SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def first_release(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("first"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("p_release_stall", """WITH g AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY 1, 2),
x AS (SELECT o_custkey, date, date - lag(date) OVER (PARTITION BY o_custkey ORDER BY date) AS gap FROM g)
SELECT o_custkey, max(gap) AS longest, DATE '1999-01-01' - max(date) AS since, CASE WHEN count(*) > 1 THEN (DATE '1999-01-01' - max(date)) > max(gap) END AS stalled FROM x GROUP BY 1""")
def release_stall(spark, d):
    g = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date")).distinct()
    x = g.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy("o_custkey").orderBy("date"))))
    since = F.datediff(F.to_date(F.lit("1999-01-01")), F.max("date"))
    return x.groupBy("o_custkey").agg(F.max("gap").cast("long").alias("longest"), since.cast("long").alias("since"), F.when(F.count(F.lit(1)) > 1, since > F.max("gap")).alias("stalled"))


@query("p_json_props", "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@query("p_events_blocks", """WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, CAST(floor((rn - 1) / 10) AS BIGINT) AS block, count(*) FILTER (WHERE value > 90) AS breaches, round(stddev_samp(value), 5) AS sd FROM n WHERE floor((rn - 1) / 10) < floor(c / 10) GROUP BY 1, 2""")
def events_blocks(spark, d):
    w = Window.partitionBy("user_id")
    n = table(spark, d, "events").select("user_id", "value", F.row_number().over(w.orderBy("ts", "event_id")).alias("rn"), F.count(F.lit(1)).over(w).alias("c"))
    b = n.withColumn("block", F.floor((F.col("rn") - 1) / 10)).where(F.col("block") < F.floor(F.col("c") / 10))
    return b.groupBy("user_id", "block").agg(F.count_if(F.col("value") > 90).alias("breaches"), rnd(F.stddev_samp("value")).alias("sd"))


@query("p_content_digest")
def content_digest(spark, d):
    """Order-free digest of a table: sum of row hashes and row count."""
    return C.digest(table(spark, d, "orders"))


_LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)"""


@query("p_html_links", f"WITH t AS (SELECT page_id, regexp_extract_all(html, '{_LINK.replace(chr(39), chr(39) * 2)}', 1) AS x FROM pages) SELECT page_id, CAST(unnest(range(len(x))) AS INTEGER) AS place, unnest(x) AS target FROM t")
def html_links(spark, d):
    """Anchor targets of each page, in page order: any case, either quote or none, after other attributes too."""
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("place", "target"))
