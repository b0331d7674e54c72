"""Queries over memberships walked back from a list and a table of changes, an index a supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import query, table
from .panel import membership as M

_CHANGES = """chg AS (SELECT l_suppkey AS idx, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CASE WHEN l_returnflag = 'A' THEN 'added' ELSE 'removed' END AS kind, CAST(l_partkey AS VARCHAR) AS ticker,
 concat(l_shipmode, l_linenumber) AS security FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) WHERE l_returnflag IN ('A', 'R')),
mem AS (SELECT l_suppkey AS idx, CAST(l_partkey AS VARCHAR) AS ticker, min(CAST(date_trunc('week', l_shipdate) AS DATE)) AS date_added FROM lineitem GROUP BY 1, 2 HAVING max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) IS NULL OR max(l_shipdate) > max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END))"""

_LINKS = (
    _CHANGES
    + """, reach AS (SELECT idx, min(date) AS reach FROM chg GROUP BY 1),
lone AS (SELECT m.idx, m.ticker, m.date_added AS date FROM mem m JOIN reach r ON r.idx = m.idx WHERE m.date_added >= r.reach AND NOT EXISTS (SELECT 1 FROM chg c WHERE c.kind = 'added' AND c.idx = m.idx AND c.date = m.date_added AND c.ticker = m.ticker)),
fresh AS (SELECT idx, date, min(ticker) AS alias, count(*) AS k FROM chg c WHERE kind = 'added' AND NOT EXISTS (SELECT 1 FROM mem m WHERE m.idx = c.idx AND m.ticker = c.ticker) GROUP BY 1, 2),
sole AS (SELECT l.*, count(*) OVER (PARTITION BY idx, date) AS n FROM lone l),
lnk AS (SELECT s.idx, s.ticker, f.alias, s.date, s.n = 1 AND coalesce(f.k, 0) = 1 AS fits FROM sole s LEFT JOIN fresh f ON f.idx = s.idx AND f.date = s.date)"""
)

_WALK = (
    _LINKS
    + """, ali AS (SELECT idx, alias, arg_max(ticker, date) AS now FROM lnk WHERE fits GROUP BY 1, 2),
nam AS (SELECT c.*, CASE WHEN kind = 'added' THEN coalesce(a.now, c.ticker) ELSE c.ticker END AS name FROM chg c LEFT JOIN ali a ON a.idx = c.idx AND a.alias = c.ticker),
stt AS (SELECT n.*, row_number() OVER w AS pos, CASE WHEN lag(kind) OVER w IS NULL THEN m.ticker IS NOT NULL ELSE lag(kind) OVER w = 'removed' END AS inside FROM nam n LEFT JOIN mem m ON m.idx = n.idx AND m.ticker = n.name WINDOW w AS (PARTITION BY n.idx, n.name ORDER BY n.date DESC, n.kind = 'added', n.ticker, n.security)),
wlk AS (SELECT *, inside = (kind = 'added') AS fits FROM stt)"""
)


def _tables(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("idx"), F.col("l_partkey").cast("string").alias("ticker"), "l_shipdate", "l_returnflag", F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("security"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
    side = lambda flag, c: F.when(F.col("l_returnflag") == flag, F.col(c))
    changes = line.where("l_returnflag IN ('A', 'R')").select("idx", F.col("date").alias("effective_date"), side("A", "ticker").alias("added"), side("A", "security").alias("added_security"), side("R", "ticker").alias("removed"), side("R", "security").alias("removed_security"))
    gone = F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    members = line.groupBy("idx", "ticker").agg(F.min("date").alias("date_added"), gone.alias("_gone"), F.max("l_shipdate").alias("_last")).where("_gone IS NULL OR _last > _gone")
    return members.select("idx", "ticker", F.lit(None).cast("string").alias("security"), "date_added"), changes


@query("b_membership_spells", f"""WITH {_WALK}, good AS (SELECT idx, name AS ticker, pos, kind, date, security FROM wlk WHERE fits UNION ALL SELECT idx, ticker, 0, 'today', NULL, NULL FROM mem),
 nxt AS (SELECT *, lead(date) OVER w AS start, lead(security) OVER w AS opened FROM good WINDOW w AS (PARTITION BY idx, ticker ORDER BY pos))
 SELECT idx, ticker, start, date AS "end", start IS NOT NULL AS start_known, coalesce(security, CASE WHEN start IS NOT NULL THEN opened END) AS security FROM nxt WHERE kind <> 'added'""")
def membership_spells(spark, d):
    members, changes = _tables(spark, d)
    return M.reconstruct(members, changes, ["idx"])["spells"]


@query("b_membership_inconsistencies", f"WITH {_WALK} SELECT idx, date, ticker, CASE WHEN kind = 'added' THEN 'added_not_in_set' ELSE 'removed_already_in_set' END AS kind FROM wlk WHERE NOT fits")
def membership_inconsistencies(spark, d):
    members, changes = _tables(spark, d)
    return M.reconstruct(members, changes, ["idx"])["inconsistencies"]


@query("b_rename_links", f"WITH {_LINKS} SELECT idx, ticker, CASE WHEN fits THEN alias END AS alias, date FROM lnk")
def rename_links(spark, d):
    """Links, and with a null alias the dated members that no addition row explains."""
    parts = M.reconstruct(*_tables(spark, d), ["idx"])
    return parts["links"].unionByName(parts["unmatched"].withColumn("alias", F.lit(None).cast("string")))


@query("b_membership_gaps", f"""WITH {_WALK}, x AS (SELECT date, 1 AS r, 0 AS i, 0 AS l, 0 AS u FROM chg UNION ALL SELECT date, 0, 1, 0, 0 FROM wlk WHERE NOT fits UNION ALL SELECT date, 0, 0, CAST(fits AS INTEGER), CAST(NOT fits AS INTEGER) FROM lnk)
 SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(r) AS BIGINT) AS "rows", CAST(sum(i) AS BIGINT) AS inconsistencies, CAST(sum(l) AS BIGINT) AS links, CAST(sum(u) AS BIGINT) AS unmatched FROM x GROUP BY 1""")
def membership_gaps(spark, d):
    members, changes = _tables(spark, d)
    g = M.gaps_by_year(M.reconstruct(members, changes, ["idx"]), changes, ["idx"])
    return g.groupBy("year").agg(*(F.sum(c).alias(c) for c in ("rows", "inconsistencies", "links", "unmatched")))


@query("b_members_by_month", f"""WITH {_WALK}, good AS (SELECT idx, name AS ticker, pos, kind, date FROM wlk WHERE fits UNION ALL SELECT idx, ticker, 0, 'today', NULL FROM mem),
 nxt AS (SELECT *, lead(date) OVER (PARTITION BY idx, ticker ORDER BY pos) AS start FROM good), sp AS (SELECT idx, ticker, start, date AS stop FROM nxt WHERE kind <> 'added'),
 bar AS (SELECT DISTINCT l_suppkey AS idx, CAST(l_partkey AS VARCHAR) AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem),
 mon AS (SELECT idx, ticker, CAST(unnest(generate_series(date_trunc('month', coalesce(start, DATE '1992-01-01')), date_trunc('month', coalesce(stop, DATE '1999-01-01') - INTERVAL 1 DAY), INTERVAL 1 MONTH)) AS DATE) AS month FROM sp WHERE start IS NULL OR stop IS NULL OR start < stop)
 SELECT m.idx, m.month, count(DISTINCT m.ticker) AS members, count(DISTINCT CASE WHEN b.ticker IS NULL THEN m.ticker END) AS without_bars FROM mon m LEFT JOIN bar b ON b.idx = m.idx AND b.ticker = m.ticker AND b.month = m.month GROUP BY 1, 2""")
def members_by_month(spark, d):
    """Members of each month, and those without a bar in it."""
    members, changes = _tables(spark, d)
    bars = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("idx"), F.col("l_partkey").cast("string").alias("ticker"), F.col("l_shipdate").alias("date"))
    return M.members_by_month(M.reconstruct(members, changes, ["idx"])["spells"], bars, ["idx"], "1992-01-01", "1999-01-01")
