"""Queries over the parsers, on text that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sources as S
from .base import query, rnd, table


@query("c_json_observations", "SELECT o_custkey AS series, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE round(o_totalprice, 2) END AS value FROM orders")
def json_observations(spark, d):
    o = table(spark, d, "orders")
    cell = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderstatus") == "P", ".").otherwise(F.format_string("%.2f", "o_totalprice")).alias("value"), F.lit("2000-01-01").alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end"))
    body = o.groupBy(F.col("o_custkey").alias("series")).agg(F.to_json(F.struct(F.collect_list(cell).alias("observations"))).alias("body"))
    return S.parse_observations(body).select("series", "date", "value")


@query("c_json_frames", "SELECT o_orderstatus AS period, CAST(o_orderdate AS DATE) AS end, o_custkey AS cik, o_totalprice AS val FROM orders")
def json_frames(spark, d):
    o = table(spark, d, "orders")
    fact = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("entityName"), F.lit("x").alias("accn"), F.col("o_totalprice").alias("val"))
    # A frame a customer and status: no group holds a fixed share of the table.
    body = o.groupBy("o_custkey", F.col("o_orderstatus").alias("period")).agg(F.to_json(F.struct(F.collect_list(fact).alias("data"))).alias("body")).drop("o_custkey")
    return S.parse_frame(body).select("period", "end", "cik", "val")


@query("c_first_filing", "SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS filing_date FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= DATE '1996-01-01' GROUP BY 1")
def first_filing(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderdate")).alias("x"))
    body = o.select("o_custkey", F.to_json(F.struct(F.col("x.o_orderkey").cast("array<string>").alias("accessionNumber"), F.col("x.o_orderpriority").alias("form"), F.transform("x.o_orderdate", lambda t: F.date_format(t, "yyyy-MM-dd")).alias("filingDate"), F.transform("x", lambda _: F.lit("")).alias("reportDate"))).alias("body"))
    return S.first_filing(S.parse_submissions(body), "o_custkey", ["1-URGENT", "2-HIGH"], "1996-01-01").select("o_custkey", "filing_date")


@query("c_index_lines", "SELECT o_custkey AS cik, o_orderpriority AS company_name, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filed, concat(lpad(CAST(o_custkey AS VARCHAR), 10, '0'), '-07-', lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0')) AS accn FROM orders")
def index_lines(spark, d):
    o = table(spark, d, "orders")
    accn = F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-07-"), F.lpad((F.col("o_orderkey") % 1_000_000).cast("string"), 6, "0"))
    lines = o.select(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("edgar/data/"), accn, F.lit(".txt"))).alias("line"))
    return S.parse_index_line(lines.union(o.select(F.lit("-----").alias("line")).limit(1)))


@query("c_curve_yields", "WITH p AS (SELECT s_suppkey, s_acctbal / 1000 AS b0, -1.0 AS b1, 0.5 AS b2, 0.3 AS b3, 1.0 + s_nationkey / 10.0 AS t1, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE 2.0 + s_nationkey / 5.0 END AS t2 FROM supplier), n AS (SELECT unnest([1.0, 5.0, 10.0]) AS n) SELECT s_suppkey, n, round(b0 + b1 * (1 - exp(-n / t1)) / (n / t1) + b2 * ((1 - exp(-n / t1)) / (n / t1) - exp(-n / t1)) + coalesce(b3 * ((1 - exp(-n / t2)) / (n / t2) - exp(-n / t2)), 0), 6) AS y, round(exp(-n * (b0 + b1 * (1 - exp(-n / t1)) / (n / t1) + b2 * ((1 - exp(-n / t1)) / (n / t1) - exp(-n / t1)) + coalesce(b3 * ((1 - exp(-n / t2)) / (n / t2) - exp(-n / t2)), 0)) / 100), 6) AS discount FROM p, n")
def curve_yields(spark, d):
    p = table(spark, d, "supplier").withColumn("n", F.explode(F.array(F.lit(1.0), F.lit(5.0), F.lit(10.0))))
    t2 = F.when(F.col("s_nationkey") % 3 != 0, 2.0 + F.col("s_nationkey") / 5.0)
    y = S.svensson(F.col("n"), [F.col("s_acctbal") / 1000, F.lit(-1.0), F.lit(0.5), F.lit(0.3)], [1.0 + F.col("s_nationkey") / 10.0, t2])
    return p.select("s_suppkey", "n", rnd(y, 6).alias("y"), rnd(F.exp(-F.col("n") * y / 100), 6).alias("discount"))


@query("c_vintage_dates", "SELECT DISTINCT o_custkey AS series, CAST(o_orderdate AS DATE) AS vintage FROM orders")
def vintage_dates(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("series")).agg(F.to_json(F.struct(F.collect_set(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("vintage_dates"))).alias("body"))
    return S.parse_vintage_dates(o)


@query("c_ticker_map", "SELECT c_nationkey AS part, c_custkey AS cik, upper(c_mktsegment) AS ticker, c_name AS title FROM customer")
def ticker_map(spark, d):
    cell = F.struct(F.col("c_custkey").cast("string").alias("k"), F.struct(F.col("c_custkey").alias("cik_str"), F.lower("c_mktsegment").alias("ticker"), F.col("c_name").alias("title")).alias("v"))
    # A file a nation and a hundred customers: none grows with the table.
    body = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("part"), F.expr("c_custkey div 100")).agg(F.to_json(F.map_from_entries(F.collect_list(cell))).alias("body"))
    return S.parse_ticker_map(body.select("part", "body"))


def _page(rows: Column, table_id: str) -> Column:
    tr = lambda r: F.concat(F.lit("<TR class='x'>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td> <a href='y'>"), c, F.lit("</a> </td>"))), ""), F.lit("</TR>\n"))
    return F.concat(F.lit(f"<html><table id='{table_id}x'><tr><td>no</td></tr></table><table class='w' id=\"{table_id}\"><tr><th>head</th></tr>"), F.array_join(F.transform(rows, tr), ""), F.lit("</table></html>"))


@query("c_html_constituents", "SELECT s_nationkey AS page, 'SUP-' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) AS ticker, s_name AS security, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(DATE '2000-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS DATE) END AS date_added FROM supplier")
def html_constituents(spark, d):
    cells = F.array(F.concat(F.lit("SUP."), F.char(65 + F.col("s_suppkey") % 26)), F.col("s_name"), F.when(F.col("s_suppkey") % 3 != 0, F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int")), "yyyy-MM-dd")).otherwise(" "))
    pages = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("page"), F.expr("s_suppkey div 500")).agg(_page(F.collect_list(cells), "constituents").alias("html"))
    return S.parse_constituents(pages.select("page", "html")).select("page", "ticker", "security", "date_added")


@query("c_html_changes", "SELECT c_nationkey AS page, CAST(DATE '1999-12-25' + CAST(c_custkey % 900 AS INTEGER) AS DATE) AS effective_date, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS added, CASE WHEN c_custkey % 4 <> 1 AND c_custkey % 12 <> 0 THEN c_mktsegment END AS removed, c_custkey % 12 <> 0 AS usable FROM customer")
def html_changes(spark, d):
    k = F.col("c_custkey")
    cells = F.array(F.date_format(F.date_add(F.lit("1999-12-25").cast("date"), (k % 900).cast("int")), "MMMM d, yyyy"), F.when(k % 4 != 0, F.col("c_name")).otherwise(""), F.lit("x"), F.when((k % 4 != 1) & (k % 12 != 0), F.col("c_mktsegment")).otherwise("nan"), F.lit(""), F.lit("r"))
    pages = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("page"), F.expr("c_custkey div 500")).agg(_page(F.collect_list(cells), "changes").alias("html"))
    return S.parse_changes(pages.select("page", "html")).select("page", "effective_date", "added", "removed", "usable")


@query("c_filing_headers", "SELECT o_custkey AS cik, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS accession, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filing_date, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 9000 AS INTEGER) END AS code, o_orderkey % 5 <> 0 AS filer_found FROM orders")
def filing_headers(spark, d):
    k = F.col("o_orderkey")
    block = lambda cik, code: F.concat(F.lit("<FILER>\n<CIK>"), F.lpad(cik.cast("string"), 10, "0"), F.lit("\n<ASSIGNED-SIC>"), code.cast("string"), F.lit("\n</FILER>\n"))
    own = F.when(k % 5 != 0, block(F.col("o_custkey"), k % 9000)).otherwise("")
    body = F.concat(F.lit("<SEC-HEADER>\n<ACCESSION-NUMBER>"), F.lpad(k.cast("string"), 10, "0"), F.lit("\n<TYPE>"), "o_orderpriority", F.lit("\n<FILING-DATE>"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("\n"), block(F.col("o_custkey") + 10_000_000, F.lit(7)), own)
    return S.parse_filing_header(table(spark, d, "orders").select(F.col("o_custkey").alias("cik"), body.alias("body")), "body", "cik")


@query("c_ohlcv_lines", "SELECT o_custkey AS asset, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END AS close, o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 AS rejected FROM orders")
def ohlcv_lines(spark, d):
    p = F.format_string("%.2f", "o_totalprice")
    good = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), p, p, p, F.when(F.col("o_orderkey") % 7 != 0, p).otherwise("N/D"), F.lit("10"))
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("asset"), F.when(F.col("o_orderkey") % 9 != 0, good).otherwise("<html>please wait</html>").alias("line"))
    return S.parse_ohlcv(lines).select("asset", "date", "close", "rejected")


@query("c_series_lines", "SELECT o_custkey AS series, CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 2) AS value FROM orders WHERE o_orderkey % 6 <> 0")
def series_lines(spark, d):
    v = F.when(F.col("o_orderkey") % 12 == 0, ".").when(F.col("o_orderkey") % 6 == 0, "NA").otherwise(F.format_string("%.2f", "o_totalprice"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("series"), F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), v).alias("line"))
    head = o.select("series").distinct().select("series", F.lit("observation_date,VALUE").alias("line"))
    return S.parse_series_csv(o.unionByName(head))


@query("c_curve_file", "SELECT o_custkey AS file, CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 2) AS beta0, CASE WHEN o_orderkey % 4 <> 0 THEN 1.5 END AS beta1, o_orderkey % 4 = 0 OR o_orderkey % 10 = 0 AS broken FROM orders WHERE o_orderkey % 8 <> 0")
def curve_file(spark, d):
    k = F.col("o_orderkey")
    num = lambda c, x: F.when(c, "NA").otherwise(x)
    gone = k % 8 == 0
    line = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), num(gone, F.format_string("%.2f", "o_totalprice")), num(k % 4 == 0, F.lit("1.5")), num(gone, F.lit("0.5")), num(gone, F.when(k % 10 == 0, "-1").otherwise("2")))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), (k + 10).alias("number"), line.alias("line"))
    head = o.select("file").distinct().select("file", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("number"), F.lit(x).alias("line")) for i, x in enumerate(("A note,with commas", "2001-01-01,9,9,9,9", "Date,BETA0,BETA1,BETA2,TAU1"))))).alias("x")).select("file", "x.*")
    return S.parse_curve_csv(o.unionByName(head), "file", "number", "line").select("file", "date", "beta0", "beta1", "broken")


@query("c_wide_states", "SELECT CAST(l_shipdate AS DATE) AS date, lower(l_returnflag) AS asset, count(*) AS state FROM lineitem GROUP BY 1, 2")
def wide_states(spark, d):
    """Long to wide and back: the cells that exist."""
    x = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.lower("l_returnflag").alias("asset"))
    return S.wide_to_long(x.groupBy("date").pivot("asset", ["a", "n", "r"]).count(), "date", "asset", "state")
