"""Readers and writers: dated Parquet tables, comment-headed CSV, and parsers of semi-structured text columns.

A parser takes a DataFrame with one text column and gives typed rows; lines or documents that do not
fit go to the caller as nulls or by a reject rule of ``contracts``, never silently into defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, boundary: str | None, date: str = "date") -> DataFrame:
    """A Parquet table, cut strictly before the boundary; the filter is pushed to the scan."""
    df = spark.read.parquet(path)
    return df if boundary is None else df.where(F.col(date) < F.to_date(F.lit(boundary)))


def read_full(spark: SparkSession, path: str, reason: str) -> DataFrame:
    """The whole table; the caller says why."""
    if not reason.strip():
        raise ValueError("a reason is needed to read past the boundary")
    return spark.read.parquet(path)


def write_pull(df: DataFrame, path: str, pull_date: str) -> None:
    """One pull of a source as a partition; a second write of the same day replaces only that day."""
    df.withColumn("pull_date", F.to_date(F.lit(pull_date))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pull_date").parquet(path)


def read_spells_csv(spark: SparkSession, path: str) -> DataFrame:
    """Spell file with # comment lines: ticker, start, end (blank: open), start_known, security."""
    return spark.read.option("comment", "#").option("header", True).schema("ticker string, start date, end date, start_known boolean, security string").csv(path)


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.lower(t) == "nan", None).otherwise(F.nullif(t, F.lit("")))


def number_and_unit(c: str) -> tuple[Column, Column]:
    """``value`` and ``unit`` of text such as "0.01 USD"."""
    value = F.expr(f"try_cast(regexp_extract(trim({c}), '^[0-9.eE+-]+', 0) AS double)")
    return value.alias("value"), F.nullif(F.trim(F.regexp_extract(c, r"^\s*[0-9.eE+-]+\s*(.*)$", 1)), F.lit("")).alias("unit")


def vendor_symbol(c: Column) -> Column:
    """A class separator as the vendor writes it; null if it isn't a symbol."""
    s = F.replace(c, F.lit("."), F.lit("-"))
    return F.when(s.rlike(r"^[A-Z0-9]+(-[A-Z0-9]+)?$"), s)


def listed_symbol(c: Column, template: str) -> Column:
    return F.lower(F.format_string(template, c))


def parse_observations(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON with an observations array: date, value ('.' and blank are missing), realtime_start, realtime_end (text: 9999-12-31 is a sentinel)."""
    schema = "struct<observations: array<struct<date: string, value: string, realtime_start: string, realtime_end: string>>>"
    o = df.select(*(c for c in df.columns if c != body), F.inline(F.from_json(body, schema)["observations"]))
    value = F.expr("try_cast(nullif(nullif(trim(value), '.'), '') as double)")
    return o.withColumn("date", F.to_date("date")).withColumn("value", value).withColumn("realtime_start", F.to_date("realtime_start"))


def parse_frame(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON with a data array of facts: end, cik, entity_name, accn, val."""
    schema = "struct<data: array<struct<end: string, cik: bigint, entityName: string, accn: string, val: double>>>"
    o = df.select(*(c for c in df.columns if c != body), F.inline(F.from_json(body, schema)["data"]))
    return o.withColumn("end", F.to_date("end")).withColumnRenamed("entityName", "entity_name")


def parse_submissions(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON with arrays side by side: accession, form, filing_date, report_date, one row a filing."""
    schema = "struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, reportDate: array<string>>"
    rec = F.from_json(body, schema)
    rows = F.inline(F.arrays_zip(*(rec[k].alias(a) for k, a in (("accessionNumber", "accession"), ("form", "form"), ("filingDate", "filing_date"), ("reportDate", "report_date")))))
    o = df.select(*(c for c in df.columns if c != body), rows)
    return o.withColumn("filing_date", F.to_date("filing_date")).withColumn("report_date", F.to_date(blank_to_null(F.col("report_date"))))


def parse_index_line(df: DataFrame, line: str = "line", rejects: bool = False) -> DataFrame:
    """Pipe-delimited index lines: cik, company_name, form, filed, accn; other lines (preamble, rule) are left out.

    With ``rejects`` instead the lines that begin like one and aren't.
    """
    part = F.split(line, r"\|")
    if rejects:
        return df.where(F.col(line).rlike(r"^\d+\|") & (F.size(part) != 5))
    ok = df.where(F.size(part) == 5).where(F.col(line).rlike(r"^\d+\|"))
    return ok.select(*(c for c in df.columns if c != line), part[0].cast("long").alias("cik"), F.trim(part[1]).alias("company_name"), part[2].alias("form"), F.to_date(part[3]).alias("filed"), F.regexp_extract(part[4], r"(\d{10}-\d{2}-\d{6})", 1).alias("accn"))


def parse_code_ranges(df: DataFrame, file: str, number: str, line: str, rejects: bool = False) -> DataFrame:
    """Fixed-width code table: a header line (number, abbreviation, name) opens a group, indented low-high lines belong to it.

    With ``rejects`` instead the lines that are neither, nor blank.
    """
    head = F.regexp_extract(line, r"^\s{0,2}(\d{1,2})\s+(\w+)\s+(.+?)\s*$", 1)
    w = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    rng = r"^\s{3,}(\d{4})-(\d{4})"
    if rejects:
        return df.where(~F.col(line).rlike(rng) & (head == "") & (F.trim(line) != ""))
    g = df.withColumn("_h", F.when(~F.col(line).rlike(rng) & (head != ""), F.struct(head.cast("int").alias("group"), F.regexp_extract(line, r"^\s{0,2}\d{1,2}\s+(\w+)", 1).alias("label"))))
    g = g.withColumn("_g", F.last("_h", ignorenulls=True).over(w)).where(F.col(line).rlike(rng))
    return g.select(file, F.col("_g.group").alias("group"), F.col("_g.label").alias("label"), F.regexp_extract(line, rng, 1).cast("int").alias("low"), F.regexp_extract(line, rng, 2).cast("int").alias("high"))


def _rest(df: DataFrame, body: str) -> list[str]:
    return [c for c in df.columns if c != body]


def parse_vintage_dates(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON {"vintage_dates": [...]}: one row a date; an entry that is no date is null."""
    dates = F.from_json(body, "struct<vintage_dates: array<string>>")["vintage_dates"]
    return df.select(*_rest(df, body), F.explode(dates).alias("_d")).select(*_rest(df, body), F.try_to_timestamp("_d", F.lit("yyyy-MM-dd")).cast("date").alias("vintage"))


def parse_ticker_map(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON object of objects: cik, ticker (upper case), title."""
    cells = F.from_json(body, "map<string, struct<cik_str: bigint, ticker: string, title: string>>")
    x = df.select(*_rest(df, body), F.explode(F.map_values(cells)).alias("_c"))
    return x.select(*_rest(df, body), F.col("_c.cik_str").alias("cik"), F.upper("_c.ticker").alias("ticker"), F.col("_c.title").alias("title"))


def html_rows(html: Column, table_id: str) -> Column:
    """Cells of each data row of the table with the given id: array of arrays of trimmed text without tags."""
    table = F.regexp_extract(html, rf"(?is)<table[^>]*\bid\s*=\s*[\"']?{table_id}(?=[\"'\s>])[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), "&amp;", "&"))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), text))
    return F.filter(cells, lambda c: F.size(c) > 0)


def parse_constituents(df: DataFrame, html: str = "html") -> DataFrame:
    """Table "constituents": ticker (as the vendor writes it), listed_ticker, security, date_added (null if blank)."""
    x = df.select(*_rest(df, html), F.explode(html_rows(F.col(html), "constituents")).alias("_c"))
    cell = lambda k: F.get("_c", k)
    return x.select(*_rest(df, html), vendor_symbol(cell(0)).alias("ticker"), cell(0).alias("listed_ticker"), cell(1).alias("security"), F.try_to_timestamp(blank_to_null(cell(2)), F.lit("yyyy-MM-dd")).cast("date").alias("date_added"))


def parse_changes(df: DataFrame, html: str = "html") -> DataFrame:
    """Table "changes" with long dates: effective_date, added, added_security, removed, removed_security, reason;
    rows without a date or without either side are left to the caller by ``usable``."""
    x = df.select(*_rest(df, html), F.explode(html_rows(F.col(html), "changes")).alias("_c"))
    names = ("added", "added_security", "removed", "removed_security", "reason")
    x = x.select(*_rest(df, html), F.try_to_timestamp(F.get("_c", 0), F.lit("MMMM d, yyyy")).cast("date").alias("effective_date"), *(blank_to_null(F.get("_c", k)).alias(n) for k, n in enumerate(names, 1)))
    return x.withColumn("usable", F.col("effective_date").isNotNull() & (F.col("added").isNotNull() | F.col("removed").isNotNull()))


def parse_filing_header(df: DataFrame, body: str, cik: str) -> DataFrame:
    """Tagged header: accession, form, filing_date, and the code of the <FILER> block of the row's own number."""
    tag = lambda c, name: blank_to_null(F.regexp_extract(c, rf"<{name}>([^\n<]*)", 1))
    blocks = F.filter(F.split(body, "<FILER>"), lambda b: F.regexp_extract(b, r"<CIK>0*(\d+)", 1) == F.col(cik).cast("string"))
    own = F.get(blocks, 0)
    return df.select(*_rest(df, body), tag(F.col(body), "ACCESSION-NUMBER").alias("accession"), tag(F.col(body), "TYPE").alias("form"), F.try_to_timestamp(tag(F.col(body), "FILING-DATE"), F.lit("yyyyMMdd")).cast("date").alias("filing_date"), tag(own, "ASSIGNED-SIC").cast("int").alias("code"), own.isNotNull().alias("filer_found"))


def parse_ohlcv(df: DataFrame, line: str = "line") -> DataFrame:
    """Daily CSV lines: date, open, high, low, close, volume; ``rejected`` tells header, markup and torn lines."""
    schema = "date string, open string, high string, low string, close string, volume string"
    x = df.withColumn("_r", F.from_csv(F.col(line), schema))
    num = lambda c: F.expr(f"try_cast(_r.{c} AS double)").alias(c)
    x = x.select(*_rest(df, line), F.try_to_timestamp("_r.date", F.lit("yyyy-MM-dd")).cast("date").alias("date"), *(num(c) for c in ("open", "high", "low", "close", "volume")))
    return x.withColumn("rejected", F.col("date").isNull() | F.col("close").isNull())


def parse_series_csv(df: DataFrame, line: str = "line", rejects: bool = False) -> DataFrame:
    """Lines "date,value": '.', 'NA' and blank values are dropped, and so are lines that begin with no date.

    With ``rejects`` instead the lines without a date, and those whose value is neither a number nor one of these marks.
    """
    part = F.split(line, ",")
    x = df.select(*_rest(df, line), F.try_to_timestamp(F.get(part, 0), F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.expr(f"try_cast(trim(get(split({line}, ','), 1)) AS double)").alias("value"))
    if rejects:
        mark = F.trim(F.coalesce(F.get(part, 1), F.lit(""))).isin(".", "NA", "")
        date = F.try_to_timestamp(F.get(part, 0), F.lit("yyyy-MM-dd"))
        return df.where(date.isNull() | (F.expr(f"try_cast(trim(get(split({line}, ','), 1)) AS double)").isNull() & ~mark))
    return x.where("date IS NOT NULL AND value IS NOT NULL")


def parse_curve_csv(df: DataFrame, file: str, number: str, line: str, marker: str = "Date,") -> DataFrame:
    """Curve file: whatever stands before its header line (the one that begins with ``marker``) is skipped.

    date, beta0, beta1, beta2, tau1; days whose parameters are all missing are dropped, and ``broken``
    marks partial ones and those whose tau isn't positive.
    """
    w = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    seen = df.withColumn("_h", F.max(F.col(line).startswith(marker).cast("int")).over(w)).where("_h = 1")
    part = F.split(line, ",")
    names = ("beta0", "beta1", "beta2", "tau1")
    x = seen.select(file, F.try_to_timestamp(F.get(part, 0), F.lit("yyyy-MM-dd")).cast("date").alias("date"), *(F.expr(f"try_cast(trim(get(split({line}, ','), {k})) AS double)").alias(n) for k, n in enumerate(names, 1)))
    known = sum(F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names)
    return x.where(known > 0).withColumn("broken", (known < len(names)) | F.coalesce(F.col("tau1") <= 0, F.lit(False)))


def wide_to_long(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """A matrix with a column an asset to (key, name, value), nulls left out."""
    return df.unpivot([key], [c for c in df.columns if c != key], name, value).where(F.col(value).isNotNull())


def write_membership(states: DataFrame, path: str, date: str, asset: str, state: str) -> None:
    """States as one CSV matrix, a column an asset."""
    states.groupBy(date).pivot(asset).agg(F.first(state)).orderBy(date).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_membership(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """That matrix as (date, asset, state), cut before ``end``."""
    x = spark.read.option("header", True).option("inferSchema", True).csv(path)
    x = x if end is None else x.where(F.col("date") < F.to_date(F.lit(end)))
    return wide_to_long(x.withColumn("date", F.to_date("date")), "date", "asset", "state")


def content_hash(df: DataFrame) -> int:
    """Order-free hash of the rows of a table."""
    return int(df.agg(F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()[0])


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write a table unless the rows there are the same."""
    spark = df.sparkSession
    try:
        same = content_hash(spark.read.parquet(path).select(df.columns)) == content_hash(df)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        same = False
    if not same:
        df.write.mode("overwrite").parquet(path)
    return not same


def write_derived(df: DataFrame, path: str, manifest: str, inputs: list[str]) -> None:
    """A derived table, and a manifest row for each input it was made from."""
    df.write.mode("overwrite").parquet(path)
    rows = [(path, i, df.count(), str(content_hash(df))) for i in inputs]
    df.sparkSession.createDataFrame(rows, "table string, input string, rows long, content string").write.mode("append").parquet(manifest)


def write_reference(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """A small committed table as CSV; where it is from lies beside it as a table of its own."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    df.sparkSession.createDataFrame(sorted(provenance.items()), "key string, value string").write.mode("overwrite").json(f"{path}.provenance")


def write_partial(df: DataFrame, path: str, variant: str, digest: str) -> None:
    """One variant's history as a partition with its digest."""
    df.withColumn("digest", F.lit(digest)).withColumn("variant", F.lit(variant)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant").parquet(path)


def assemble(spark: SparkSession, path: str, key: str, value: str, order: list[str]) -> DataFrame:
    """All variants side by side on the key, in a fixed order; a variant that is missing raises."""
    x = spark.read.parquet(path)
    there = {r.variant for r in x.select("variant").distinct().collect()}
    if lost := [v for v in order if v not in there]:
        raise ValueError(f"variants without a history: {lost}")
    return x.groupBy(key).pivot("variant", order).agg(F.first(value)).orderBy(key)


def write_metrics(df: DataFrame, path: str, section: str) -> None:
    """Results as JSON, one partition a section; other sections stay."""
    df.withColumn("section", F.lit(section)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section").json(path)


def first_filing(filings: DataFrame, key: str, forms: list[str], start: str) -> DataFrame:
    """Earliest (filing_date, accession) of the given forms on or after ``start``."""
    f = filings.where(F.col("form").isin(forms) & (F.col("filing_date") >= F.to_date(F.lit(start))))
    return f.groupBy(key).agg(F.min(F.struct("filing_date", "accession")).alias("x")).select(key, "x.filing_date", "x.accession")


def svensson(n: Column, beta: list[Column], tau: list[Column]) -> Column:
    """Zero-coupon yield at maturity n; without a second tau (null or not positive) the four-parameter form."""
    a = n / tau[0]
    h1 = F.when(a == 0, 1.0).otherwise((1 - F.exp(-a)) / F.when(a != 0, a))
    y = beta[0] + beta[1] * h1 + beta[2] * (h1 - F.exp(-a))
    t2 = F.when(tau[1] > 0, tau[1])
    b = n / t2
    h2 = F.when(b == 0, 1.0).otherwise((1 - F.exp(-b)) / F.when(b != 0, b))
    return y + F.coalesce(beta[3] * (h2 - F.exp(-b)), F.lit(0.0))
