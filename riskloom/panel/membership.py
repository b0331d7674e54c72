"""Membership of an index from today's list and a table of dated changes, walked back in time.

``members`` has keys, ticker, security and date_added; ``changes`` has keys, effective_date, added,
added_security, removed, removed_security (a side may be blank) and, if rows of one date have an
order, ``row``. Keys tell indexes apart; all work is by (keys, ticker) or (keys, date).

Walking back, a removal puts a ticker into the set and an addition takes it out, removals of a date
before its additions. Either way the state behind an event is known from its kind alone, so the state
that an event meets is that of the event before it in the walk, or of today's list: a lag. An event
that meets the wrong state is reported and changes nothing; those that fit alternate, and a spell is a
removal (or today) with the next event of the walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _known(c: str) -> Column:
    """The cell without blanks around it; null if nothing is left."""
    t = F.trim(F.col(c).cast("string"))
    return F.when(t != "", t)


def sides(changes: DataFrame, keys: list[str], snapshot: str | None) -> DataFrame:
    """One row a change and side: keys, date, ticker, security, kind ('added', 'removed'), row; none after the snapshot.

    Rows of a date without ``row`` are taken in the order of their tickers and names.
    """
    live = changes if snapshot is None else changes.where(F.col("effective_date") <= F.to_date(F.lit(snapshot)))
    row = F.col("row").cast("long") if "row" in changes.columns else F.lit(None).cast("long")
    side = lambda kind: F.struct(F.lit(kind).alias("kind"), _known(kind).alias("ticker"), _known(f"{kind}_security").alias("security"))
    return live.select(*keys, F.col("effective_date").alias("date"), row.alias("row"), F.explode(F.array(side("removed"), side("added"))).alias("s")).select(*keys, "date", "row", "s.*").where("ticker IS NOT NULL")


def rename_links(members: DataFrame, events: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, ticker, alias, date) of the links, and (keys, ticker, date) of dated members without an addition row.

    A member whose date has no addition of its own ticker is linked to an addition of that date under
    a ticker that isn't a member now, where there is exactly one of either.
    """
    reach = events.groupBy(*keys).agg(F.min("date").alias("reach"))
    added = events.where("kind = 'added'")
    dated = members.where("date_added IS NOT NULL").select(*keys, "ticker", F.col("date_added").alias("date"))
    if keys:
        dated = dated.join(reach, keys)
    else:
        dated = dated.crossJoin(F.broadcast(reach))  # one row
    lone = dated.where("date >= reach").drop("reach").join(added.select(*keys, "date", "ticker").distinct(), [*keys, "date", "ticker"], "left_anti")
    new = added.join(members.select(*keys, "ticker").distinct(), [*keys, "ticker"], "left_anti")
    one_new = new.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_new"), F.min("ticker").alias("alias"))
    one_lone = lone.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_lone"))
    settled = lone.join(one_lone, [*keys, "date"]).join(one_new, [*keys, "date"], "left")
    fits = (F.col("_lone") == 1) & (F.coalesce("_new", F.lit(0)) == 1)
    return settled.where(fits).select(*keys, "ticker", "alias", "date"), settled.where(~fits).select(*keys, "ticker", "date")


def walked(members: DataFrame, events: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """``events`` with ``name`` (the ticker after linking), ``inside`` (whether it is in the set when the walk meets the event) and ``fits``."""
    # Of several dates with one alias the latest counts.
    alias = links.groupBy(*keys, "alias").agg(F.max_by("ticker", "date").alias("_now")).withColumnRenamed("alias", "ticker")
    e = events.join(alias, [*keys, "ticker"], "left").withColumn("name", F.when(F.col("kind") == "added", F.coalesce("_now", "ticker")).otherwise(F.col("ticker"))).drop("_now")
    now = members.select(*keys, F.col("ticker").alias("name"), F.lit(True).alias("_now")).distinct()
    w = Window.partitionBy(*keys, "name").orderBy(F.desc("date"), F.col("kind") == "added", F.asc_nulls_last("row"), "ticker", F.asc_nulls_last("security"))
    before = F.lag("kind").over(w)
    e = e.join(now, [*keys, "name"], "left").withColumn("inside", F.when(before.isNull(), F.coalesce("_now", F.lit(False))).otherwise(before == "removed")).withColumn("_at", F.row_number().over(w))
    return e.drop("_now").withColumn("fits", F.col("inside") == (F.col("kind") == "added"))


def spells(members: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ticker, start, end, start_known, security) of ``walked`` events: half-open spells; a null end is today, a null start is unknown."""
    good = events.where("fits").select(*keys, F.col("name").alias("ticker"), "_at", "kind", "date", "security")
    current = members.groupBy(*keys, "ticker").agg(F.min(_known("security")).alias("security"))
    today = current.select(*keys, "ticker", F.lit(0).alias("_at"), F.lit("today").alias("kind"), F.lit(None).cast("date").alias("date"), "security")
    w = Window.partitionBy(*keys, "ticker").orderBy("_at")
    s = good.unionByName(today).withColumn("start", F.lead("date").over(w)).withColumn("_opened", F.lead("security").over(w)).where("kind <> 'added'")
    return s.select(*keys, "ticker", "start", F.col("date").alias("end"), F.col("start").isNotNull().alias("start_known"), F.coalesce("security", F.when(F.col("start").isNotNull(), F.col("_opened"))).alias("security"))


def reconstruct(members: DataFrame, changes: DataFrame, keys: list[str], snapshot: str | None = None) -> dict[str, DataFrame]:
    """``spells``; ``inconsistencies`` (keys, date, ticker, kind); ``links``; ``unmatched`` members; ``undated`` members; ``reach``.

    ``keys`` may be empty for one index. An empty table of changes gives spells without a known start;
    repeated members count once; members without a ticker are left out.
    """
    m = members.withColumn("ticker", _known("ticker")).where("ticker IS NOT NULL")
    events = sides(changes, keys, snapshot)
    links, unmatched = rename_links(m, events, keys)
    e = walked(m, events, links, keys)
    kind = F.when(F.col("kind") == "added", "added_not_in_set").otherwise("removed_already_in_set")
    return {
        "spells": spells(m, e, keys),
        "inconsistencies": e.where("NOT fits").select(*keys, "date", "ticker", kind.alias("kind")),
        "links": links,
        "unmatched": unmatched,
        "undated": m.where("date_added IS NULL").select(*keys, "ticker").distinct(),
        "reach": events.groupBy(*keys).agg(F.min("date").alias("reach")),
    }


def gaps_by_year(parts: dict[str, DataFrame], changes: DataFrame, keys: list[str], snapshot: str | None = None) -> DataFrame:
    """(keys, year, rows, inconsistencies, links, unmatched): counts of rows, no year without one is listed."""
    live = changes if snapshot is None else changes.where(F.col("effective_date") <= F.to_date(F.lit(snapshot)))
    names = ["rows", "inconsistencies", "links", "unmatched"]
    tables = [live.select(*keys, F.col("effective_date").alias("date")), *(parts[n].select(*keys, "date") for n in names[1:])]
    out = None
    for name, t in zip(names, tables, strict=True):
        one = t.select(*keys, F.year("date").alias("year"), *(F.lit(int(n == name)).alias(n) for n in names))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys, "year").agg(*(F.sum(n).alias(n) for n in names))


def members_by_month(spells: DataFrame, bars: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """(keys, month, members, without_bars) of months with members: tickers that a spell has in the month, and those without a row of ``bars`` (keys, ticker, date) in it.

    An unknown start is ``first``, today is ``last``. A ticker's spells become runs of months that don't
    overlap; a run counts from its first month until the one after its last, so no row is made for a month of a spell.
    """
    number = lambda c: F.year(c) * 12 + F.month(c) - 1
    bound = lambda c, d: F.coalesce(c, F.to_date(F.lit(d)))
    s = spells.where("start IS NULL OR end IS NULL OR start < end").select(*keys, "ticker", number(bound("start", first)).alias("_a"), number(F.date_sub(bound("end", last), 1)).alias("_b")).where("_a <= _b")
    before = Window.partitionBy(*keys, "ticker").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    runs = s.withColumn("_a", F.greatest("_a", F.max("_b").over(before) + 1)).where("_a <= _b")  # greatest() leaves nulls out
    seen = bars.select(*keys, "ticker", number("date").alias("_m")).repartition(*keys, "ticker").groupBy(*keys, "ticker").agg(F.collect_set("_m").alias("_seen"))
    steps = "array(struct(_a AS _m, 1 AS _in, 0 AS _bar), struct(_b + 1 AS _m, -1 AS _in, 0 AS _bar))"
    met = "transform(filter(coalesce(_seen, array()), x -> x BETWEEN _a AND _b), x -> struct(x AS _m, 0 AS _in, 1 AS _bar))"
    rows = runs.join(seen, [*keys, "ticker"], "left").select(*keys, F.explode(F.expr(f"concat({steps}, {met})")).alias("s")).select(*keys, "s.*")
    w = Window.partitionBy(*keys).orderBy("_m")
    m = rows.groupBy(*keys, "_m").agg(F.sum("_in").alias("_in"), F.sum("_bar").alias("_bar"))
    m = m.withColumn("members", F.sum("_in").over(w)).withColumn("_next", F.lead("_m").over(w)).where("members > 0")
    m = m.select(*keys, "_m", "members", "_bar", F.explode(F.expr("sequence(_m, _next - 1)")).alias("_at"))
    return m.select(*keys, F.expr("make_date(_at div 12, _at % 12 + 1, 1)").alias("month"), "members", (F.col("members") - F.when(F.col("_at") == F.col("_m"), F.col("_bar")).otherwise(0)).alias("without_bars"))
