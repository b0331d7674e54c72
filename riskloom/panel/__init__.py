"""Calendars, as-of and interval joins, membership. Long tables in, long tables out; keys are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(df: DataFrame, boundary: str, date: str = "date") -> DataFrame:
    """Rows strictly before the boundary; the filter reaches the scan."""
    return df.where(F.col(date) < F.to_date(F.lit(boundary)))


def month(date: str = "date") -> Column:
    return F.trunc(F.col(date), "MM")


def month_ends(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Last traded date of each calendar month, by keys."""
    return df.groupBy(*keys, month(date).alias("month")).agg(F.max(date).alias("month_end"))


def month_sample(df: DataFrame, keys: list[str], value: str, date: str = "date") -> DataFrame:
    """Value at each month's last traded date."""
    last = F.max_by(F.struct(date, value), date)
    return df.groupBy(*keys, month(date).alias("month")).agg(last.alias("x")).select(*keys, "month", F.col(f"x.{date}").alias("month_end"), F.col(f"x.{value}").alias(value))


def union_calendar(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer alignment; gaps stay null."""
    return left.join(right, keys, "full")


def reindex(df: DataFrame, calendar: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` on the rows of ``calendar``; gaps stay null."""
    return calendar.join(df, keys, "left")


def asof(probes: DataFrame, facts: DataFrame, key: str, date: str, value: str, out: str, fact_date: str | None = None) -> DataFrame:
    """Latest fact at or before each probe, by key: a union and a running last value.

    One shuffle on the key and one sort; nothing is paired. Of facts with one date the largest counts.
    """
    f = facts.groupBy(key, F.col(fact_date or date).alias(date)).agg(F.max(value).alias("_v"))
    extra = [c for c in probes.columns if c not in (key, date)]
    p = probes.select(key, date, F.lit(1).alias("_probe"), F.struct(*extra).alias("_p") if extra else F.lit(None).alias("_p"), F.lit(None).cast(f.schema["_v"].dataType).alias("_v"))
    u = p.unionByName(f.select(key, date, F.lit(0).alias("_probe"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), "_v"))
    w = Window.partitionBy(key).orderBy(date, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    got = u.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_probe = 1")
    return got.select(key, date, *(F.col(f"_p.{c}").alias(c) for c in extra), out)


def asof_with_head(probes: DataFrame, facts: DataFrame, key: str, date: str, value: str, out: str, fact_date: str | None = None) -> DataFrame:
    """As-of value; before the first fact its value is used and ``approximated`` is set."""
    got = asof(probes, facts, key, date, value, out, fact_date)
    head = facts.groupBy(key).agg(F.min_by(value, F.struct(F.col(fact_date or date), -F.col(value))).alias("_head"))
    got = got.join(head, key, "left")
    return got.withColumn("approximated", F.col(out).isNull() & F.col("_head").isNotNull()).withColumn(out, F.coalesce(out, "_head")).drop("_head")


def code_group(df: DataFrame, ranges: DataFrame, code: str, unassigned: str) -> DataFrame:
    """Label of the code range [low, high] that holds a code; none is ``unassigned``, null stays null.

    ``ranges`` is a small dimension; it is left to Spark to broadcast it by its size.
    """
    r = ranges.select("label", F.col("low").alias("_low"), F.col("high").alias("_high"))
    got = df.join(r, (F.col(code) >= F.col("_low")) & (F.col(code) <= F.col("_high")), "left")
    return got.withColumn("label", F.when(F.col(code).isNull(), None).otherwise(F.coalesce("label", F.lit(unassigned)))).drop("_low", "_high")


def spells_to_days(spells: DataFrame, first: str, last: str) -> DataFrame:
    """One row a day of each half-open spell [start, end); open ends take the bounds."""
    start = F.greatest(F.coalesce("start", F.to_date(F.lit(first))), F.to_date(F.lit(first)))
    end = F.least(F.coalesce("end", F.to_date(F.lit(last))), F.to_date(F.lit(last)))
    return spells.withColumn("_s", start).withColumn("_e", end).where("_s < _e").withColumn("date", F.explode(F.sequence("_s", F.date_sub("_e", 1)))).drop("_s", "_e")


def membership_state(days: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """1 for a member with a bar, 2 for one without."""
    b = bars.select(*keys).distinct().withColumn("_bar", F.lit(1))
    return days.join(b, keys, "left").withColumn("state", F.when(F.col("_bar").isNull(), 2).otherwise(1)).drop("_bar")


def state_counts(spells: DataFrame, bars: DataFrame, keys: list[str], first: str, last: str, date: str = "date") -> DataFrame:
    """(date, state, n): of each date's members how many have a bar (1) and how many don't (2), as counts of ``membership_state`` over ``spells_to_days``.

    Members are counted from their first day until the day after their last, so no row is made for a day
    of a spell; a bar is counted where its date lies in a spell.
    """
    low, high = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    start, end = F.greatest(F.coalesce("start", low), low), F.least(F.coalesce("end", high), high)
    s = spells.select(*keys, start.alias("_s"), end.alias("_e")).where("_s < _e")
    step = lambda c, n: F.struct(F.col(c).alias(date), F.lit(n).cast("long").alias("_in"))
    steps = s.select(F.explode(F.array(step("_s", 1), step("_e", -1))).alias("x")).groupBy(F.col(f"x.{date}").alias(date)).agg(F.sum("x._in").alias("_in"))
    b = bars.select(*keys, date).where((F.col(date) >= low) & (F.col(date) < high)).dropna(subset=keys).distinct()
    same = F.lit(True)
    for k in keys:  # null-safe, since a filter on spells would reach their scan and keep both reads of them from sharing a shuffle
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}"))
    met = b.alias("b").join(s.alias("s"), same).where((F.col(date) >= F.col("_s")) & (F.col(date) < F.col("_e"))).groupBy(date).agg(F.count(F.lit(1)).alias("_bars"))
    calendar = spells.sparkSession.range(1).select(F.explode(F.sequence(low, high)).alias(date))  # all that follows has a row a day
    n = calendar.join(steps, date, "left").withColumn("_in", F.sum("_in").over(Window.orderBy(date))).join(met, date, "left").withColumn("_bars", F.coalesce("_bars", F.lit(0)))
    state = lambda k, c: F.struct(F.lit(k).alias("state"), c.alias("n"))
    return n.select(date, F.explode(F.array(state(1, F.col("_bars")), state(2, F.col("_in") - F.col("_bars")))).alias("x")).select(date, "x.*").where("n > 0")


def runs(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Episodes of consecutive rows whose flag is true: first, last and length."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = df.withColumn("_rn", F.row_number().over(w)).where(flag).withColumn("_g", F.col("_rn") - F.row_number().over(w))
    return r.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")


def quarter_label(date: str) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def trading_dates(df: DataFrame, date: str = "date") -> DataFrame:
    """Dates on which at least one other column isn't null."""
    known = F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in df.columns if c != date))
    return df.where(known).select(date).distinct()


def quarters(start: str, end: str) -> Column:
    """First days of all quarters from that of ``start`` to that of ``end``, exploded."""
    return F.explode(F.sequence(F.trunc(start, "quarter"), F.trunc(end, "quarter"), F.expr("interval 3 month")))


def three_states(date: Column, start: Column, end: Column, bar: Column) -> Column:
    """0: outside [start, end); 1: member with a bar; 2: member without."""
    inside = F.coalesce((date >= start) & (date < end), F.lit(False))
    return F.when(~inside, 0).when(bar.isNotNull(), 1).otherwise(2)
