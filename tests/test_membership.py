"""The backward walk by hand, and against a plain walk over random events."""

from __future__ import annotations

import random
from datetime import date

import pytest

from riskloom.panel import membership as M

CHANGES = "effective_date date, added string, added_security string, removed string, removed_security string, row int"
MEMBERS = "ticker string, security string, date_added date"


def d(s):
    return date.fromisoformat(s)


@pytest.fixture(scope="module")
def parts(spark):
    members = [("AB", "Able", None), ("CD.B", "Cord", d("1999-01-04")), ("NEWCO", "New Company", d("2012-03-05")), ("LATE", "Late", d("2016-07-01")), ("OPEN", "Open", d("2011-02-01"))]
    changes = [
        (d("2030-01-01"), "FUTURE", "Future", "AB", "Able", 0),  # announced, after the snapshot
        (d("2018-04-02"), "GHOST", "Ghost", "GONE", "Gone", 1),  # GHOST is in no list
        (d("2012-03-05"), "OLDNAME", "Old name", "LEFT", " Left ", 2),  # OLDNAME is today's NEWCO
        (d("2011-02-01"), "OPEN", "Open", None, None, 3),
        (d("2009-09-09"), None, "", "LEFT", "Left", 4),  # already in the set at that time
        (d("2006-06-06"), "  ", None, "FIRST", "First", 5),
    ]
    m, c = spark.createDataFrame(members, MEMBERS), spark.createDataFrame(changes, CHANGES)
    out = M.reconstruct(m, c, [], "2020-12-31")
    return {k: v.collect() for k, v in out.items()} | {"gaps": M.gaps_by_year(out, c, [], "2020-12-31").collect()}


def spell(parts, ticker):
    rows = [r for r in parts["spells"] if r.ticker == ticker]
    assert len(rows) == 1, ticker
    return rows[0]


def test_spells_are_half_open_with_unknown_starts(parts):
    assert parts["reach"][0].reach == d("2006-06-06")
    for t in ("AB", "CD.B", "LATE"):
        s = spell(parts, t)
        assert (s.start, s.end, s.start_known) == (None, None, False)
    s = spell(parts, "OPEN")
    assert (s.start, s.end, s.start_known) == (d("2011-02-01"), None, True)
    assert spell(parts, "GONE").end == d("2018-04-02") and spell(parts, "LEFT").end == d("2012-03-05") and spell(parts, "FIRST").end == d("2006-06-06")
    assert spell(parts, "LEFT").security == "Left" and "FUTURE" not in {r.ticker for r in parts["spells"]}


def test_links_only_where_the_date_settles_it(parts):
    assert [tuple(r) for r in parts["links"]] == [("NEWCO", "OLDNAME", d("2012-03-05"))]
    assert spell(parts, "NEWCO").start == d("2012-03-05") and "OLDNAME" not in {r.ticker for r in parts["spells"]}
    assert [tuple(r) for r in parts["unmatched"]] == [("LATE", d("2016-07-01"))] and [r.ticker for r in parts["undated"]] == ["AB"]


def test_events_that_fit_nothing_are_counted(parts):
    assert sorted(tuple(r) for r in parts["inconsistencies"]) == [(d("2009-09-09"), "LEFT", "removed_already_in_set"), (d("2018-04-02"), "GHOST", "added_not_in_set")]
    gaps = {r.year: (r["rows"], r.inconsistencies, r.links, r.unmatched) for r in parts["gaps"]}
    assert gaps == {2006: (1, 0, 0, 0), 2009: (1, 1, 0, 0), 2011: (1, 0, 0, 0), 2012: (1, 0, 1, 0), 2016: (0, 0, 0, 1), 2018: (1, 1, 0, 0)}


def test_two_candidates_settle_nothing(spark):
    m = spark.createDataFrame([("A", "a", d("2010-01-01")), ("B", "b", d("2010-01-01")), ("C", "c", d("2011-01-01"))], MEMBERS)
    rows = [(d("2010-01-01"), "X", None, None, None, 0), (d("2011-01-01"), "Y", None, None, None, 1), (d("2011-01-01"), "Z", None, None, None, 2), (d("2000-01-01"), None, None, "Q", None, 3)]
    out = M.reconstruct(m, spark.createDataFrame(rows, CHANGES), [])
    assert out["links"].count() == 0 and {r.ticker for r in out["unmatched"].collect()} == {"A", "B", "C"}


def plain_walk(members, changes):
    """State by state, newest date first, removals before additions."""
    state, out, odd = {t: None for t in members}, [], []
    for when in sorted({c[0] for c in changes}, reverse=True):
        block = sorted((c for c in changes if c[0] == when), key=lambda c: c[5])
        for c in block:
            if c[3]:
                if c[3] in state:
                    odd.append((when, c[3], "removed_already_in_set"))
                else:
                    state[c[3]] = when
        for c in block:
            if c[1]:
                if c[1] in state:
                    out.append((c[1], when, state.pop(c[1]), True))
                else:
                    odd.append((when, c[1], "added_not_in_set"))
    key = lambda s: tuple(str(x) for x in s)
    return sorted([*out, *((t, None, e, False) for t, e in state.items())], key=key), sorted(odd, key=key)


def test_equals_a_plain_walk_by_index(spark):
    rng = random.Random(4)
    tickers = [f"T{k}" for k in range(12)]
    members, changes, want, odd = [], [], [], []
    for idx in range(5):
        now = rng.sample(tickers, 5)
        rows = [(date(2000 + rng.randint(0, 9), rng.randint(1, 3), rng.randint(1, 3)), rng.choice([*tickers, None]), None, rng.choice([*tickers, None]), None, k) for k in range(60)]
        members += [(idx, t, None, None) for t in now]
        changes += [(idx, *r) for r in rows]
        s, o = plain_walk(now, rows)
        want += [(idx, *x) for x in s]
        odd += [(idx, *x) for x in o]
    out = M.reconstruct(spark.createDataFrame(members, "idx int, " + MEMBERS), spark.createDataFrame(changes, "idx int, " + CHANGES).repartition(4), ["idx"])
    key = lambda s: tuple(str(x) for x in s)
    assert sorted(((r.idx, r.ticker, r.start, r.end, r.start_known) for r in out["spells"].collect()), key=key) == sorted(want, key=key)
    assert sorted((tuple(r) for r in out["inconsistencies"].collect()), key=key) == sorted(odd, key=key)


def test_no_changes(spark):
    m = spark.createDataFrame([("A", "a", d("2010-01-01")), ("A", None, None), (None, "x", None)], MEMBERS)
    out = M.reconstruct(m, spark.createDataFrame([], CHANGES), [])
    assert [tuple(r) for r in out["spells"].collect()] == [("A", None, None, False, "a")] and out["links"].count() == 0


def test_members_by_month_equal_a_plain_count(spark):
    rng = random.Random(5)
    day = lambda: date(2001 + rng.randrange(3), rng.randrange(1, 13), rng.randrange(1, 28))
    spells, bars = [(1, "A", d("2001-02-10"), d("2001-03-05")), (1, "A", d("2001-03-20"), d("2001-03-25")), (1, "A", d("2001-03-27"), d("2001-06-01")), (1, "B", d("2002-02-02"), d("2002-02-02")), (None, "N", None, d("2001-02-01"))], [(None, "N", d("2001-01-02")), (1, "A", None), (1, "A", d("2001-03-02")), (1, "A", d("2001-03-30"))]
    for ticker in "CDEFGHIJ":
        cuts = sorted({day() for _ in range(rng.randrange(2, 9))})
        spells += [(2, ticker, x, y) for x, y in zip(cuts[::2], cuts[1::2])] + [(2, ticker, cuts[-1], None)] * (len(cuts) % 2) + [(2, ticker, None, cuts[0])] * rng.randrange(2)
        bars += [(2, ticker, day()) for _ in range(12)]
    s = spark.createDataFrame(spells, "k int, ticker string, start date, end date").repartition(3)
    b = spark.createDataFrame(bars + bars[:9], "k int, ticker string, date date").repartition(3)
    want = {}
    for k, ticker, start, end in spells:
        start, end = start or d("2000-11-11"), end or d("2004-05-01")
        low, high = start.year * 12 + start.month - 1, date.fromordinal(end.toordinal() - 1)
        for m in range(low, high.year * 12 + high.month if start < end else low):
            want.setdefault((k, date(m // 12, m % 12 + 1, 1)), set()).add(ticker)
    there = {(k, t, x.replace(day=1)) for k, t, x in bars if x and k}
    rows = M.members_by_month(s, b, ["k"], "2000-11-11", "2004-05-01").collect()
    got = {(r.k, r.month): (r.members, r.without_bars) for r in rows}
    assert len(got) == len(rows)
    assert got == {(k, m): (len(t), sum((k, x, m) not in there for x in t)) for (k, m), t in want.items()}


def test_months_of_members_are_not_joined(spark):
    from riskloom import queries

    plan = queries.QUERIES["b_members_by_month"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "month" in line] and "Expand" not in plan
