"""Parsers against small literal inputs, and the joins of the risk module."""

from __future__ import annotations

import json
import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from riskloom import risk, sources


def test_observations_keep_the_sentinel(spark):
    body = json.dumps({"observations": [{"date": "2020-01-01", "value": ".", "realtime_start": "2020-02-01", "realtime_end": "9999-12-31"}, {"date": "2020-01-02", "value": " 1.5 ", "realtime_start": "2020-02-01", "realtime_end": "2020-03-01"}]})
    rows = sources.parse_observations(spark.createDataFrame([("x", body)], "id string, body string")).orderBy("date").collect()
    assert [(r.value, r.realtime_end) for r in rows] == [(None, "9999-12-31"), (1.5, "2020-03-01")]


def test_index_lines_skip_preamble(spark):
    lines = ["Description: index", "CIK|Company Name|Form|Date|File", "-----", "90210|HILLTOP WIDGETS|Q-9|2031-07-08|files/90210/0000777777-31-000042.txt", "90211|TORN"]
    rows = sources.parse_index_line(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.cik, r.filed, r.accn) for r in rows] == [(90210, date(2031, 7, 8), "0000777777-31-000042")]
    bad = sources.parse_index_line(spark.createDataFrame([(x,) for x in lines], "line string"), rejects=True).collect()
    assert [r.line for r in bad] == ["90211|TORN"]


def test_code_ranges_carry_their_header(spark):
    lines = [" 1 Kites  Kite making", "          0310-0319 Silk kites", "          0320-0349 Paper kites", " 2 Bells  Bell foundries", "          4100-4107 Small bells", "          41x0-4107 torn"]
    rows = sources.parse_code_ranges(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, line string"), "file", "n", "line").collect()
    assert sorted((r.group, r.label, r.low, r.high) for r in rows) == [(1, "Kites", 310, 319), (1, "Kites", 320, 349), (2, "Bells", 4100, 4107)]
    bad = sources.parse_code_ranges(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, line string"), "file", "n", "line", rejects=True).collect()
    assert [r.line.strip() for r in bad] == ["41x0-4107 torn"]
    series = spark.createDataFrame([(x,) for x in ("day,v", "2031-01-02,.", "2031-01-03,4.5", "2031-01-04,4,5x", "junk")], "line string")
    assert [r.value for r in sources.parse_series_csv(series).collect()] == [4.5, 4.0] and [r.line for r in sources.parse_series_csv(series, rejects=True).collect()] == ["day,v", "junk"]


def test_first_filing(spark):
    body = json.dumps({"accessionNumber": ["b", "a", "c"], "form": ["10-K", "10-K", "8-K"], "filingDate": ["2020-03-01", "2020-03-01", "2019-01-01"], "reportDate": ["", "2019-12-31", ""]})
    f = sources.parse_submissions(spark.createDataFrame([(1, body)], "cik int, body string"))
    assert f.where("report_date IS NULL").count() == 2
    r = sources.first_filing(f, "cik", ["10-K"], "2020-01-01").first()
    assert (r.filing_date, r.accession) == (date(2020, 3, 1), "a")


def test_svensson_limits(spark):
    row = spark.range(1).select(*(sources.svensson(F.lit(float(n)), [F.lit(3.0), F.lit(-1.0), F.lit(0.0), F.lit(9.0)], [F.lit(2.0), F.lit(t2)]).alias(f"y{k}") for k, (n, t2) in enumerate([(0, -1.0), (1000, -1.0), (2, -1.0)]))).first()
    assert row.y0 == pytest.approx(2.0) and row.y1 == pytest.approx(3.0, abs=1e-2) and row.y2 == pytest.approx(3 - (1 - math.exp(-1)))


def test_reading_past_the_boundary_needs_a_reason(spark):
    with pytest.raises(ValueError):
        sources.read_full(spark, "/nowhere", " ")


def test_half_splits(spark):
    df = spark.createDataFrame([(t, b, float(t + b % 2 + 0.1 * k)) for t in (1, 2) for b in range(4) for k in range(3)], "trial int, block int, r double")
    s = risk.half_splits(df, "trial", blocks=4)
    assert s.count() == 12
    best = risk.overfitting(s, "trial").collect()
    assert len(best) == 6 and all(0 < r.share < 1 for r in best)


def test_sinks_and_their_readers(spark, tmp_path):
    from datetime import date

    import pytest

    from riskloom import sources as S

    at = lambda n: f"{tmp_path}/{n}"
    df = spark.createDataFrame([(date(2020, 1, k), "a" if k % 2 else "b", k) for k in range(1, 7)], "date date, asset string, state int")
    assert S.write_if_changed(df, at("t")) and not S.write_if_changed(df.orderBy("state"), at("t")) and S.write_if_changed(df.limit(3), at("t"))
    assert S.read_table(spark, at("t"), "2020-01-03").count() == 2 and S.read_full(spark, at("t"), "audit").count() == 3
    with pytest.raises(ValueError):
        S.read_full(spark, at("t"), " ")
    S.write_pull(df, at("pulls"), "2024-01-01")
    S.write_pull(df.limit(2), at("pulls"), "2024-01-02")
    S.write_pull(df.limit(1), at("pulls"), "2024-01-02")
    assert {(str(r.pull_date), r["count"]) for r in spark.read.parquet(at("pulls")).groupBy("pull_date").count().collect()} == {("2024-01-01", 6), ("2024-01-02", 1)}
    S.write_derived(df, at("derived"), at("manifest"), ["x", "y"])
    assert {(r.input, r.rows) for r in spark.read.parquet(at("manifest")).collect()} == {("x", 6), ("y", 6)}
    S.write_reference(df, at("ref"), {"source": "made up"})
    assert spark.read.option("header", True).csv(at("ref")).count() == 6 and spark.read.json(at("ref") + ".provenance").first().value == "made up"
    S.write_membership(df, at("wide"), "date", "asset", "state")
    back = S.read_membership(spark, at("wide"), "2020-01-05")
    assert sorted((r.date.day, r.asset, r.state) for r in back.collect()) == [(k, "a" if k % 2 else "b", k) for k in range(1, 5)]
    for v in ("p", "q"):
        S.write_partial(df.select("date", "state"), at("parts"), v, "d")
    assert S.assemble(spark, at("parts"), "date", "state", ["q", "p"]).columns == ["date", "q", "p"]
    with pytest.raises(ValueError):
        S.assemble(spark, at("parts"), "date", "state", ["p", "r"])
    S.write_metrics(df.limit(1), at("metrics"), "one")
    S.write_metrics(df.limit(2), at("metrics"), "two")
    assert {(r.section, r["count"]) for r in spark.read.json(at("metrics")).groupBy("section").count().collect()} == {("one", 1), ("two", 2)}
    (tmp_path / "spells.csv").write_text("# from nowhere\nticker,start,end,start_known,security\nXY,2001-02-03,,true,Some Name\n")
    r = S.read_spells_csv(spark, at("spells.csv")).first()
    assert (r.ticker, str(r.start), r.end, r.start_known) == ("XY", "2001-02-03", None, True)


def test_entry_is_readable_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"], cwd=root, capture_output=True, text=True, check=False)
    assert said.returncode == 0 and int(said.stdout.split()[-1]) > 200, said.stderr
