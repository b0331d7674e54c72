"""Queries over the panel of nine raw descriptors and the six exposures."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import MARKET, market, query, returns, rnd
from .panel import descriptors as D

_BOUND = 3.0
_RESVOL, _LIQUID = {"dastd": 0.74, "cmra": 0.16, "hsigma": 0.10}, {"stom": 0.35, "stoq": 0.35, "stoa": 0.30}
_G = "pow(2.0, k / 21.0)"
_AV = lambda e, w: f"(sum({_G} * {e}) OVER {w} / sum({_G}) OVER {w})"
_RAW = (
    MARKET
    + f""", x0 AS (SELECT rets.asset, rets.date, r, m, volume / trades AS turn, lag_cap AS cap, row_number() OVER (PARTITION BY rets.asset ORDER BY rets.date) AS k FROM rets JOIN mkt ON mkt.date = rets.date WHERE r IS NOT NULL AND m IS NOT NULL),
x1 AS (SELECT asset, date, cap, ln(CASE WHEN cap > 0 THEN cap END) AS lncap, count(*) OVER w60 AS n60, {_AV('r', 'w60')} AS my, {_AV('m', 'w60')} AS mx, {_AV('m * m', 'w60')} AS mxx, {_AV('r * m', 'w60')} AS mxy, {_AV('r * r', 'w60')} AS myy,
 CASE WHEN count(*) OVER w42 = 42 THEN sqrt(greatest({_AV('r * r', 'w42')} - pow({_AV('r', 'w42')}, 2), 0)) END AS dastd, CASE WHEN count(*) OVER w40 = 40 THEN {_AV('r', 'w40')} END AS s, sum(r) OVER (PARTITION BY asset ORDER BY k) AS c,
 CASE WHEN count(*) OVER w5 = 5 THEN ln(avg(turn) OVER w5) END AS stom, CASE WHEN count(*) OVER w15 = 15 THEN ln(avg(turn) OVER w15) END AS stoq, CASE WHEN n60x = 60 THEN ln(avg(turn) OVER w60) END AS stoa FROM (SELECT *, count(*) OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS n60x FROM x0)
 WINDOW """
    + ", ".join(f"w{n} AS (PARTITION BY asset ORDER BY k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 15, 40, 42, 60))
    + """),
x2 AS (SELECT *, CASE WHEN n60 = 60 THEN (mxy - mx * my) / nullif(mxx - mx * mx, 0) END AS beta, lag(s, 5) OVER w AS rstr, """
    + ", ".join(f"c - lag(c, {10 * t}) OVER w AS t{t}" for t in range(1, 5))
    + """ FROM x1 WINDOW w AS (PARTITION BY asset ORDER BY date)),
raw AS (SELECT asset, date, cap, beta, CASE WHEN beta IS NOT NULL THEN sqrt(greatest(myy - my * my - beta * (mxy - mx * my), 0)) END AS hsigma, dastd, rstr, CASE WHEN t4 IS NOT NULL THEN greatest(t1, t2, t3, t4) - least(t1, t2, t3, t4) END AS cmra, stom, stoq, stoa, lncap FROM x2)"""
)


def _win(src: str, dst: str, cols: list[str], keep: str) -> str:
    clip = ", ".join(f"CASE WHEN {c} IS NOT NULL AND stddev_samp({c}) OVER d > 0 THEN greatest(least({c}, avg({c}) OVER d + {_BOUND} * stddev_samp({c}) OVER d), avg({c}) OVER d - {_BOUND} * stddev_samp({c}) OVER d) ELSE {c} END AS {c}" for c in cols)
    return f"{dst} AS (SELECT asset, date, cap{keep}, {clip} FROM {src} WINDOW d AS (PARTITION BY date))"


def _std(src: str, dst: str, cols: list[str], keep: str) -> str:
    one = ", ".join(f"({c} - sum({c} * cap) OVER d / sum(CASE WHEN {c} IS NOT NULL THEN cap END) OVER d) / CASE WHEN stddev_samp({c}) OVER d > 0 THEN stddev_samp({c}) OVER d END AS {c}" for c in cols)
    return f"{dst} AS (SELECT asset, date, cap{keep}, {one} FROM {src} WINDOW d AS (PARTITION BY date))"


def _orth(src: str, dst: str, pairs: list[tuple[str, str, str]], keep: str) -> str:
    parts = []
    for y, x, name in pairs:
        g = f"CASE WHEN {y} IS NOT NULL AND {x} IS NOT NULL THEN sqrt(cap) END"
        av = lambda e, g=g: f"(sum({g} * {e}) OVER d / sum({g}) OVER d)"
        v = f"({av(f'{x} * {x}')} - {av(x)} * {av(x)})"
        parts.append(f"{y} - {av(y)} - coalesce(({av(f'{x} * {y}')} - {av(x)} * {av(y)}) / CASE WHEN {v} > 1e-15 THEN {v} END, 0) * ({x} - {av(x)}) AS {name}")
    return f"{dst} AS (SELECT asset, date, cap{keep}, {', '.join(parts)} FROM {src} WINDOW d AS (PARTITION BY date))"


_mix = lambda w: " + ".join(f"{c} * {k}" for c, k in w.items())
_EXP = ", ".join([
    _RAW, _win("(SELECT * FROM raw WHERE cap > 0)", "q1", D.RAW, ""), _std("q1", "q2", D.RAW, ""),
    f"q3 AS (SELECT *, {_mix(_RESVOL)} AS vol, {_mix(_LIQUID)} AS liq FROM q2)", _std("q3", "q4", ["vol", "liq"], ", beta, rstr, lncap"),
    "q5 AS (SELECT *, CASE WHEN count(lncap) OVER d >= 5 THEN pow(lncap, 3) END AS cube, CASE WHEN full_ THEN vol END AS y, CASE WHEN full_ THEN beta END AS b, CASE WHEN full_ THEN lncap END AS x FROM (SELECT *, vol IS NOT NULL AND beta IS NOT NULL AND lncap IS NOT NULL AND count(vol + beta + lncap) OVER d >= 5 AS full_ FROM q4 WINDOW d AS (PARTITION BY date)) WINDOW d AS (PARTITION BY date))",
    _orth("q5", "q6", [("cube", "lncap", "nl"), ("y", "x", "y1"), ("b", "x", "b1")], ", beta, rstr, lncap, liq"), _orth("q6", "q7", [("y1", "b1", "rv")], ", beta, rstr, lncap, liq, nl"),
    _win("q7", "q8", ["nl"], ", beta, rstr, lncap, liq, rv"), _std("q8", "q9", ["nl", "rv"], ", beta, rstr, lncap, liq"),
])


def _raw(spark, d):
    r = returns(spark, d)
    x = r.join(market(r).select("date", "m"), "date").where("r IS NOT NULL AND m IS NOT NULL").select("asset", "date", "r", "m", "volume", F.col("trades").alias("shares"), F.col("lag_cap").alias("cap"))
    return D.raw_descriptors(x, 60, 42, 40, 21.0, 5, 4, 10, (5, 15, 60))


@query("x_raw_descriptors", f"WITH {_RAW} SELECT asset, date, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in D.RAW) + " FROM raw")
def raw_descriptors(spark, d):
    """All nine raw descriptors of every supplier and session."""
    return _raw(spark, d).select("asset", "date", *(rnd(c, 4).alias(c) for c in D.RAW))


@query("x_exposures", f"WITH {_EXP} SELECT asset, date, round(beta, 3) + 0.0 AS BETA, round(rstr, 3) + 0.0 AS MOMENTUM, round(lncap, 3) + 0.0 AS SIZE, round(nl, 3) + 0.0 AS NLSIZE, round(rv, 3) + 0.0 AS RESVOL, round(liq, 3) + 0.0 AS LIQUIDITY FROM q9")
def exposures(spark, d):
    """The six exposures of every supplier and session."""
    return D.exposures(_raw(spark, d), _BOUND, _RESVOL, _LIQUID).select("asset", "date", *(rnd(c, 3).alias(c) for c in D.FACTORS))
