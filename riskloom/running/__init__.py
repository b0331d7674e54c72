"""Running matrices: decayed sums of outer products at every row of a sequence of vectors, and what is made of them.

A key's rows are cut into chunks of consecutive rows. The sums of a chunk are made in parallel; they are
carried from chunk to chunk in one streamed pass that holds one matrix at a time; then every chunk
continues from its carry on its own. A decayed sum is multiplied by 2**(-1/h) at each row, so nothing
overflows, whatever the length. A function of the stacked sums turns them into rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 256


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "rn") -> DataFrame:
    """``df`` with its row number from 1 by keys; ``bucket`` doesn't fall along ``order``.

    Rows are ranked within a bucket and buckets' counts are summed, so no task sorts a whole key.
    """
    d = df.withColumn("_bucket", bucket)
    counts = d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    inner = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("d._bucket").eqNullSafe(F.col("b._b"))]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return inner.alias("d").join(base.alias("b"), on).select("d.*", (F.col("_base") + F.col("_r")).cast("long").alias(name)).drop("_bucket", "_r")


@dataclass
class Sums:
    """Of m rows of a chunk: S[k] (m x K x K) and w[k] for each pair of vectors, s (m x K) of the first vector, n rows so far.

    All are up to and including the row, or, where ``before``, up to the row before it.
    """

    x: np.ndarray
    n: np.ndarray
    w: list[np.ndarray]
    s: np.ndarray
    S: list[np.ndarray]


def _stack(col: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows (zero where there is none) and whether there is one."""
    there = col.notna().to_numpy()
    out = np.zeros((len(col), size))
    if there.any():
        out[there] = np.stack(col[there].to_list())
    return out, there


def _run(first: list[np.ndarray], parts: list[np.ndarray], keep: float) -> list[np.ndarray]:
    """Decayed running sums of each of ``parts`` (row by row) from a state."""
    out = []
    for at, p in zip(first, parts, strict=True):
        if keep == 1.0:
            out.append(at + np.cumsum(p, axis=0))
            continue
        r = np.empty_like(p)
        for t in range(len(p)):
            at = at * keep + p[t]
            r[t] = at
        out.append(r)
    return out


def running(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], half_life: float | str | None, f: Callable[[pd.DataFrame, Sums], pd.DataFrame], schema: str, before: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``f`` of each chunk's rows and running sums, as rows of ``schema``.

    ``df`` has the keys, ``rn`` from 1, and array columns; each of ``pairs`` names two of them (the first
    pair twice the vector itself), whose outer products are summed where both are there. ``half_life`` is a
    number of rows, a column of the keys that holds one, or None for equal weights. ``f`` sees the rows of
    one chunk in order; with ``before`` the sums leave the row itself out.
    """
    columns = sorted({c for p in pairs for c in p})
    d = df.withColumn("_chunk", F.expr(f"cast((rn - 1) div {chunk} as long)"))
    by = [*keys, "_chunk"]
    state = "weight array<double>, total array<double>, outer_sums array<array<double>>, row_count long"
    key_types = ", ".join(f"{f_.name} {f_.dataType.simpleString()}" for f_ in d.select(*by).schema.fields)

    def decay(g: pd.DataFrame) -> float:
        h = float(g[half_life].iloc[0]) if isinstance(half_life, str) else half_life
        return 1.0 if h is None or np.isinf(h) else 2.0 ** (-1.0 / h)

    def terms(g: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
        size = len(g[pairs[0][0]].iloc[0])
        v = {c: _stack(g[c], size) for c in columns}
        w, outer = [], []
        for a, b in pairs:
            there = v[a][1] & v[b][1]
            w.append(there.astype(float))
            outer.append(np.einsum("ti,tj->tij", v[a][0] * there[:, None], v[b][0]))
        return v[pairs[0][0]][0], w, v[pairs[0][0]][0], outer

    def chunk_sums(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn")
        _, w, s, outer = terms(g)
        g_ = decay(g) ** np.arange(len(g) - 1, -1, -1.0)
        row = {k: [g[k].iloc[0]] for k in by}
        row |= {"weight": [[float((g_ * x).sum()) for x in w]], "total": [(g_ @ s).tolist()], "outer_sums": [[np.tensordot(g_, o, 1).ravel().tolist() for o in outer]], "row_count": [len(g)]}
        return pd.DataFrame(row)

    sums = d.select(*by, "rn", *columns).groupBy(*by).applyInPandas(chunk_sums, f"{key_types}, {state}")

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted chunks of whole keys: what stands before each, one state held at a time."""
        key, held = None, None
        for g in batches:
            out = []
            for r in g.itertuples(index=False):
                r = r._asdict() if hasattr(r, "_asdict") else dict(zip(g.columns, r, strict=True))
                mine = tuple(None if r[k] != r[k] else r[k] for k in keys)
                w, s, big = np.array(r["weight"]), np.array(r["total"]), np.stack(r["outer_sums"])
                if mine != key or held is None:
                    key, held = mine, (np.zeros_like(w), np.zeros_like(s), np.zeros_like(big), 0)
                out.append({**{k: r[k] for k in keys}, "chunk_": r["chunk_"], "weight": held[0].tolist(), "total": held[1].tolist(), "outer_sums": [x.tolist() for x in held[2]], "row_count": held[3]})
                h = r.get(half_life) if isinstance(half_life, str) else half_life
                keep = 1.0 if h is None or np.isinf(h) else 2.0 ** (-float(r["row_count"]) / float(h))
                held = (held[0] * keep + w, held[1] * keep + s, held[2] * keep + big, held[3] + int(r["row_count"]))
            yield pd.DataFrame(out, columns=[*keys, "chunk_", "weight", "total", "outer_sums", "row_count"])

    renamed = sums.withColumnRenamed("_chunk", "chunk_")
    carries = renamed.repartition(*keys).sortWithinPartitions(*keys, "chunk_").mapInPandas(carried, f"{key_types.replace('_chunk', 'chunk_')}, {state}").withColumnRenamed("chunk_", "_chunk")

    def finish(g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame(columns=[x.split()[0] for x in schema.replace("<", " <").split(", ")])
        g = g.sort_values("rn").reset_index(drop=True)
        x, w, s, outer = terms(g)
        size, c = x.shape[1], c.iloc[0]
        first = [*np.array(c["weight"]), np.array(c["total"]), *(np.array(o).reshape(size, size) for o in c["outer_sums"])]
        keep = decay(g)
        got = _run(first, [*w, s, *outer], keep)
        n = int(c["row_count"]) + np.arange(1, len(g) + 1)
        if before:  # the decay between the last row and this one scales all sums alike
            got = [np.concatenate([np.asarray(a)[None], r[:-1]]) for a, r in zip(first, got, strict=True)]
            n = n - 1
        k = len(pairs)
        out = f(g, Sums(x, n, got[:k], got[k], got[k + 1 :]))
        return out if len(out) else out.astype(object)  # an empty column of arrays has no type of its own

    return d.groupBy(*by).cogroup(carries.groupBy(*by)).applyInPandas(finish, schema)


# What is made of the sums.


def means(q: Sums) -> np.ndarray:
    return q.s / np.maximum(q.w[0], 1e-300)[:, None]


def covariances(q: Sums, k: int = 0, demeaned: bool = False) -> np.ndarray:
    """Second moments about zero, or (equal weights) covariances with n - 1."""
    if not demeaned:
        return q.S[k] / np.maximum(q.w[k], 1e-300)[:, None, None]
    n = np.maximum(q.n, 2)[:, None, None]
    m = means(q)
    return (q.S[k] - n * np.einsum("ti,tj->tij", m, m)) / (n - 1)


def correlations(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of stacked covariances (NaN where a variance isn't positive) and standard deviations."""
    sd = np.sqrt(np.maximum(np.diagonal(c, axis1=1, axis2=2), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = c / (sd[:, :, None] * sd[:, None, :])
    r[:, np.arange(c.shape[1]), np.arange(c.shape[1])] = np.where(sd > 0, 1.0, np.nan)
    return r, sd


def seeded(v: np.ndarray) -> np.ndarray:
    """Stacked columns with the sign that makes their largest entry positive."""
    big = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None, :], axis=1)
    return v * np.where(big < 0, -1, 1)


def _lists(a: np.ndarray) -> list:
    return [None if np.isnan(x).any() else x.ravel().tolist() for x in a]


def condition_numbers(df: DataFrame, key: str, half_life: float, min_rows: int, chunk: int = CHUNK) -> DataFrame:
    """(key, rn, condition): largest over smallest eigenvalue of the decayed correlation of the rows up to each; null if it is singular.

    ``df`` has key, rn from 1 and v; rows before ``min_rows`` are left out.
    """

    def f(g: pd.DataFrame, q: Sums) -> pd.DataFrame:
        ok = q.n >= min_rows
        r, _ = correlations(covariances(q)[ok])
        good = ~np.isnan(r).any(axis=(1, 2))
        out = np.full(len(r), np.nan)
        e = np.linalg.eigvalsh(r[good])
        tiny = e[:, -1:] * r.shape[1] * np.finfo(float).eps if len(e) else e
        out[good] = np.where(e[:, 0] > tiny[:, 0], e[:, -1] / np.where(e[:, 0] > 0, e[:, 0], 1), np.nan) if len(e) else 0
        return pd.DataFrame({key: g.loc[ok, key], "rn": g.loc[ok, "rn"], "condition": [None if x != x else x for x in out]})

    return running(df, [key], [("v", "v")], half_life, f, f"{_type(df, key)}, rn long, condition double", chunk=chunk)


def _type(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def rate_factors(df: DataFrame, key: str, min_rows: int, level_target: float = 1.0, slope_target: float = 1.0, floor: float = 1e-8, chunk: int = CHUNK) -> DataFrame:
    """(key, rn, level, slope, level_share, slope_share, level_loading, slope_loading) of vectors of changes by tenor.

    The first two components of the expanding covariance up to each row, scaled so that the mean of the
    level's loadings, and the last less the first of the slope's, is the target; a factor's value is the
    row's projection over that scale, so the sign of an eigenvector doesn't matter. Null where the
    quantity that is scaled lies under ``floor``.
    """

    def f(g: pd.DataFrame, q: Sums) -> pd.DataFrame:
        ok = q.n >= max(min_rows, 2)
        c, x = covariances(q, demeaned=True)[ok], q.x[ok]
        e, v = np.linalg.eigh(c)
        size = c.shape[1]
        total = np.maximum(e.sum(axis=1), 1e-300)
        out = {key: g.loc[ok, key].to_numpy(), "rn": g.loc[ok, "rn"].to_numpy()}
        equal, spread = np.full(size, 1 / size), np.zeros(size)
        spread[0], spread[-1] = -1.0, 1.0
        cols = {}
        for name, rank, weights, target in (("level", 1, equal, level_target), ("slope", 2, spread, slope_target)):
            u = v[:, :, -rank] if size >= rank else np.full((len(c), size), np.nan)
            at = u @ weights
            usable = np.abs(at) >= floor
            scale = np.where(usable, target / np.where(usable, at, 1), np.nan)
            cols[name] = (np.einsum("ti,ti->t", u, x) / scale, e[:, -rank] / total if size >= rank else np.full(len(c), np.nan), u * scale[:, None])
        for j, kind in enumerate(("", "_share")):
            for name in cols:
                out[name + kind] = [None if z != z else z for z in cols[name][j].tolist()]
        for name in cols:
            out[f"{name}_loading"] = _lists(cols[name][2])
        return pd.DataFrame(out)

    return running(df, [key], [("v", "v")], None, f, f"{_type(df, key)}, rn long, level double, slope double, level_share double, slope_share double, level_loading array<double>, slope_loading array<double>", chunk=chunk)


def principal_components(df: DataFrame, key: str, min_rows: int, components: int, edge: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(key, rn, survivors, eigenvalues, loadings, sd, raw): components of the expanding correlation up to each row.

    ``loadings`` holds the first ``components`` eigenvectors one behind the other, with their largest
    entry positive; ``raw`` the row's projections on loading / sd. ``survivors`` counts the eigenvalues
    over the noise edge (1 + sqrt(K / n))^2 (all components if not ``edge``). Rows with a constant
    column so far are left out. ``oriented`` gives the signs that follow the row before.
    """

    def f(g: pd.DataFrame, q: Sums) -> pd.DataFrame:
        ok = np.flatnonzero(q.n >= max(min_rows, 2))
        r, sd = correlations(covariances(q, demeaned=True)[ok])
        good = ~np.isnan(r).any(axis=(1, 2))
        ok, r, sd = ok[good], r[good], sd[good]
        e, v = np.linalg.eigh(r)
        e, v = e[:, ::-1], seeded(v[:, :, ::-1][:, :, :components])
        bound = (1 + np.sqrt(r.shape[1] / q.n[ok])) ** 2
        survivors = np.minimum((e > bound[:, None]).sum(axis=1), v.shape[2]) if edge else np.full(len(ok), v.shape[2])
        raw = np.einsum("ti,tik->tk", q.x[ok] / sd, v)
        return pd.DataFrame({key: g[key].to_numpy()[ok], "rn": g["rn"].to_numpy()[ok], "survivors": survivors, "eigenvalues": _lists(e), "loadings": _lists(v.transpose(0, 2, 1)), "sd": _lists(sd), "raw": _lists(raw)})

    return running(df, [key], [("v", "v")], None, f, f"{_type(df, key)}, rn long, survivors int, eigenvalues array<double>, loadings array<double>, sd array<double>, raw array<double>", chunk=chunk)


def oriented(components: DataFrame, key: str, count: int) -> DataFrame:
    """``components`` with ``sign`` (by component), ``factors`` and ``alignment``: each loading points like that of the row before.

    The sign is the parity of the disagreements so far, a running sum, so one pass over the sequence
    carries it. ``alignment`` is the least |product| with the row before over the surviving components.
    """
    w = Window.partitionBy(key).orderBy("rn")
    size = F.expr(f"cast(size(loadings) / {count} as int)")
    d = components.withColumn("_before", F.lag("loadings").over(w)).withColumn("_size", size)
    dot = lambda k: F.expr(f"aggregate(zip_with(slice(loadings, {k} * _size + 1, _size), slice(_before, {k} * _size + 1, _size), (a, b) -> a * b), 0D, (s, z) -> s + z)")
    d = d.withColumns({f"_d{k}": F.when(F.col("_before").isNotNull(), dot(k)) for k in range(count)})
    parity = lambda k: F.sum(F.when(F.col(f"_d{k}") < 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2
    sign = F.array(*(F.when(parity(k) == 1, -1.0).otherwise(1.0) for k in range(count)))
    d = d.withColumn("sign", sign).withColumn("factors", F.zip_with("raw", "sign", lambda a, b: a * b))
    known = F.array(*(F.when(F.lit(k) < F.col("survivors"), F.abs(F.col(f"_d{k}"))) for k in range(count)))
    return d.withColumn("alignment", F.coalesce(F.array_min(F.filter(known, lambda z: z.isNotNull())), F.lit(1.0))).drop("_before", "_size", *(f"_d{k}" for k in range(count)))


def repaired(c: np.ndarray, floor: float = 1e-14) -> np.ndarray:
    """Stacked matrices with eigenvalues that aren't positive raised to ``floor``; untouched where there are none."""
    e, v = np.linalg.eigh((c + c.transpose(0, 2, 1)) / 2)
    fixed = np.einsum("tik,tk,tjk->tij", v, np.where(e > 0, e, floor), v)
    return np.where((e[:, 0] > 0)[:, None, None], c, fixed)


def forecast_history(df: DataFrame, key: str, half_lives: list[float], lags: int = 2, min_rows: int = 2, multiplier: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """(key, half_life, rn, observations, forecast, bias): the covariance job of ``risk`` at every row, from the rows before it.

    ``df`` has key, rn from 1 and v. Decayed second moments with Bartlett-weighted lagged ones, repaired and
    scaled; ``forecast`` holds the standard deviations and ``bias`` the root mean square of the row over them.
    The half-life is a part of the key, so all of them are one plan.
    """
    w = Window.partitionBy(key).orderBy("rn")
    d = df.select(key, "rn", "v", *(F.lag("v", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    d = d.withColumn("half_life", F.explode(F.array(*(F.lit(float(h)) for h in half_lives))))

    def f(g: pd.DataFrame, q: Sums) -> pd.DataFrame:
        ok = q.n >= min_rows
        c = covariances(q)[ok]
        for k in range(1, lags + 1):
            lagged = (q.S[k] / np.where(q.w[k] > 0, q.w[k], 1)[:, None, None])[ok]
            c = c + (1 - k / (lags + 1)) * (lagged + lagged.transpose(0, 2, 1))
        sd = np.sqrt(np.maximum(np.diagonal(repaired(c), axis1=1, axis2=2), 0)) * multiplier
        with np.errstate(divide="ignore", invalid="ignore"):
            bias = np.sqrt(np.mean((q.x[ok] / sd) ** 2, axis=1))
        return pd.DataFrame({key: g.loc[ok, key], "half_life": g.loc[ok, "half_life"], "rn": g.loc[ok, "rn"], "observations": q.n[ok], "forecast": _lists(sd), "bias": [z if np.isfinite(z) else None for z in bias]})

    pairs = [("v", "v"), *(("v", f"l{k}") for k in range(1, lags + 1))]
    return running(d, [key, "half_life"], pairs, "half_life", f, f"{_type(df, key)}, half_life double, rn long, observations long, forecast array<double>, bias double", before=True, chunk=chunk)
