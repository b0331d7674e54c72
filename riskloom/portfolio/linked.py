"""Residual correlation between linked assets, and the variance it puts off a portfolio's diagonal.

The symmetric matrix is sparse: rows (i, j) with i < j for the pairs that exist, nothing for the others.
Moments of a pair come from either side's residuals, dealt as vectors to cells of two blocks of assets; a
portfolio's variance from joining pairs with either side's weight. No pair is made that isn't given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Residuals of a block of assets, which a task holds at 12 bytes each, and blocks at least.
BLOCK_ROWS, BLOCKS = 12_000_000, 3
#: Dates of a row of a vector at most; entries of a step, pairs packed at once and rows of a batch in a task.
_PIECE, _STEP, _PAIRS, _OUT = 512, 1 << 20, 1 << 20, 1 << 15


def pairs_of(groups: DataFrame, group: str, asset: str, most: int) -> DataFrame:
    """(i, j), i < j: assets that share one of ``groups`` (rows of group and asset) with at most ``most`` assets.

    A group of more assets says that all of them are alike and links none; the bound keeps a group's pairs few.
    """
    return shared_pairs(groups, group, asset, most).distinct()


def shared_pairs(groups: DataFrame, group: str, asset: str, most: int) -> DataFrame:
    """``pairs_of`` with a row a group that a pair shares. An unknown asset counts as one more in its group; rows without a group link nothing."""
    unknown = F.max(F.col(asset).isNull().cast("int"))
    sets = groups.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(asset)).alias("_all"), unknown.alias("_unknown")).where((F.size("_all") > 1) & (F.size("_all") + F.col("_unknown") <= most))
    return sets.select("_all", F.posexplode("_all").alias("_p", "i")).select("i", F.explode(F.expr("slice(_all, _p + 2, size(_all))")).alias("j"))


def decayed(residuals: DataFrame, date: str, half_life: float) -> DataFrame:
    """``residuals`` with ``g``, the weight of their date: halved every ``half_life`` dates back from the last one.

    Dates, not rows, are numbered, so the table of weights has a row a date; it goes to the residuals.
    """
    dates = residuals.select(date).distinct().withColumn("_back", F.row_number().over(Window.orderBy(F.desc(date))) - 1)
    return residuals.join(F.broadcast(dates.select(date, F.pow(F.lit(2.0), -F.col("_back") / float(half_life)).alias("g"))), date)


def _number(df: DataFrame, date: str) -> Column:
    """A date as a whole number."""
    kind = df.schema[date].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(date)
    return F.unix_micros(date) if isinstance(kind, T.TimestampType) else F.col(date).cast("long")


class _Block:
    """Vectors of a block's assets one after the other, in the order of the assets."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        ids, lengths = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        self.ids, self.lengths = ids[first], np.add.reduceat(lengths, first)
        self.starts = np.cumsum(self.lengths) - self.lengths
        days = np.concatenate([r[2] for r in rows])
        self.u = np.concatenate([r[3] for r in rows])
        self.low, self.span, self.known = int(days.min()), int(days.max()) - int(days.min()) + 1, None
        if self.span > 1 << 16:  # far apart: numbered anew
            self.known, days = np.unique(days, return_inverse=True)
            self.span = len(self.known)
        else:
            days -= days.dtype.type(self.low)
        self.days = days

    def at(self, days: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries whose date this block has, with its number."""
        if self.known is None:
            t = days.astype(np.int64) - self.low
            ok = (t >= 0) & (t < self.span)
        else:
            t = np.minimum(np.searchsorted(self.known, days), self.span - 1)
            ok = self.known[t] == days
        return t[ok], u[ok]

    def sums(self, days: np.ndarray, u: np.ndarray, others: np.ndarray) -> Iterator[tuple]:
        """(other, dates, products, own squares, other's squares) of one asset's vector with others of the block, over the dates of both."""
        others = np.unique(others)
        place = np.searchsorted(self.ids, others)
        ok = place < len(self.ids)
        ok[ok] = self.ids[place[ok]] == others[ok]
        place = place[ok]
        t, u = self.at(days, u)
        if not len(t) or not len(place):
            return
        n, x, xx = (np.bincount(t, w, self.span) for w in (None, u, u * u))
        lengths = self.lengths[place]
        for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(np.cumsum(lengths) // _STEP)) + 1):
            size, begin = lengths[part], self.starts[place[part]]
            entry = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            day = self.days[entry]
            both = np.flatnonzero(n[day])
            of, day, y = np.repeat(np.arange(len(part)), size)[both], day[both], self.u[entry[both]]
            total = lambda w: np.bincount(of, w, len(part))  # noqa: B023, E731
            met = total(n[day])
            there = met > 0
            yield tuple(c[there] for c in (self.ids[place[part]], met, total(x[day] * y), total(xx[day]), total(n[day] * y * y)))


def _packed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (cell, asset, others) of pairs (cell, asset, other), those of many batches together."""
    held: list[pa.RecordBatch] = []

    def rows() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by([("cell", "ascending"), ("asset", "ascending"), ("other", "ascending")])
        held.clear()
        cell, asset, other = (t.column(k).to_numpy() for k in range(3))
        new = np.append(True, (cell[1:] != cell[:-1]) | (asset[1:] != asset[:-1]))
        keep = np.flatnonzero(new | np.append(True, other[1:] != other[:-1]))
        first = np.flatnonzero(new[keep])
        others = pa.ListArray.from_arrays(pa.array(np.append(first, len(keep)), pa.int32()), pa.array(other[keep], schema.field(2).type.value_type))
        return pa.RecordBatch.from_arrays([pa.array(cell[keep][first], schema.field(0).type), pa.array(asset[keep][first], schema.field(1).type), others], schema=schema)

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= _PAIRS:
            yield rows()
    if held:
        yield rows()


def _cell_sums(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sums of each pair, from rows in the order of cell, side and asset: vectors of the right block, then each left asset's vector and its pairs."""
    cell, rows, block, left, out, ready = None, [], None, None, [], 0

    def done() -> None:
        nonlocal ready
        if block is None or left is None or not left[1] or not left[3]:
            return
        for other, days, c, own, its in block.sums(*(np.concatenate(x) for x in left[1:])):
            mine = np.full(len(other), left[0], other.dtype)
            turned = other < mine
            out.append([np.where(turned, other, mine), np.where(turned, mine, other), days.astype(np.int64), c, np.where(turned, its, own), np.where(turned, own, its)])
            ready += len(other)

    def batch() -> pa.RecordBatch:
        nonlocal ready
        columns = [pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
        out.clear()
        ready = 0
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for b in batches:
        cells, side, ids = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        change = (cells[1:] != cells[:-1]) | (side[1:] != side[:-1]) | (side[1:] > 0) & (ids[1:] != ids[:-1])
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            if cells[low] != cell:
                done()
                cell, rows, block, left = cells[low], [], None, None
            part = b.slice(low, high - low)
            days, u, others = part.column(3), part.column(4), part.column(5)
            if side[low] == 0:
                rows.append((ids[low:high], np.diff(days.offsets.to_numpy()), days.flatten().to_numpy(), u.flatten().to_numpy()))
                continue
            if rows:
                block, rows = _Block(rows), []
            if left is None or left[0] != ids[low]:
                done()
                left = (ids[low], [], [], [])
            if block is None:
                continue
            if others.null_count < len(others):
                left[3].append(others.flatten().to_numpy(zero_copy_only=False))
            if others.null_count:
                left[1].append(days.flatten().to_numpy())
                left[2].append(u.flatten().to_numpy())
            if ready >= _OUT:
                yield batch()
    done()
    if out:
        yield batch()


def pair_correlation(residuals: DataFrame, pairs: DataFrame, asset: str, date: str, e: str, weight: str, rows: int | None = None) -> DataFrame:
    """(i, j, days, value): weighted correlation about zero over the dates on which both are there; null where a side is zero.

    The weight is the date's and the same for all assets; repeated pairs count once. Assets are dealt to
    so many blocks that each has some ``BLOCK_ROWS`` of ``rows``, the number of residuals or more (counted
    where not given). A cell of two blocks gets its pairs and either block's vectors, in one shuffle; its
    task holds one block and reads the other, asset by asset. So each vector is shuffled once more than
    there are blocks, and no row is made for a pair and date.
    """
    n = max(BLOCKS, -(-(residuals.count() if rows is None else rows) // BLOCK_ROWS))
    kind = pairs.schema["i"].dataType
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast(kind)), F.lit(n)).cast("int")
    cell = lambda low, high: f"cast({low} + {high} * ({high} + 1) div 2 as int)"
    known = residuals.where(F.col(e).isNotNull() & F.col(weight).isNotNull() & F.col(date).isNotNull())
    entries = known.select(F.col(asset).cast(kind).alias("asset"), _number(residuals, date).alias("t"), (F.sqrt(weight) * F.col(e)).alias("u"))
    vectors = entries.groupBy("asset", F.floor(F.col("t") / _PIECE).alias("_piece")).agg(F.collect_list(F.struct("t", "u")).alias("v")).withColumn("b", block("asset"))
    # A null asset gets no cell; a filter would reach the scan and keep this from sharing the shuffles of other reads.
    sides = F.expr(f"CASE WHEN asset IS NOT NULL THEN concat(transform(sequence(0, b), k -> named_struct('cell', {cell('k', 'b')}, 'side', 0)), transform(sequence(b, {n - 1}), k -> named_struct('cell', {cell('b', 'k')}, 'side', 1))) END")
    dealt = vectors.withColumn("at", F.explode(sides)).select("at.cell", "at.side", "asset", F.col("v.t").alias("t"), F.col("v.u").alias("u"), F.lit(None).cast(T.ArrayType(kind)).alias("others"))
    p = pairs.where("i IS NOT NULL AND j IS NOT NULL").select("i", F.col("j").cast(kind).alias("j")).withColumn("bi", block("i")).withColumn("bj", block("j"))
    turned = F.col("bi") > F.col("bj")
    ends = p.select(F.expr(cell("least(bi, bj)", "greatest(bi, bj)")).alias("cell"), F.when(turned, F.col("j")).otherwise(F.col("i")).alias("asset"), F.when(turned, F.col("i")).otherwise(F.col("j")).alias("other"))
    row = lambda **c: T.StructType([T.StructField(k, v) for k, v in c.items()])
    lists, out = row(cell=T.IntegerType(), asset=kind, others=T.ArrayType(kind)), row(i=kind, j=kind, days=T.LongType(), c=T.DoubleType(), a=T.DoubleType(), b=T.DoubleType())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, to_arrow_schema(lists))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cell_sums(batches, to_arrow_schema(out))

    none = lambda name: F.lit(None).cast(dealt.schema[name].dataType).alias(name)
    both = dealt.unionByName(ends.mapInArrow(packed, lists).select("cell", F.lit(1).alias("side"), "asset", none("t"), none("u"), "others"))
    s = both.repartitionById(n * (n + 1) // 2, F.col("cell")).sortWithinPartitions("cell", "side", "asset").mapInArrow(sums, out)
    root = F.sqrt(F.col("a") * F.col("b"))
    return s.select("i", "j", "days", F.try_divide("c", F.when(root > 0, root)).alias("value"))


def linked_variance(books: DataFrame, deviations: DataFrame, correlations: DataFrame, portfolio: str, asset: str) -> DataFrame:
    """(portfolio, diagonal, linked, variance) of ``books`` (portfolio, asset, w) with specific deviations (asset, sd) and pairs (i, j, value).

    diagonal = sum w^2 sd^2; linked = 2 sum over pairs of w_i w_j sd_i sd_j value. A missing deviation counts as zero.
    """
    # Null-safe joins, since a filter on assets would reach the scan and keep a side from sharing its shuffle with other reads. A null asset has no deviation.
    mine = F.when(F.col(f"b.{asset}").isNotNull(), F.col("sd"))
    b = books.alias("b").join(deviations.select(asset, "sd").alias("d"), F.col(f"b.{asset}").eqNullSafe(F.col(f"d.{asset}")), "left").select(portfolio, f"b.{asset}", (F.col("w") * F.coalesce(mine, F.lit(0.0))).alias("s")).where("s <> 0")
    own = b.groupBy(portfolio).agg(F.sum(F.col("s") * F.col("s")).alias("diagonal"))
    left, right = b.select(portfolio, F.col(asset).alias("i"), F.col("s").alias("si")), b.select(portfolio, F.col(asset).alias("j"), F.col("s").alias("sj"))
    # Added up by (portfolio, j) before the other side's weight comes in, so that pairs aren't shuffled for each portfolio.
    known = correlations.where("value IS NOT NULL")
    half = left.alias("x").join(known.alias("p"), F.col("x.i").eqNullSafe(F.col("p.i"))).groupBy(portfolio, "j").agg(F.sum(F.expr("si * value")).alias("x"))
    off = half.alias("h").join(right.alias("y"), (F.col(f"h.{portfolio}") == F.col(f"y.{portfolio}")) & F.col("h.j").eqNullSafe(F.col("y.j"))).groupBy(f"h.{portfolio}").agg((2 * F.sum(F.expr("sj * x"))).alias("linked"))
    every = books.select(portfolio).distinct()
    d = every.join(own, portfolio, "left").join(off, portfolio, "left").select(portfolio, F.coalesce("diagonal", F.lit(0.0)).alias("diagonal"), F.coalesce("linked", F.lit(0.0)).alias("linked"))
    return d.withColumn("variance", F.col("diagonal") + F.col("linked"))
