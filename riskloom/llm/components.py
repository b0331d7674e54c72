"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import forget, stored


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp) for each node of an edge (a, b); comp is the smallest node of its component.

    Each step is a groupBy with partial sums and joins on the node, so a node with very many edges
    is combined on the map side and its join can be split. Both halves of a step are stored, so that
    plans stay small in the driver. An empty edge table gives no rows.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0")
    before, k = _state(e), 0
    while before[0]:
        k += 1
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{label}-{k}-large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-{k}-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, stored(small, f"{label}-{k}")
        forget(last, large, low)
        now = _state(e)
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
