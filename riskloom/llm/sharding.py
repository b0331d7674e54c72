"""Sharding by balanced label propagation, under a quota of rows.

Documents are linked to a hub for each text that several share (a star, never all pairs); a hub of
more documents than a shard may hold is cut into hubs of at most that many. All documents get a
first shard by a rank over hashed buckets, so shard sizes differ by one row at most. Each round counts
the documents of a hub by shard; documents outside their hub's favourite shard ask to move there.
For each ordered pair of shards the requests are met up to a quota: as many documents move back,
first those that ask to, then documents without links, which cost nothing. So every round keeps all
shard sizes and cuts fewer links. Ranks within a shard or a pair of shards are sums of counts over
buckets plus a rank within a small bucket, so that no task sorts a whole shard. What a round asks for
is stored before it is ranked, and quotas are looked up in small arrays, so that plans stay small.

Defined results: law ``rows`` (counts at most one apart); null text has no bytes and links to
nothing, an empty text links like any other; a null doc_id hashes like any value; repeated rows are
rows of their own; an empty table gives an empty one; extra columns are kept, and one that bears an
added name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import forget, stored, with_group

SHARDS = 16
ROUNDS = 3
BUCKET_ROWS = 2000
RUN = 1024


def ranked(df: DataFrame, group: list[str], order: list[str], within: list[str], buckets: int, name: str) -> DataFrame:
    """Rank from 0 within ``group`` by ``order`` (few values), then by hash bucket, then by ``within``.

    Only the counts by (group, order, bucket) are summed in order, in two levels: first within runs of
    ``RUN`` buckets, then over the runs. Rows are ranked within a bucket.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(*within, F.lit(17)), F.lit(buckets)).cast("int"))
    key = [*group, *order, "_b"]
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", F.expr(f"_b div {RUN}"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy(*group, *order, "_run").agg(F.sum("_n").alias("_n"))
    runs = runs.select(*group, *order, "_run", F.coalesce(F.sum("_n").over(up_to(Window.partitionBy(*group).orderBy(*order, "_run"))), F.lit(0)).alias("_far"))
    base = counts.select(*key, "_run", F.coalesce(F.sum("_n").over(up_to(Window.partitionBy(*group, *order, "_run").orderBy("_b"))), F.lit(0)).alias("_base"))
    base = base.join(runs, [*group, *order, "_run"]).select(*key, (F.col("_base") + F.col("_far")).alias("_base"))
    inner = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*within)) - 1)
    return inner.join(base, key).withColumn(name, (F.col("_base") + F.col("_r")).cast("long")).drop("_b", "_r", "_base")


def first_shards(rows: DataFrame, shards: int, buckets: int) -> DataFrame:
    """A shard for each row such that counts are at most one apart."""
    return ranked(rows, [], [], ["row_id"], buckets, "_rank").withColumn("shard", (F.col("_rank") % shards).cast("int")).drop("_rank")


def one_round(state: DataFrame, number: int, buckets: int, total: int) -> DataFrame:
    """``state``: row_id, hub (null: no link), shard, ...; the same with some rows moved."""
    held = state.where("hub IS NOT NULL").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    best = held.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")).alias("top"), F.sum("n").alias("_copies")).select("hub", F.col("top.shard").alias("best"), "_copies")
    # Rows without a hub stay out of the join, whose key would be null for all of them.
    linked = with_group(state.where("hub IS NOT NULL"), best, "hub", "_copies", total).withColumn("to", F.when(F.col("best") != F.col("shard"), F.col("best"))).drop("best", "_copies")
    asked = stored(linked.unionByName(state.where("hub IS NULL").withColumn("to", F.lit(None).cast("int"))), f"asked-{number}")
    want = asked.where("to IS NOT NULL").groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n"))
    free = asked.where("hub IS NULL").groupBy("shard").agg(F.count(F.lit(1)).alias("free"))
    # 16 x 16 counts: the quotas are settled in the driver.
    asks = {(r["shard"], r["to"]): r["n"] for r in want.collect()}
    spare = {r["shard"]: r["free"] for r in free.collect()}
    quota: list[tuple[int, int, int, int]] = []  # from, to, rows that asked, rows without links
    for i, j in sorted({tuple(sorted(p)) for p in asks}):
        a, b = asks.get((i, j), 0), asks.get((j, i), 0)
        both = min(a, b)
        extra_ij, extra_ji = min(a - both, spare.get(j, 0)), min(b - both, spare.get(i, 0))
        spare[j] = spare.get(j, 0) - extra_ij
        spare[i] = spare.get(i, 0) - extra_ji
        quota += [(i, j, both + extra_ij, extra_ji), (j, i, both + extra_ji, extra_ij)]
    if not quota:
        forget(asked)
        return state
    size = 1 + max(j for _, j, _, _ in quota)
    of_shard = lambda rows, kind, at="shard": F.get(F.array(*(F.array(*map(F.lit, r)).cast(f"array<{kind}>") for r in rows)), F.col(at))
    most = [[0] * size for _ in range(size)]
    # Rows without links fill the places: ranges of their rank in the shard lead to the other shards.
    ends, tos = [[] for _ in range(size)], [[] for _ in range(size)]
    for i, j, m, n in quota:
        most[i][j] = m
        if n:
            ends[i].append((ends[i] or [0])[-1] + n)
            tos[i].append(j)
    movers = ranked(asked.where("to IS NOT NULL"), ["shard", "to"], [], ["row_id"], buckets, "_rank")
    movers = movers.withColumn("shard", F.when(F.col("_rank") < F.get(of_shard(most, "bigint"), F.col("to")), F.col("to")).otherwise(F.col("shard"))).select(*state.columns)
    unlinked = asked.where("hub IS NULL")
    if any(ends):
        r = ranked(unlinked.drop("to"), ["shard"], [], ["row_id"], buckets, "_rank")
        passed = F.size(F.filter(of_shard(ends, "bigint"), lambda e: e <= F.col("_rank")))
        unlinked = r.withColumn("shard", F.coalesce(F.get(of_shard(tos, "int"), passed), F.col("shard")))
    stay = asked.where("hub IS NOT NULL AND to IS NULL")
    moved = stored(stay.select(*state.columns).unionByName(movers).unionByName(unlinked.select(*state.columns)), f"shards-{number}")
    forget(asked)
    return moved


def balanced_shards(docs: DataFrame, link: Column, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``docs`` (its columns, but for those named like an added one) with ``hub``, ``shard`` and ``slot``; rows of equal ``link`` belong together."""
    kept = [c for c in docs.columns if c.lower() not in ("hub", "shard", "slot")]
    names = {f"c{k}": c for k, c in enumerate(kept)}
    rows = stored(docs.select(*(F.col(f"`{c}`").alias(k) for k, c in names.items()), link.alias("_link"), F.monotonically_increasing_id().alias("row_id")), "rows")
    total = rows.count()
    buckets = max(8, total // BUCKET_ROWS)
    room = max(1, total // shards)
    shared = rows.where("_link IS NOT NULL").groupBy("_link").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    linked = with_group(rows, shared, "_link", "_copies", total)
    # A hub that outgrows a shard is cut by a hash of the row into parts that fit with room to spare.
    parts = F.ceil(F.col("_copies") * 1.25 / room)
    salt = F.when(F.col("_copies") > room, F.pmod(F.xxhash64("row_id", F.lit(23)), parts)).otherwise(F.lit(0))
    linked = stored(linked.withColumn("hub", F.when(F.col("_copies").isNotNull(), F.xxhash64("_link", salt))).drop("_copies", "_link"), "linked")
    state = stored(first_shards(linked, shards, buckets), "shards-0")
    forget(rows, linked)
    for k in range(1, rounds + 1):
        before, state = state, one_round(state, k, buckets, total)
        if before is not state:
            forget(before)
    out = ranked(state, ["shard"], [], ["row_id"], max(4, buckets // shards), "slot")
    return out.select(*(F.col(k).alias(c) for k, c in names.items()), "hub", "shard", "slot")


def cut_links(sharded: DataFrame) -> DataFrame:
    """One row: ``links`` (rows to their hubs) and ``cut``, those whose shard isn't the hub's favourite."""
    held = sharded.where("hub IS NOT NULL").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    by_hub = held.groupBy("hub").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return by_hub.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))


def op2_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards; equal texts are drawn together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.sha2(text, 256)).alias("text_key"))
    out = balanced_shards(sized, F.col("text_key"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("hub").isNotNull().alias("linked"))
