"""Exact n-gram Jaccard join: prefix filters under several global token orders, then verification.

A document's set holds its distinct five-word shingles. Two sets with Jaccard similarity 0.8 or more
share a token among the first n - ceil(0.8 n) + 1 of each, under *any* global order of the tokens.
The orders here put shingles that are frequent in the whole corpus last and differ by their hash
among the rest; what is frequent is a lossy count over all documents (each block of documents keeps
the shingles that two of its sets share). A wrong count changes the work, never the result.

1. Equal sets are one from here on: they carry one set id, and a sketch of fixed size (``SKETCH``):
   a bit for each class of tokens of the prefix under each order, and the parity of the number of
   tokens in each of 512 classes. Two sets differ by as many tokens at least as their parities.
2. Order 1 gives (token, set) rows; tokens that only one set has in its prefix drop out.
3. Each token's hub is the set whose prefix tokens are the most common ones, so that the hub of a
   group of near copies is the text in its middle. Sets are candidates against the hubs of their
   tokens (a star, not all pairs) if neither their unshared prefix tokens nor their parities rule a
   link out and their prefixes meet in the sketches of all orders; then by parities of a size that
   grows with the set, a sixteenth of its tokens' bytes. Only then tokens are fetched,
   the prefixes under every order intersected, and the pair verified. Components of the links
   found are made.
4. Of sets that share a hub but no component, the same bounds and filters, as the condition of one
   join, leave those that may link; these are verified in the same way.

No pair is formed within a component, copies are never expanded, and nothing is capped.

Defined results: null and empty texts have an empty set and link with nothing; fewer words than five
are one shingle; repeated rows and equal texts share a component; a null doc_id counts as the
smallest; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, forget, free_name, may_be_in, mix64, shingles, small_batches, stored, text_blocks, with_group, words
from .components import components

SIZE = 5
ORDERS = 3
HEAVY_FROM = 16
HEAVY_MOST = 1 << 17
COUNT_BYTES = 8 << 20
PART_PAIRS = 512
GIVEN_MOST = 200_000
NULL_ID = -(1 << 63)


def document_sets(block: Block, size: int = SIZE) -> list[np.ndarray]:
    w = words(block)
    values, bounds = shingles(w, w.hashes(), size)
    return [np.unique(values[bounds[i] : bounds[i + 1]]) for i in range(len(block))]


def set_id(s: np.ndarray) -> int:
    return int(mix64(mix64(s ^ np.uint64(0x51ED270B)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s))).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


PARITY_BITS, ORDER_BITS = 512, 256
SKETCH = [*(f"s{k}" for k in range(PARITY_BITS // 64)), *(f"p{i}_{k}" for i in range(ORDERS) for k in range(ORDER_BITS // 64))]


def sketch(s: np.ndarray, prefixes: list[np.ndarray]) -> np.ndarray:
    """The columns of ``SKETCH``: parities of token classes, then a bit for each class of prefix tokens by order."""
    parity = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    parts = [parity.astype(np.uint8)]
    for p in prefixes:
        bits = np.zeros(ORDER_BITS, np.uint8)
        bits[(p >> np.uint64(20) & np.uint64(ORDER_BITS - 1)).astype(np.int64)] = 1
        parts.append(bits)
    return np.packbits(np.concatenate(parts)).view(np.int64)


def parities(s: np.ndarray) -> bytes:
    """Parity of the number of tokens in each of some 2 to 4 classes a token, a power of two.

    Two sets differ by as many tokens at least as their parities; the halves of a longer one are
    added to compare it with a shorter one.
    """
    bits = 1 << max(PARITY_BITS.bit_length() - 1, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart_at_least(x: np.ndarray, y: np.ndarray) -> int:
    """Bytes of ``parities`` of two sets: a lower bound of their difference."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def may_link(a: str, b: str, n: Column) -> Column:
    """Whether sketches with the given name prefixes allow a link of sets of ``n`` tokens together."""
    word = lambda c: F.col(a + c).bitwiseXOR(F.col(b + c))
    apart = sum((F.bit_count(word(c)) for c in SKETCH[1 : PARITY_BITS // 64]), F.bit_count(word(SKETCH[0])))
    out = 9 * apart <= n
    for i in range(ORDERS):
        both = [F.col(a + c).bitwiseAND(F.col(b + c)) for c in SKETCH if c.startswith(f"p{i}_")]
        out = out & (reduce(lambda x, y: x.bitwiseOR(y), both) != 0)
    return out


class Orders:
    """Global token orders: frequent shingles last (by the logarithm of their count), then by hash."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray) -> None:
        at = np.argsort(heavy)
        self.heavy, self.level = heavy[at], np.log2(np.maximum(counts[at], 1)).astype(np.uint64)

    def levels(self, s: np.ndarray) -> np.ndarray | None:
        """0, or of frequent shingles 64 and more by their count."""
        if not len(self.heavy):
            return None
        at = np.minimum(np.searchsorted(self.heavy, s), len(self.heavy) - 1)
        return np.where(self.heavy[at] == s, self.level[at] + np.uint64(64), np.uint64(0))

    def prefix(self, s: np.ndarray, order: int, level: np.ndarray | None = None, sort: bool = True) -> np.ndarray:
        """The first tokens in the order, in that order if ``sort``; ``level`` as of ``levels``."""
        p = prefix_length(len(s))
        if p >= len(s) and not sort:
            return s
        key = mix64(s + np.uint64(order * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        level = self.levels(s) if level is None else level
        key = key >> np.uint64(2) if level is None else np.where(level > 0, level << np.uint64(56) | key >> np.uint64(8), key >> np.uint64(2))
        first = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
        return s[first[np.argsort(key[first])]] if sort else s[first]


def frequent_shingles(docs: DataFrame, size: int = SIZE) -> Orders:
    """Orders from a lossy count over all documents; at most HEAVY_MOST shingles come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size_now = 0

        def counted() -> pa.RecordBatch:
            h = np.sort(np.concatenate([*held.values(), np.zeros(0, np.uint64)]))
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
            n = np.diff(edge)
            twice = n >= 2
            return pa.RecordBatch.from_arrays([pa.array(h[edge[:-1][twice]].view(np.int64)), pa.array(n[twice], pa.int64())], ["token", "n"])

        for b in text_blocks(batches):
            for s in document_sets(b, size):
                if len(s):
                    held[set_id(s)] = s
            size_now += len(b.data)
            if size_now >= COUNT_BYTES:
                yield counted()
                held, size_now = {}, 0
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_FROM)
    top = counts.orderBy(F.desc("n"), "token").limit(HEAVY_MOST).toArrow()
    return Orders(top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy())


def shingle_sets(docs: DataFrame, orders: Orders, size: int = SIZE) -> DataFrame:
    """doc_id, row, n, set_id, and the prefix under order 1 and the sketch (null where a task gave that set before)."""
    shared = docs.sparkSession.sparkContext.broadcast(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = shared.value
        given: set[int] = set()
        for b in text_blocks(batches):
            n, ids, firsts, sketches, odd = [], [], [], [], []
            for s in document_sets(b, size):
                i = set_id(s) if len(s) else None
                n.append(len(s))
                ids.append(i)
                new = i is not None and i not in given
                if new:
                    level = o.levels(s)
                    first = o.prefix(s, 1, level)
                    sketches.append(sketch(s, [first, *(o.prefix(s, k, level, False) for k in range(2, ORDERS + 1))]))
                firsts.append(first.view(np.int64) if new else None)
                odd.append(parities(s) if new else None)
                if len(given) < GIVEN_MOST:
                    given.add(i)
            mask = np.array([x is None for x in firsts])
            table = np.zeros((len(SKETCH), len(n)), np.int64)
            if sketches:
                table[:, ~mask] = np.stack(sketches, axis=1)
            yield pa.RecordBatch.from_arrays([b.rows.column(0), b.rows.column(2), pa.array(n, pa.int32()), pa.array(ids, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(odd, pa.binary()), *(pa.array(x, mask=mask) for x in table)], ["doc_id", "row", "n", "set_id", "prefix", "parities", *SKETCH])

    return docs.select("doc_id", "text", "row").mapInArrow(run, "doc_id long, row long, n int, set_id long, prefix array<bigint>, parities binary, " + ", ".join(f"{c} long" for c in SKETCH))


def _known(sets: DataFrame, wanted: DataFrame, columns: list[str], label: str) -> DataFrame:
    """set_id and columns of the sets of ``wanted`` (one column, distinct), stored."""
    wanted = stored(wanted, f"{label}-wanted")
    known = may_be_in(sets.where("prefix IS NOT NULL").select("set_id", *columns), "set_id", wanted)
    known = known.join(wanted, "set_id").groupBy("set_id").agg(*(F.first(c).alias(c) for c in columns))
    known = stored(known, label)
    forget(wanted)
    return known


def _by_sketch(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The stored pairs (a, b) with n tokens together whose sketches allow a link; takes their place."""
    known = _known(sets, pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), SKETCH, "jaccard-sketches")
    side = lambda c: known.select(F.col("set_id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in SKETCH))
    out = stored(pairs.join(side("b"), "b").join(side("a"), "a").where(may_link("a_", "b_", F.col("n"))).select("a", "b", "n"), "jaccard-pairs")
    forget(known, pairs)
    return out


def _by_parities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The stored pairs (a, b) with n tokens together whose parities allow a link; takes their place."""
    known = _known(sets, pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), ["parities"], "jaccard-parities")
    side = lambda c: known.select(F.col("set_id").alias(c), F.col("parities").alias(f"x_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            x, y = batch.column(3), batch.column(4)
            near = [9 * apart_at_least(np.frombuffer(x[k].as_buffer(), np.uint8), np.frombuffer(y[k].as_buffer(), np.uint8)) <= n[k] for k in range(len(n))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    out = stored(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n", "x_a", "x_b").mapInArrow(run, "a long, b long"), "jaccard-likely")
    forget(known, pairs)
    return out


def _with_tokens(docs: DataFrame, sets: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(a, part, b, tokens): of each pair (a, b) the tokens of b, and, with b null, those of a.

    A set is read from one document that has it. Its tokens are made where that document's text is
    joined with its partners' ids, so they are shuffled once a pair and not once more before. A set
    with many partners has its pairs dealt into parts, each with the set's own tokens.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART_PAIRS).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    partners = dealt.groupBy("b").agg(F.collect_list(F.struct("a", "part")).alias("with")).select(F.col("b").alias("set_id"), "with")
    wanted = many.select(F.col("a").alias("set_id"), "parts").join(partners, "set_id", "full")
    one = sets.select("set_id", "row").join(wanted, "set_id").groupBy("set_id").agg(F.min("row").alias("row"), F.first("with").alias("with"), F.first("parts").alias("parts"))
    one = stored(one, "jaccard-fetch")
    # Rows that repeat an id and a text are read once.
    texts = may_be_in(docs.select("row", "text"), "row", one.select("row")).join(one, "row").dropDuplicates(["row", "set_id"]).select("text", "set_id", "with", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            rows = []
            for i, s in enumerate(document_sets(block, size)):
                asked = block.rows.column(1)[i].as_py()
                if not len(s) or set_id(s) != asked:  # another row of the same hash
                    continue
                raw = s.tobytes()
                rows += [(asked, part, None, raw) for part in range(block.rows.column(3)[i].as_py() or 0)]
                rows += [(w["a"], w["part"], asked, raw) for w in block.rows.column(2)[i].as_py() or ()]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["a", "part", "b", "tokens"])

    return texts.mapInArrow(run, "a long, part int, b long, tokens binary")


def _verify(rows: DataFrame, orders: Orders) -> DataFrame:
    """The pairs (a, b) of ``_with_tokens`` that link.

    A pair is a candidate if its prefixes meet under every order; only then it can link.
    """
    shared = rows.sparkSession.sparkContext.broadcast(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = shared.value
        first, sa, prefixes = None, None, []
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                a, b = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                s = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
                if b is None:
                    if a != first:
                        first, sa = a, s.copy()
                        prefixes = [o.prefix(sa, i, None, False) for i in range(1, ORDERS + 1)]
                    continue
                if a != first:
                    raise ValueError(f"the tokens of set {a} are missing")
                level = o.levels(s)
                if not all(len(np.intersect1d(x, o.prefix(s, i, level, False), assume_unique=True)) for i, x in enumerate(prefixes, 1)):
                    continue
                common = len(np.intersect1d(sa, s, assume_unique=True))
                if 100 * common >= 80 * (len(sa) + len(s) - common):
                    out.append((a, b))
            cols = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long").distinct()


def row_hash() -> Column:
    """Equal for rows of equal id and text."""
    return F.xxhash64("doc_id", "text")


def _classes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id (NULL_ID for null), row, n, and low: the least (doc_id, row) of the row's component (null without words)."""
    docs = small_batches(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text", row_hash().alias("row"))
    orders = frequent_shingles(docs, size)
    sets = stored(shingle_sets(docs, orders, size), "jaccard-docs")
    rows = sets.where("prefix IS NOT NULL").select("set_id", "n", F.posexplode("prefix").alias("pos", "token"))
    repeated = stored(rows.groupBy("token").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y").select("token"), "jaccard-tokens")
    meet = may_be_in(rows, "token", repeated, 24).join(repeated, "token").groupBy("set_id", "token").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    by_set = meet.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("hits"), F.first("n").alias("n"))
    by_set = stored(by_set, "jaccard-hits")
    prefix = F.col("n") - F.expr("(4L * n + 4) div 5") + 1
    meet = by_set.select("set_id", "n", prefix.alias("p"), F.posexplode("hits").alias("place", "hit"))
    meet = stored(meet.select("set_id", "n", "p", "hit.token", (F.col("hit.pos") - F.col("place")).alias("alone")), "jaccard-meet")
    # The set in the middle of its group has the most common tokens.
    common = meet.groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    middle = stored(meet.join(common, "token").groupBy("set_id").agg((F.sum("sets") / F.first("p")).alias("middle")), "jaccard-middle")
    hubs = meet.join(middle, "set_id").groupBy("token").agg(F.max(F.struct("middle", "set_id", "n")).alias("hub")).select("token", F.col("hub.set_id").alias("hub"), F.col("hub.n").alias("hub_n"))
    members = stored(meet.join(hubs, "token").groupBy("hub", "hub_n", "set_id", "n").agg(F.min("alone").alias("alone")), "jaccard-members")
    fits = lambda x, y: 5 * F.least(x, y) >= 4 * F.greatest(x, y)
    own_hub = members.where(F.col("hub") == F.col("set_id")).select("hub", F.col("alone").alias("hub_alone"))
    star = members.where(F.col("hub") != F.col("set_id")).where(fits(F.col("hub_n"), F.col("n"))).join(own_hub, "hub").where(9 * (F.col("alone") + F.col("hub_alone")) <= F.col("n") + F.col("hub_n"))
    star = stored(star.select(F.col("hub").alias("a"), F.col("set_id").alias("b"), (F.col("n") + F.col("hub_n")).alias("n")), "jaccard-hub-pairs")
    star = _by_parities(_by_sketch(star, sets), sets)
    tested = stored(_verify(_with_tokens(docs, sets, star, size), orders), "jaccard-star")
    near = stored(components(tested, "jaccard-cc"), "jaccard-near")

    m = members.where(F.col("hub") != F.col("set_id")).join(near.select(F.col("node").alias("set_id"), "comp"), "set_id", "left").join(near.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "hub", "left")
    m = stored(m.select("hub", "set_id", "n", "alone", F.coalesce("comp", "set_id").alias("comp"), F.coalesce("hub_comp", "hub").alias("hub_comp")), "jaccard-rest")
    # Hubs with a set that is apart from them and another set besides.
    open_ = m.groupBy("hub").agg(F.max((F.col("comp") != F.col("hub_comp")).cast("int")).alias("apart"), F.count(F.lit(1)).alias("sets")).where("apart = 1 AND sets > 1").select("hub")
    m = m.join(open_, "hub")
    known = _known(sets, m.select("set_id").distinct(), SKETCH, "jaccard-open-sketches")
    m = stored(m.join(known, "set_id"), "jaccard-open")
    side = lambda c: [F.col(x).alias(f"{c}_{x}") for x in ("set_id", "n", "alone", "comp", *SKETCH)]
    x = m.where(F.col("comp") != F.col("hub_comp")).select("hub", *side("x"))
    y = m.select(F.col("hub").alias("y_hub"), "hub_comp", *side("y"))
    total = F.col("x_n") + F.col("y_n")
    rest = x.join(
        y,
        (x["hub"] == y["y_hub"]) & (F.col("x_comp") != F.col("y_comp")) & ((F.col("y_comp") == F.col("hub_comp")) | (F.col("x_set_id") < F.col("y_set_id")))
        & fits(F.col("x_n"), F.col("y_n")) & (9 * (F.col("x_alone") + F.col("y_alone")) <= total) & may_link("x_", "y_", total),
    )
    rest = stored(rest.select(F.least("x_set_id", "y_set_id").alias("a"), F.greatest("x_set_id", "y_set_id").alias("b"), total.alias("n")).distinct(), "jaccard-pairs")
    rest = _by_parities(rest, sets)
    late = stored(_verify(_with_tokens(docs, sets, rest, size), orders), "jaccard-late")
    # The components of the first links are stars by now, so few steps are left; without a late link none.
    links = near.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(late)
    final = near if late.isEmpty() else stored(components(links, "jaccard-final"), "jaccard-comps")
    forget(repeated, by_set, meet, middle, members, star, tested, known, m, rest, late)

    own = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count(F.lit(1)).alias("copies"))
    own = own.join(final.select(F.col("node").alias("set_id"), "comp"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    own = stored(own, "jaccard-own")
    low = own.groupBy("comp").agg(F.min("least").alias("low"))
    own = stored(own.join(low, "comp").select("set_id", "copies", "low"), "jaccard-low")
    # Copies share a set, and a third of all rows may be copies of one text.
    return with_group(sets.select("doc_id", "row", "n", "set_id"), own, "set_id", "copies", sets.count()).drop("copies")


def jaccard_components(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of each row of ``docs``."""
    clear = lambda c: F.when(c != NULL_ID, c)
    out = _classes(docs, size)
    return out.select(clear(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), clear(F.coalesce("low.doc_id", "doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (a null one first), then
    of the smallest hash. Rows of equal id and text stay once; rows without words stay. All columns are kept."""
    row = free_name(docs, "row")
    stay = _classes(docs, size).where("low IS NULL OR low.row = row").select(F.col("row").alias(f"{row}_")).distinct()
    return docs.withColumn(row, row_hash()).join(stay, F.col(row) == F.col(f"{row}_")).dropDuplicates([row]).select(docs.columns)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
