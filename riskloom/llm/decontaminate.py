"""Benchmark decontamination with DataFrame functions only: SimHash windows of the items' sizes.

1. Document places whose shingle is a shingle of any item are gathered by row. A window of a given
   item size can reach a similarity of 0.8 only if it holds enough such places (windows of the
   shingle counts a and b share 4 (a + b) / 9 at least), in any order. All such windows of every
   item size are taken, each beginning at such a place: a window that doesn't can be moved on
   without losing a shared shingle. Nothing here depends on which item a shingle is from.
2. Each window and each item gets a 64-bit SimHash (bits by majority over its weighted five-word
   shingles; a shingle weighs as often as it occurs). Sums of bits are packed several to a number.
3. Multi-index Hamming search: fingerprints are cut into 4 blocks of 16 bits; of two that differ in
   at most RADIUS = 19 bits, one block differs in at most 4. Every item's blocks are therefore filed
   under all values within 4 bits; distinct fingerprints of windows look up their own four blocks.
   The item isn't part of the key. All pairs within the radius are found.
4. Of these, windows of the item's own size are verified by the exact weighted Jaccard similarity.

A similarity of 0.8 lies 10 bits apart on average, with a deviation of 3: ``tests/llm`` measures the
share of windows of similarity 0.80 to 0.85 within the radius by item length, repeated shingles
included, and holds it to 0.98 at least. The shingles of the items are joined without a hint: Spark
broadcasts them if they are under its size threshold.

Defined results: null and empty texts or items have no hits; items or documents of fewer than five
words are one shingle, which is its own fingerprint; a document shorter than an item is one window;
repeated document rows count once, repeated item rows have equal hits; rows are told apart by id and
text, so a null id, and an id with several texts, are like any other; an empty table gives no hits.
Extra columns are ignored by ``contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import forget, free_name, may_be_in, stored

SIZE = 5
RADIUS = 19
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
NEAR = RADIUS // BLOCKS
REGION = 256
SPACES = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Lower-cased words; without any, an array of one empty string."""
    return F.split(F.btrim(F.lower(text), F.lit(SPACES)), "[ \\t\\n\\x0B\\f\\r]+")


def shingles_of(words: Column) -> Column:
    """Hashes of all five-word shingles, repeats included."""
    last = F.greatest(F.size(words) - SIZE, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, F.lit(SIZE)))))


def numbered(hashes: Column) -> Column:
    """Each hash with its number among equal ones: a set whose Jaccard index is the weighted one."""
    return F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i - F.array_position(hashes, h)).alias("k")))


def lane_bits(most: int) -> int:
    """Width of the lanes in which bits of up to ``most`` shingles are counted."""
    return next(w for w in (8, 16, 32) if most < 1 << (w - 1))


def _ones(width: int) -> int:
    return sum(1 << k for k in range(0, 64, width))


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def lane(h: Column, k: int, width: int) -> Column:
    """Bits k, k + width, ... of a hash, each in a lane of its own."""
    return F.shiftrightunsigned(h, k).bitwiseAND(_signed(_ones(width)))


def majority(total: Callable[[int], Column], n: Column, width: int) -> Column:
    """The fingerprint from the sums of the lanes: bit b is set if more than half of the ``n`` hashes have it."""
    top = 64 - width  # the topmost lane is handled alone, which keeps all sums in a signed number
    ones, below, high = _ones(width), (1 << top) - 1, 1 << (width - 1)
    lift = high - F.floor(n / 2) - 1

    def part(k: int) -> Column:
        def bits(t: Column) -> Column:
            lanes = (t.bitwiseAND(F.lit(below)) + lift * F.lit(ones & below)).bitwiseAND(F.lit((ones & below) << (width - 1)))
            last = F.shiftleft(F.shiftrightunsigned((F.shiftrightunsigned(t, top) + lift).bitwiseAND(F.lit(high)), width - 1), top + k)
            return F.shiftrightunsigned(lanes, width - 1 - k).bitwiseOR(last)

        return F.get(F.transform(F.array(total(k)), bits), 0)

    return reduce(lambda x, y: x.bitwiseOR(y), map(part, range(width)))


def simhash(hashes: Column, n: Column, width: int) -> Column:
    """Fingerprint of ``n`` hashes; ``width`` sums count 64 / width bits each."""
    return majority(lambda k: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + lane(h, k, width)), n, width)


def running(hashes: Column, width: int) -> Column:
    """Running sums of the lanes, from 0, as a struct of arrays; of at most a REGION and a window, for which appending is cheap."""

    def sums(k: int) -> Column:
        # Sums of a region may leave the lanes and the signed range; their differences don't, in two's complement.
        step = lambda a, h: F.concat(a, F.array(_wrapped(F.element_at(a, -1), lane(h, k, width))))
        return F.aggregate(hashes, F.array(F.lit(0).cast("long")), step)

    return F.struct(*(sums(k).alias(f"p{k}") for k in range(width)))


def _wrapped(a: Column, b: Column, minus: bool = False) -> Column:
    """a + b or a - b modulo 2**64, in two halves."""
    half = (1 << 32) - 1
    sign = -1 if minus else 1
    low = a.bitwiseAND(F.lit(half)) + sign * b.bitwiseAND(F.lit(half))
    up = F.shiftrightunsigned(a, 32) + sign * F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(up, 32).bitwiseOR(low.bitwiseAND(F.lit(half)))


def rolling(hashes: Column, windows: Column, base: Column, width: int) -> Column:
    """(start, n, has, fingerprint) of all windows of a region, each from two running sums."""

    def of(p: Column) -> Column:
        def one(w: Column) -> Column:
            at = w["start"] - base
            total = lambda k: _wrapped(F.get(p[f"p{k}"], at + w["has"]), F.get(p[f"p{k}"], at), True)
            return F.struct(w["start"].alias("start"), w["n"].alias("n"), w["has"].alias("has"), majority(total, w["has"], width).alias("fingerprint"))

        return F.transform(windows, one)

    return F.get(F.transform(F.array(running(hashes, width)), of), 0)


def blocks_of(fingerprint: str, near: int = 0) -> Column:
    """(block, value) of the blocks of a fingerprint, and of all values within ``near`` bits of each."""
    values = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda x: F.bit_count(x) <= near) if near else F.array(F.lit(0))
    own = F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(F.col(fingerprint), BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value")) for b in range(BLOCKS)))
    each = lambda v: F.flatten(F.transform(own, lambda s: F.transform(v, lambda x: F.struct(s["block"].alias("block"), s["value"].bitwiseXOR(x.cast("long")).alias("value")))))
    return F.get(F.transform(F.array(values), each), 0)


def within_radius(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(fingerprint, item, hamming) of all pairs within RADIUS; from ``fingerprint``, and ``item`` with ``item_print``."""
    a = prints.select("fingerprint").distinct().select("fingerprint", F.explode(blocks_of("fingerprint")).alias("b")).select("fingerprint", "b.*")
    # Spark takes the filed items for as small as the table of items, so it must not choose a broadcast.
    b = items.select("item", "item_print", F.explode(blocks_of("item_print", NEAR)).alias("b")).select("item", "item_print", "b.*")
    hamming = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))
    return a.hint("merge").join(b.hint("merge"), ["block", "value"]).where(hamming <= RADIUS).select("fingerprint", "item", hamming.cast("int").alias("hamming")).distinct()


def _windows(sizes: list[int]) -> Column:
    """(start, n, has) of the windows of each size that hold enough places ``at``; ``size`` is the document's words."""
    at, size = F.col("at"), F.col("size")

    def of(n: int) -> Column:
        total, has = n - SIZE + 1, F.least(F.lit(n - SIZE + 1), size - (SIZE - 1))
        need = F.ceil(4 * (total + has) / 9).cast("int")
        first = F.when(F.size(at) >= need, F.slice(at, F.lit(1), F.size(at) - need + 1)).otherwise(F.array().cast("array<int>"))
        full = F.filter(first, lambda p, k: F.get(at, k + need - 1) - p < total)
        start = F.array_distinct(F.transform(full, lambda p: F.least(p, F.greatest(size - n, F.lit(0)))))
        return F.transform(start, lambda p: F.struct(p.alias("start"), F.lit(n).alias("n"), has.alias("has")))

    return F.concat(*(of(n) for n in sizes))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, start_word, n_words, hamming, similarity): the best window for each row and item that have one of 0.8 or more."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("words IS NOT NULL AND words[0] <> ''").withColumn("item", F.xxhash64("item_id", "words"))
    items = stored(items.dropDuplicates(["item"]).withColumn("n", F.size("words")), "decontaminate-items")
    # The sizes that items have are few; the longest settles the width of the counters.
    sizes = sorted(r.n for r in items.select("n").distinct().collect())
    full = [n for n in sizes if n >= SIZE]
    width = lane_bits(max([SIZE, *full]))
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), words_of(F.col("text")).alias("words"))
    long = items.where(F.col("n") >= SIZE).withColumn("hashes", shingles_of(F.col("words")))
    long = stored(long.select("item", "item_id", "n", F.array_sort("hashes").alias("item_hashes"), simhash(F.col("hashes"), F.size("hashes"), width).alias("item_print")), "decontaminate-prints")
    known = stored(long.select(F.explode("item_hashes").alias("h")).distinct(), "decontaminate-shingles")

    # The outer form keeps Catalyst from inferring a filter that would split each text again and again;
    # the rows that it makes carry no array.
    hashed = words.select("row", F.size("words").alias("size"), F.when(F.size("words") >= SIZE, shingles_of(F.col("words"))).alias("hashes"))
    placed = hashed.select("row", "size", F.posexplode_outer("hashes").alias("pos", "h"))
    held = placed.join(known, "h").groupBy("row", "size").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    spans = held.select("row", _windows(full).alias("windows")).where("size(windows) > 0") if full else held.select("row", F.lit(None).cast("array<struct<start:int,n:int,has:int>>").alias("windows")).where("false")
    # Regions of a document: windows by the REGION words in which they begin.
    region = spans.select("row", "windows", F.explode(F.array_distinct(F.transform("windows", lambda w: F.floor(w["start"] / REGION).cast("int")))).alias("region"))
    region = region.select("row", F.filter("windows", lambda w: F.floor(w["start"] / REGION) == F.col("region")).alias("windows"))
    spans = stored(region.select("row", "windows", F.array_min("windows.start").alias("base"), F.array_max(F.transform("windows", lambda w: w["start"] + w["has"])).alias("end")), "decontaminate-spans")
    texts = may_be_in(words, "row", spans.select("row")).dropDuplicates(["row"]).join(spans, "row")
    region = texts.select("doc_id", "row", "base", "windows", shingles_of(F.slice("words", F.col("base") + 1, F.col("end") - F.col("base") + (SIZE - 1))).alias("hashes"))
    region = stored(region, "decontaminate-regions")
    window = region.select("row", "base", F.explode(rolling(F.col("hashes"), F.col("windows"), F.col("base"), width)).alias("w"))
    window = stored(window.select("row", "base", "w.*"), "decontaminate-windows")

    near = stored(within_radius(window, long).join(long.select("item", F.col("n").alias("item_n")), "item"), "decontaminate-near")
    near = may_be_in(window, "fingerprint", near.select("fingerprint")).join(near, "fingerprint").where("n = item_n")
    near = near.groupBy("row", "base").agg(F.collect_list(F.struct("start", "n", "has", "item", "hamming")).alias("near"))
    pair = region.drop("windows").join(near, ["row", "base"]).select("doc_id", "row", "base", "hashes", F.explode("near").alias("w"))
    pair = pair.select("doc_id", "row", "w.*", F.array_sort(F.slice("hashes", F.col("w.start") - F.col("base") + 1, F.col("w.has"))).alias("hashes")).join(long.select("item", "item_id", "item_hashes"), "item")
    pair = pair.withColumn("common", F.size(F.array_intersect(numbered(F.col("hashes")), numbered(F.col("item_hashes")))).cast("long"))
    pair = pair.withColumn("all", F.size("hashes") + F.size("item_hashes") - F.col("common")).where("100 * common >= 80 * all")
    best = F.max(F.struct((F.col("common") / F.col("all")).alias("similarity"), (-F.col("start")).alias("start"), "n", "hamming")).alias("best")
    found = pair.groupBy("doc_id", "row", "item_id").agg(best)
    found = found.select("doc_id", "row", "item_id", (-F.col("best.start")).alias("start_word"), F.col("best.n").alias("n_words"), F.col("best.hamming").alias("hamming"), F.round("best.similarity", 6).alias("similarity"))
    forget(spans, known)
    short = [n for n in sizes if n < SIZE]
    if not short:
        return found
    grams = lambda n: F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.xxhash64(F.concat_ws(" ", F.slice("words", i + 1, F.lit(n)))).alias("h")))).otherwise(F.array().cast("array<struct<start:int,n:int,h:bigint>>"))
    own = items.where(F.col("n") < SIZE).select("item_id", "n", F.xxhash64(F.concat_ws(" ", "words")).alias("h"))
    whole = words.select("doc_id", "row", F.explode_outer(F.concat(*(grams(n) for n in short))).alias("g")).select("doc_id", "row", "g.*").join(own, ["h", "n"])
    whole = whole.groupBy("doc_id", "row", "item_id").agg(F.min("start").alias("start_word"), F.first("n").alias("n_words"))
    return found.unionByName(whole.select("doc_id", "row", "item_id", "start_word", "n_words", F.lit(0).alias("hamming"), F.lit(1.0).alias("similarity")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns kept."""
    row = free_name(docs, "row")
    hit = contamination(docs.select("doc_id", "text"), benchmark).select(F.col("row").alias(f"{row}_")).distinct()
    return docs.withColumn(row, F.xxhash64("doc_id", "text")).join(hit, F.col(row) == F.col(f"{row}_"), "left_anti").select(docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in whole documents."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")
