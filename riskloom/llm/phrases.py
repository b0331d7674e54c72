"""Phrase collocations by dynamic itemset counting.

The documents are dealt into a few shards, which are scanned one after the other in a cycle. Words
are counted from the first scan on. A longer phrase becomes active behind the scan in which both of
its subphrases (without its last and without its first word) have reached the threshold, whatever
shard that was, and is counted in each scan from then on until it has seen every shard once: then its
count is complete. Scans thus count phrases of several lengths at a time. A phrase that is frequent
has frequent subphrases, so none is missed.

Tasks count by 64-bit keys in array operations; a key holds the phrase's length and first scan. When
its subphrases reached the threshold a task sees in a table of fixed size, by slot the first such scan
of any phrase in it. A slot that several phrases share can only make a phrase active earlier, and it is
still counted in as many consecutive scans as there are shards: once in each. Only the words behind each
other whose shorter phrases have all reached the threshold get keys of longer ones, and only what is active
in a scan gets second keys, so that late scans, in which little is active, cost little. What is kept between
scans are the keys whose cycle isn't over, in a table bucketed by key, so that only new counts are shuffled.

Slots and keys of one word's length are shared, counts are not: they are kept by the key (56 bits of
hash) and an independent second key (64 bits) together. At the end each frequent pair of keys is given its text. The
documents are dealt into portions, each larger than the one before and stored apart; a portion is read
for the texts that all portions before it didn't have, until none is missing. A frequent phrase stands in many
documents, so most texts are found in the first few portions, and few tasks make the same one.

Scores are lift-like: of a phrase with count a, cut into parts with counts l and r, floor(2000000 a /
(l + r)), of all cuts the lowest. All counts are by language; a null language is ``und``.

Defined results: null and empty texts have no words; repeated rows count as often as they occur; an
empty table gives an empty one; other columns are not read; a text may be of any length.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import column_bytes, forget, mix64, shared_dir, small_batches, span_keys, stored
from .piecetable import distinct

SHARDS = 3
LONGEST = 4
THRESHOLD = 30
MOST = 2000
#: Slots of the table of phrases that reached the threshold: 16 MB, however many there are.
SLOT_BITS = 24
BLOCK_BYTES = 1 << 20
#: Counts that a task keeps before it adds them up, and before it hands them on.
HELD = 1 << 21
NEVER = 127
#: Portions of the documents that are read for texts, and their share in 32: a portion's files hold nothing else.
PORTION_ENDS = (1, 8, 32)
PORTIONS = len(PORTION_ENDS)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, n: int) -> pa.Array:
    """Strings of ``n`` words each from word number ``first`` on, joined by one space."""
    size = np.zeros(len(first), np.int64)
    for k in range(n):
        size += end[first + k] - start[first + k]
    bounds = np.concatenate([[0], np.cumsum(size + n - 1)])
    out = np.full(int(bounds[-1]), 0x20, np.uint8)
    at = bounds[:-1].copy()
    for k in range(n):
        length = end[first + k] - start[first + k]
        before = np.cumsum(length) - length
        step = np.arange(int(length.sum()))
        out[step + np.repeat(at - before, length)] = data[step + np.repeat(start[first + k] - before, length)]
        at += length + 1
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])


class Scan:
    """One scan: which phrases of a text are active in it, and their counts by key (or, when texts are looked for, by text)."""

    def __init__(self, step: int, shards: int, longest: int, reached: np.ndarray, frequent: np.ndarray | None = None) -> None:
        self.step, self.shards, self.longest, self.reached, self.frequent = step, shards, longest, reached, frequent
        self.slots = np.uint64(len(reached) - 1)

    def __getstate__(self) -> dict:
        """Tables are mostly empty: they travel compressed."""
        pack = lambda a: None if a is None else (zlib.compress(a.tobytes(), 1), a.dtype.str)
        return self.__dict__ | {"reached": pack(self.reached), "frequent": pack(self.frequent)}

    def __setstate__(self, state: dict) -> None:
        unpack = lambda p: None if p is None else np.frombuffer(zlib.decompress(p[0]), p[1])
        self.__dict__ |= state | {"reached": unpack(state["reached"]), "frequent": unpack(state["frequent"])}

    def count(self, data: np.ndarray, offsets: np.ndarray, langs: list[str], limit: int | None = None) -> Iterator[tuple]:
        """Counts of the phrases of whole documents; of those that begin before byte ``limit`` only."""
        data = _LOWER[data]
        cut = _BREAK[data]
        ink = ~(cut | _BLANK[data])
        begins, ends = ink.copy(), ink.copy()
        begins[1:] &= ~ink[:-1]
        ends[:-1] &= ~ink[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner], ends[inner - 1] = ink[inner], ink[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(start):
            return
        doc = np.searchsorted(offsets, start, side="right") - 1
        piece = np.cumsum(cut)[start] + doc
        names = sorted(set(langs))
        number = {x: k for k, x in enumerate(names)}
        lang = np.array([number[x] for x in langs])[doc]
        all_twins = self.step <= self.shards or self.frequent is not None
        both = span_keys(data, start, end, 2 if all_twins else 1)
        word, twin = both[0], both[1] if all_twins else None
        lang_keys = np.array([_lang_key(x) for x in names], np.uint64)
        keys = mix64(word + lang_keys[lang])
        total = len(start) if limit is None else int(np.searchsorted(start, limit))
        if self.frequent is not None:
            yield names, np.bincount(lang[:total], minlength=len(names))

        def second_keys(at: np.ndarray, n: int) -> np.ndarray:
            """Of the same words, independent of the keys."""
            if twin is None:
                need = np.zeros(len(start), bool)
                for k in range(n):
                    need[at + k] = True
                of = np.zeros(len(start), np.uint64)
                of[need] = span_keys(data, start[need], end[need], 1, 1)[0]
            else:
                of = twin
            out = of[at] + lang_keys[lang[at]] * _ODD
            for k in range(1, n):
                out = mix64(out * _ODD + of[at + k])
            return out

        seen = np.zeros(0, np.int8)
        for n in range(1, self.longest + 1):
            if n == 1:
                may, late = np.arange(len(word)), np.full(len(word), -1, np.int8)
                own = keys
            else:
                # Behind the last word of a piece nothing follows, so pieces of fewer than n words drop out.
                last = len(word) - n + 1
                if last <= 0:
                    break
                late = np.maximum(seen[:last], seen[1 : last + 1])
                may = np.flatnonzero((late < NEVER) & (piece[:last] == piece[n - 1 :]))
                if not len(may):
                    break
                late = late[may]
                own = mix64(keys[may] * _ODD + word[may + n - 1])
                keys = np.zeros(last, np.uint64)
                keys[may] = own
            slot = ((own >> np.uint64(8)) & self.slots).astype(np.int64)
            # No phrase counts as reached before its parts, whatever it shares its slot with.
            seen = np.full(len(word) - n + 1, NEVER, np.int8)
            seen[may] = np.maximum(self.reached[slot], late)
            first_scan = late.astype(np.int64) + 1
            if self.frequent is not None:
                on = (may < total) & self.frequent[slot]
            else:
                on = (may < total) & (first_scan <= self.step) & (self.step < first_scan + self.shards)
            at = may[on]
            if len(at):
                own, since = _marked(own[on], first_scan[on], n), first_scan[on]
                checks = second_keys(at, n)
                if self.frequent is None:
                    yield _added(own, checks, np.ones(len(own), np.int64))
                else:
                    first, which = distinct(np.stack([own, checks]))
                    key, c = own[first], np.bincount(which, minlength=len(first))
                    order = np.argsort(key, kind="stable")
                    key, first, c = key[order], first[order], c[order]

                    def rows(some: np.ndarray, first: np.ndarray = first, n: int = n, at: np.ndarray = at, since: np.ndarray = since, own: np.ndarray = own, checks: np.ndarray = checks) -> pa.Table:
                        """Language, length, text, first scan and both keys of some of these phrases."""
                        some = first[some]
                        where = pa.DictionaryArray.from_arrays(pa.array(lang[at[some]], pa.int32()), pa.array(names, pa.large_string())).cast(pa.large_string())
                        return pa.Table.from_arrays([where, pa.array(np.full(len(some), n, np.int32)), spans(data, start, end, at[some], n), pa.array(since[some].astype(np.int32)), pa.array(own[some].view(np.int64)), pa.array(checks[some].view(np.int64))], ["lang", "n", "phrase", "start", "key", "twin"])

                    yield key, checks[first], c, rows

    def parts(self, data: np.ndarray, lang: str) -> Iterator[tuple]:
        """Counts of one long text, in portions that see the words behind them."""
        sep = lambda a, b: np.flatnonzero((_BREAK | _BLANK)[data[a:b]])
        at = 0
        while at < len(data):
            end, size = len(data), BLOCK_BYTES
            while at + size < len(data):
                if len(s := sep(at, at + size)):
                    end = at + int(s[-1]) + 1
                    break
                size *= 2
            far, more = end, 4096
            while far < len(data):
                far = min(end + more, len(data))
                s = sep(end, far)
                if far == len(data) or (np.diff(s) > 1).sum() >= self.longest:
                    far = far if far == len(data) else end + int(s[-1])
                    break
                more *= 2
            yield from self.count(data[at:far], np.array([0, far - at]), [lang], end - at)
            at = end

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            data, offsets = column_bytes(b.column(1))
            langs = b.column(0).to_pylist()
            i = 0
            while i < len(langs):
                j = int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1
                j = min(max(j, i + 1), len(langs))
                part = data[offsets[i] : offsets[j]]
                yield from self.parts(part, langs[i]) if len(part) > 2 * BLOCK_BYTES else self.count(part, offsets[i : j + 1] - offsets[i], langs[i:j])
                i = j

    def by_key(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return _added(*columns)

        def out(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)].view(np.int64)) for x in columns], ["key", "twin", "c"])

        for x in self.blocks(batches):
            held.append(x)
            rows += len(x[0])
            if rows > HELD:
                held.append(added())
                rows = len(held[0][0])
                if rows > HELD // 2:
                    yield from out(*held.pop())
                    rows = 0
        if held:
            yield from out(*added())

    def by_text(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts by text: a task makes the text of a key once, and hands on a key whose second one differs as it comes."""
        words: dict[str, int] = {}
        keys, checks, place, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts: list[pa.Table] = []

        def out(t: pa.Table, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from t.append_column("c", pa.array(c.astype(np.int64))).to_batches(1 << 16)

        def held() -> Iterator[pa.RecordBatch]:
            yield from out(pa.concat_tables(texts), counts)

        for x in self.blocks(batches):
            if len(x) == 2:
                for lang, n in zip(*x, strict=True):
                    words[lang] = words.get(lang, 0) + int(n)
                continue
            key, check, c, rows = x
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            same = known.copy()
            same[known] = checks[at[known]] == check[known]
            counts[place[at[same]]] += c[same]
            odd, new = np.flatnonzero(known & ~same), np.flatnonzero(~known)
            if len(odd):
                yield from out(rows(odd), c[odd])
            if len(new):
                texts.append(rows(new))
                where = np.searchsorted(keys, key[new])
                keys, checks = np.insert(keys, where, key[new]), np.insert(checks, where, check[new])
                place = np.insert(place, where, len(counts) + np.arange(len(new)))
                counts = np.concatenate([counts, c[new]])
            if len(counts) > HELD:
                yield from held()
                keys, checks, place, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                texts = []
        if texts:
            yield from held()
        if words:
            names = list(words)
            t = pa.table({"lang": pa.array(names, pa.large_string()), "n": pa.array([0] * len(names), pa.int32()), "phrase": pa.array([""] * len(names), pa.large_string()), "start": pa.array([0] * len(names), pa.int32()), "key": pa.array([0] * len(names)), "twin": pa.array([0] * len(names))})
            yield from out(t, np.array([words[x] for x in names]))


def _added(key: np.ndarray, check: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by both keys. Should one key have several second ones here, a pair may remain in several rows: they are added up later."""
    order = np.argsort(key)
    key, check, c = key[order], check[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]))
    return key[first], check[first], np.add.reduceat(c, first)


def _marked(key: np.ndarray, start: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Keys whose last byte holds first scan and length."""
    return (key >> np.uint64(8) << np.uint64(8)) | (start.astype(np.uint64) << np.uint64(3)) | (np.asarray(n) - 1).astype(np.uint64)


def _slots(keys: DataFrame, bits: int) -> np.ndarray:
    """Slots (1 << bits of them) that hold one of ``keys``, each once."""
    slot = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return keys.select(slot.alias("slot")).distinct().toArrow().column(0).to_numpy()


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f, start) of all phrases of at most ``longest`` words with f >= ``threshold``, and (lang, words) of all words.

    ``docs`` has lang and text; ``start`` is the scan in which a phrase became active.
    """
    if longest > 8 or longest * shards > 31:
        raise ValueError("longest has to be 8, longest * shards 31 at most")
    spark = docs.sparkSession
    home = shared_dir(spark, "phrases")
    row = F.monotonically_increasing_id()
    dealt = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64(row), F.lit(PORTION_ENDS[-1])).alias("portion"), (row % shards).cast("int").alias("shard"))
    dealt = dealt.withColumn("portion", sum((F.col("portion") >= end).cast("int") for end in PORTION_ENDS[:-1]))
    dealt.write.partitionBy("shard", "portion").parquet(home)
    corpus = small_batches(spark.read.schema("lang string, text string, shard int, portion int").parquet(home))
    corpus.stored_at = home
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reached = np.full(1 << slot_bits, NEVER, np.int8)
    first = F.shiftright("key", 3).bitwiseAND(F.lit(31))
    state, held = None, None
    done: list[DataFrame] = []  # frequent keys whose cycle is over
    step, last = 0, -1
    while step < shards or step <= last + shards:
        found = corpus.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(Scan(step, shards, longest, reached).by_key, "key long, twin long, c long")
        found = found.groupBy("key", "twin").agg(F.sum("c").alias("c"))
        if state is not None:
            # The state is bucketed by key: new counts alone are shuffled.
            found = state.join(found, ["key", "twin"], "full_outer").select("key", "twin", (F.coalesce("f", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("f"), "reach")
        else:
            found = found.select("key", "twin", F.col("c").alias("f"), F.lit(None).cast("int").alias("reach"))
        found = found.withColumn("reach", F.coalesce("reach", F.when(F.col("f") >= threshold, F.lit(step))))
        name = f"phrases_{uuid.uuid4().hex}"
        place = shared_dir(spark, "phrases-state")
        found.where((first + shards > step + 1) | F.col("reach").isNotNull()).write.bucketBy(buckets, "key", "twin").sortBy("key", "twin").option("path", place).saveAsTable(name)
        before, held = held, (name, place)
        both = spark.table(name)
        new = _slots(both.where((F.col("reach") == step) & (F.col("key").bitwiseAND(F.lit(7)) < longest - 1)), slot_bits)
        reached[new] = np.minimum(reached[new], step)
        last = step if len(new) else last
        state = both.where(first + shards > step + 1)
        done.append(stored(both.where((first + shards <= step + 1) & F.col("reach").isNotNull()).select("key", "twin", "f"), "phrases-done"))
        if before:
            _drop(spark, *before)
        step += 1
    _drop(spark, *held)
    missing = stored(reduce(DataFrame.unionByName, done), "phrases-missing")
    forget(*done)
    found = []
    for portion in range(PORTIONS):
        wanted = np.zeros(1 << slot_bits, bool)
        wanted[_slots(missing, slot_bits)] = True
        if not wanted.any():
            break
        made = corpus.where(F.col("portion") == portion).select("lang", "text").mapInArrow(Scan(step, shards, longest, reached, wanted).by_text, "lang string, n int, phrase string, start int, key long, twin long, c long")
        one = made.where("n > 0").groupBy("key", "twin").agg(F.min(F.struct("lang", "n", "phrase", "start")).alias("x"))
        found.append(stored(missing.join(one, ["key", "twin"]).select("key", "twin", "x.lang", "x.n", "x.phrase", "f", "x.start"), "phrases-frequent"))
        before, missing = missing, stored(missing.join(found[-1], ["key", "twin"], "left_anti"), "phrases-missing")
        forget(before)
    word = r"[^ \t.,;:!?\n\x0B\f\r]+"
    words = stored(corpus.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(word)).cast("long")).alias("words")).where("words > 0"), "phrases-words")
    forget(corpus, missing)
    texts = reduce(DataFrame.unionByName, found) if found else _no_texts(spark)
    return texts.select("lang", "n", "phrase", "f", "start"), words


def _no_texts(spark: SparkSession) -> DataFrame:
    """No texts: what a corpus without frequent phrases has."""
    return spark.createDataFrame([], "lang string, n int, phrase string, f long, start int")


def _drop(spark: SparkSession, name: str, place: str) -> None:
    table = spark.table(name)
    table.stored_at = place
    spark.sql(f"DROP TABLE {name}")
    forget(table)


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, most: int = MOST, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases of two words and more.

    A phrase that stands in a longer one with 100 * f(longer) >= 80 * a is dropped.
    """
    freq, words = frequent_phrases(docs, threshold, longest, shards)
    cand = freq.where("n > 1").select("lang", F.col("n").alias("size"), "phrase", F.col("f").alias("a"))
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("_l", F.expr("substring_index(phrase, ' ', k)")).withColumn("_r", F.expr("substring_index(phrase, ' ', k - size)"))
    count = lambda part, name: freq.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(count("_l", "l"), ["lang", "_l"]).join(count("_r", "r"), ["lang", "_r"])
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(8,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")
    # All shorter phrases of two words and more that stand in a candidate.
    w = F.split("phrase", " ")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: F.array_join(F.slice(w, s, m), " "))))
    held = cand.where("size > 2").select("lang", F.col("a").alias("longer"), F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * 80))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(words.withColumnRenamed("words", "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
