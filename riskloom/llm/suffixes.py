"""Repeated passages by prefix-free parsing: bytes covered by a 100-byte string that starts earlier too.

* Phrases. A rolling hash runs over all ``GRAM``-byte strings. Position a triggers if its string has
  the smallest hash among those of some window of 100 bytes; so every window holds a trigger, and
  equal windows hold it at the same place. A phrase is the run of windows that one trigger serves
  (at most 77) with all their bytes: phrases overlap by 99 bytes, so every window lies whole in one.
  A trigger by a fixed modulus leaves windows without a trigger, which is why the smallest is taken.
* Parse. The phrases of all documents are sorted by (trigger, phrase, corpus place). This is the
  suffix array of the parse to a depth of one phrase, and more depth isn't needed, because no window
  reaches beyond its phrase. Of equal phrases the first in corpus order enters the dictionary; all
  windows of the others start earlier too.
* Dictionary. Where several different phrases share a trigger, their suffixes may agree on 100 bytes.
  ``suffix_ranks`` sorts all suffixes of those phrases by prefix doubling up to 100 bytes; two with
  one rank have a common prefix of 100 bytes. A trigger is a prefix of suffixes, so the tasks, which
  are dealt by trigger, hold ranges of the dictionary's suffix order.
* Combination. Among windows of one rank the first in corpus order stays; the others are marked.

No key gathers much: triggers with many different phrases in one portion of text are found
beforehand (``hot_triggers``) and their windows are dealt one by one, by their own content, as are
the windows of a trigger with more than HOT_PHRASES phrases over all portions. Portions drop equal
phrases of their own before the shuffle, so a passage that a third of the corpus holds is one row a
portion. What was hashed (phrases, and windows of hot triggers) counts as equal if its 64 bits are.

Corpus order is (doc_id, hash of the text, place). Defined results: null and empty texts keep
nothing and lose nothing; texts under 100 bytes lose nothing; rows that repeat a doc_id and its text
are at one place, so neither starts earlier than the other; different texts under one doc_id are
different documents, in the order of a hash of their texts; rows with a null doc_id come first, in
that order too; an empty table gives an empty one. Texts are read in portions of ``PORTION`` bytes
(long ones in overlapping portions), so memory doesn't grow with the text. Extra columns are ignored
here and kept by ``drop_repeats``. Ids under -2**62 are taken by null ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, column_bytes, forget, free_name, may_be_in, mix64, prefix_hash, small_batches, span_hash, stored, text_blocks

LENGTH = 100
GRAM = 24
PORTION = 1 << 18
FLUSH_BYTES = 8 << 20
CHUNK_ROWS = 60_000
COMPARE_ROWS = 6_000
HOT_PHRASES = 2_000
HOT_IN_FLUSH = 24
HOT_BITS = 20
_SHIFT = 14
_SUB = 32


def place_of(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(doc, sub) such that rows are in corpus order by them; equal only for rows of equal id and text."""
    h = F.xxhash64(F.coalesce(text, F.lit("")))
    doc = F.coalesce(doc_id.cast("long"), F.shiftrightunsigned(h, 3) + F.lit(-(1 << 63)))
    return doc, F.shiftrightunsigned(h, 33).cast("int")


def portions(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(data, offsets, place of the first byte): the block, or overlapping pieces of one long text."""
    if len(block) > 1 or len(block.data) <= 2 * PORTION:
        yield block.data, block.offsets, 0
        return
    for at in range(0, len(block.data) - LENGTH + 1, PORTION):
        part = block.data[at : at + PORTION + LENGTH - 1]
        yield part, np.array([0, len(part)]), at


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Trigger hash, phrase hash, document (its place in the block), first window and windows of each
    phrase, and the sums that hash further spans."""
    none = np.zeros(0, np.int64)
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    sums = prefix_hash(data)
    if not n.sum():
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, sums
    start = np.arange(len(data) - gram + 1)
    hashes = span_hash(sums, start, start + gram)
    low = (hashes >> np.uint64(32) << np.uint64(32)) | start.astype(np.uint64)
    span, have = length - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(bounds[-1]) + np.repeat(offsets[:-1] - bounds[:-1], n)
    trigger = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
    first, last = at[new], at[np.append(new[1:], len(at)) - 1]
    anchor = trigger[new]
    content = span_hash(sums, first, last + length)
    doc = np.searchsorted(offsets, anchor, side="right") - 1
    return hashes[anchor], mix64(content + (anchor - first).astype(np.uint64)), doc, first - offsets[doc], last - first + 1, sums


def later(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an entry with the same keys has a smaller (doc, at)."""
    order = np.lexsort((at, doc, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, p = doc[order], at[order]
    out = np.zeros(len(order), bool)
    out[order] = (d != d[head]) | (p != p[head])
    return out


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document, overlapping and touching ones made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] >> _SUB != start[:-1] >> _SUB)])
    # A running maximum of the ends within a document: texts are shorter than 2**31, so one number holds both.
    group = np.cumsum(edge) << _SUB
    mask = (1 << _SUB) - 1
    far = np.maximum.accumulate(group + (end & mask))
    new = edge.copy()
    new[1:] |= (group + (start & mask))[1:] > far[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], (start[at] >> _SUB << _SUB) | (far[last] & mask)


def suffix_ranks(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of the suffix at each position by its first ``length`` bytes, by prefix doubling.

    Suffixes that nothing else agrees with keep their rank and drop out of the next rounds. The
    last ``length`` positions have no meaning.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((n,), ">u8", padded.data, strides=(1,)).astype(np.uint64)
    order = np.argsort(word)
    word = word[order]
    new = np.concatenate([[True], word[1:] != word[:-1]])
    rank = np.empty(n, np.int64)
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        alone = new & np.append(new[1:], True)
        order = order[~alone]
        order = order[order + step < n]
        if not len(order):
            break
        pair = rank[order] << 32 | rank[order + step]
        by = np.argsort(pair)
        order, pair = order[by], pair[by]
        place = np.arange(len(order))
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        group = pair >> 32
        head = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), place, 0))
        rank[order] = group + np.maximum.accumulate(np.where(new, place, 0)) - head
        depth += step
    return rank


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
    """Batches sorted by their first column, dealt anew so that no value is in two of them.

    A value with more than 4 * ``rows`` rows is dealt out in parts; then it's told whether the first
    value began in the part before, and whether this is a part.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    last = None  # the value that a part ended with

    def dealt(cut: int, part: bool) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
        end = int(np.searchsorted(key, key[0], side="right")) if last == key[0] else 0
        if part:
            yield whole.slice(0, cut), bool(end), True
            return
        if end:
            yield whole.slice(0, end), True, True
        if cut > end:
            yield whole.slice(end, cut - end), False, False

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = whole.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield from dealt(cut, False)
            last = None
        elif n >= 4 * rows or last == key[0]:
            yield from dealt(len(key), True)
            last, cut = key[-1], len(key)
        held, n = ([whole.slice(cut)] if cut < len(key) else []), len(key) - cut
    if n:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = whole.column(0).to_numpy()
        yield from dealt(len(key), False)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per portion: phrases as (trigger, phrase, doc, at, windows), their first byte in the portion, and its sums."""
    for b in text_blocks(batches, block_bytes=PORTION):
        ids, subs = b.rows.column(0).to_numpy(), b.rows.column(1).to_numpy().astype(np.int64)
        for data, offsets, base in portions(b):
            h, v, d, p, w, sums = phrases(data, offsets)
            yield h, v, ids[d], subs[d] << _SUB | (p + base), w, offsets[d] + p, sums, len(data)


def hot_triggers(texts: DataFrame) -> np.ndarray:
    """A bit for each of 2**HOT_BITS classes of triggers: some portion of text holds one with HOT_IN_FLUSH phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: list[np.ndarray] = []
        v: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, phrase = np.concatenate(h), np.concatenate(v)
            key = key[np.unique(mix64(key) + phrase, return_index=True)[1]]
            key, n = np.unique(key, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((key[n >= HOT_IN_FLUSH] & np.uint64((1 << HOT_BITS) - 1)).astype(np.int32))], ["slot"])

        for part in _parts(batches):
            h.append(part[0])
            v.append(part[1])
            size += part[7]
            if size >= FLUSH_BYTES:
                yield flush()
                h, v, size = [], [], 0
        if h:
            yield flush()

    out = np.zeros(1 << HOT_BITS, bool)
    out[texts.mapInArrow(run, "slot int").distinct().toArrow().column(0).to_numpy()] = True
    return out


def _phrase_rows(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, phrase, doc, at, end): phrases by trigger, windows of hot triggers by content; rows with ``end`` are ranges already found."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, v, doc, at, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        gone = later([h, v], doc, at)
        d, a, e = merged(doc[gone], at[gone], at[gone] + w[gone] + LENGTH - 1)
        keep = ~gone
        spread = mix64(d.astype(np.uint64) ^ mix64(a.astype(np.uint64)))
        packed = (v[keep] >> np.uint64(_SHIFT) << np.uint64(_SHIFT)) | w[keep].astype(np.uint64)
        key = np.concatenate([h[keep], spread]).view(np.int64)
        end = np.concatenate([np.zeros(int(keep.sum()), np.int64), e])
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(np.concatenate([packed, np.zeros(len(d), np.uint64)]).view(np.int64)), pa.array(np.concatenate([doc[keep], d])), pa.array(np.concatenate([at[keep], a])), pa.array(end, mask=np.arange(len(end)) < len(end) - len(e))],
            ["key", "phrase", "doc", "at", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(shared.value, count=1 << HOT_BITS).astype(bool)
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        for h, v, doc, at, w, first, sums, n in _parts(batches):
            many = hot[(h & np.uint64((1 << HOT_BITS) - 1)).astype(np.int64)]
            if many.any():
                k = w[many]
                inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                begin = np.repeat(first[many], k) + inner
                one = span_hash(sums, begin, begin + LENGTH)
                parts.append((one, one, np.repeat(doc[many], k), np.repeat(at[many], k) + inner, np.ones(len(one), np.int64)))
                size += 16 * len(one)
            parts.append(tuple(x[~many] for x in (h, v, doc, at, w)))
            size += n
            if size >= FLUSH_BYTES:
                yield flush(parts)
                parts, size = [], 0
        if parts:
            yield flush(parts)

    return texts.mapInArrow(run, "key long, phrase long, doc long, at long, end long")


def _settle(rows: DataFrame) -> DataFrame:
    """The sorted parse: ranges of phrases that came before (``end``), and first phrases that others may agree with.

    Of the latter, ``windows`` is set, and ``hot`` where the trigger has too many of them to compare
    in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b, open_, part in _chunks(batches, CHUNK_ROWS):
            key, phrase, doc, at = (b.column(k).to_numpy() for k in range(4))
            known = b.column(4).is_valid().to_numpy(zero_copy_only=False)
            end = np.where(known, b.column(4).fill_null(0).to_numpy(), 0)
            w = phrase & ((1 << _SHIFT) - 1)
            v = phrase >> _SHIFT
            same = np.concatenate([[False], (key[1:] == key[:-1]) & (v[1:] == v[:-1])])
            # Rows of one phrase at the place of its first are repeated rows of the table.
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
            first_doc, first_at = doc[head], at[head]
            if open_ and before is not None and before[0] == v[0]:
                own = head == 0
                first_doc, first_at = np.where(own, before[1], first_doc), np.where(own, before[2], first_at)
            else:
                own = np.zeros(len(key), bool)
            before = (v[-1], first_doc[-1], first_at[-1])
            again = same | own
            gone = ~known & again & ((doc != first_doc) | (at != first_at))
            d, a, e = merged(np.concatenate([doc[known], doc[gone]]), np.concatenate([at[known], at[gone]]), np.concatenate([end[known], at[gone] + w[gone] + LENGTH - 1]))
            live = ~known & ~again
            k = key[live]
            edge = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
            count = np.diff(np.append(np.flatnonzero(edge), len(k)))
            size = np.repeat(count, count)
            cand = (size >= 2) | part
            n, m = len(d), int(cand.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(n, np.int64), k[cand]])), pa.array(np.concatenate([d, doc[live][cand]])), pa.array(np.concatenate([a, at[live][cand]])),
                    pa.array(np.concatenate([e, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n), pa.array(np.concatenate([np.zeros(n, np.int32), w[live][cand].astype(np.int32)]), mask=np.arange(n + m) < n),
                    pa.array(np.concatenate([np.zeros(n, bool), (size[cand] > HOT_PHRASES) | part])),
                ],
                ["key", "doc", "at", "end", "windows", "hot"],
            )

    return rows.repartition("key").sortWithinPartitions("key", "phrase", "doc", "at").mapInArrow(run, "key long, doc long, at long, end long, windows int, hot boolean")


def _contexts(texts: DataFrame, first: DataFrame) -> DataFrame:
    """(key, doc, at, bytes) of the phrases to compare: by trigger with their bytes, or, of hot ones,
    each window by the hash of its content, without bytes."""
    lists = first.select(F.col("doc").alias("_d"), F.shiftright("at", _SUB).cast("int").alias("_s"), F.struct("at", "windows", "key", "hot").alias("x")).groupBy("_d", "_s").agg(F.collect_list("x").alias("x"))
    rows = may_be_in(texts, "doc", first.select("doc")).join(lists, (F.col("doc") == F.col("_d")) & (F.col("sub") == F.col("_s")))
    # Rows that repeat an id and a text are one document.
    rows = rows.dropDuplicates(["doc", "sub"]).select("doc", "text", *(F.col(f"x.{c}").alias(c) for c in ("at", "windows", "key", "hot")))
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("bytes", pa.large_binary())])

    def flat(col: pa.Array) -> np.ndarray:
        return col.flatten().to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, block_bytes=PORTION):
            count = b.rows.column(2).value_lengths().to_numpy()
            row = np.repeat(np.arange(len(b)), count)
            at, w, key, hot = (flat(b.rows.column(c)) for c in (2, 3, 4, 5))
            doc = b.rows.column(0).to_numpy()[row]
            begin = b.offsets[row] + (at & ((1 << _SUB) - 1))
            for lo in range(0, len(row), 10_000):
                cut = slice(lo, lo + 10_000)
                i = np.flatnonzero(~hot[cut]) + lo
                size = w[i].astype(np.int64) + LENGTH - 1
                ends = np.cumsum(size)
                take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[i] - (ends - size), size)
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(i), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(b.data[take]))])
                yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(doc[i]), pa.array(at[i]), text], schema=schema)
            many = np.flatnonzero(hot)
            for lo in range(0, len(many), 1_000):
                i = many[lo : lo + 1_000]
                k = w[i].astype(np.int64)
                inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                place = np.repeat(begin[i], k) + inner
                base = int(place.min())
                sums = prefix_hash(b.data[base : int(place.max()) + LENGTH])
                one = span_hash(sums, place - base, place - base + LENGTH).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(np.repeat(doc[i], k)), pa.array(np.repeat(at[i], k) + inner), pa.nulls(len(one), pa.large_binary())], schema=schema)

    return rows.mapInArrow(run, "key long, doc long, at long, bytes binary")


def _compare(contexts: DataFrame) -> DataFrame:
    """Ranges (doc, at, end) of windows that an earlier phrase of the dictionary holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b, open_, _ in _chunks(batches, COMPARE_ROWS):
            key, doc, at = (b.column(k).to_numpy() for k in range(3))
            alone = b.column(3).is_null().to_numpy(zero_copy_only=False)
            # Windows by content: sorted by corpus place, so the first of a key is its first.
            head = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))
            first_doc, first_at = doc[head], at[head]
            if open_ and before is not None:
                own = head == 0
                first_doc, first_at = np.where(own, before[0], first_doc), np.where(own, before[1], first_at)
            before = (first_doc[-1], first_at[-1])
            gone = alone & ((doc != first_doc) | (at != first_at))
            found = [(doc[gone], at[gone])]
            texts = b.column(3).filter(pa.array(~alone))
            if len(texts):
                raw, offsets = column_bytes(texts)
                n = np.diff(offsets) - LENGTH + 1
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                rank = suffix_ranks(raw)[np.repeat(offsets[:-1], n) + inner]
                d, a = np.repeat(doc[~alone], n), np.repeat(at[~alone], n) + inner
                twice = np.bincount(rank, minlength=1)[rank] > 1
                rank, d, a = rank[twice], d[twice], a[twice]
                gone = later([rank], d, a)
                found.append((d[gone], a[gone]))
            d, a = (np.concatenate(x) for x in zip(*found, strict=True))
            d, a, e = merged(d, a, a + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(e)], ["doc", "at", "end"])

    return contexts.repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(run, "doc long, at long, end long")


def _texts(docs: DataFrame) -> DataFrame:
    doc, sub = place_of(F.col("doc_id"), F.col("text"))
    return small_batches(docs).select(doc.alias("doc"), sub.alias("sub"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc, sub, spans array<struct<pos, end>>) of documents with bytes to remove; spans may overlap."""
    texts = _texts(docs)
    settled = stored(_settle(_phrase_rows(texts, hot_triggers(texts))), "repeat-phrases")
    found = _compare(_contexts(texts, settled.where("windows IS NOT NULL").select("key", "doc", "at", "windows", "hot")))
    ranges = settled.where("end IS NOT NULL").select("doc", "at", "end").union(found)
    mask = (1 << _SUB) - 1
    ranges = ranges.select("doc", F.shiftright("at", _SUB).cast("int").alias("sub"), F.struct(F.col("at").bitwiseAND(mask).alias("pos"), F.col("end").bitwiseAND(mask).alias("end")).alias("span"))
    out = stored(ranges.groupBy("doc", "sub").agg(F.collect_list("span").alias("spans")), "repeat-ranges")
    forget(settled)
    return out


def _spans(cells: pa.Scalar) -> list[tuple[int, int]]:
    pos, end = (cells.values.field(k).to_numpy() for k in range(2))
    _, a, e = merged(np.zeros(len(pos), np.int64), pos, end)
    return list(zip(a.tolist(), e.tolist(), strict=True))


def _keep(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, e in spans:
        out.append(text[at:a])
        at = e
    return b"".join([*out, text[at:]])


def repeat_digests(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``."""
    texts = _texts(docs)
    schema = pa.schema([("_d", pa.int64()), ("_s", pa.int32()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("cut_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            out = []
            for i in range(len(b)):
                spans = _spans(b.rows.column(3)[i])
                out.append((b.rows.column(0)[i].as_py(), b.rows.column(1)[i].as_py(), sum(e - a for a, e in spans), len(spans), hashlib.sha256(_keep(b.text(i), spans)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    hit = may_be_in(texts, "doc", ranges.select("doc")).join(ranges, ["doc", "sub"]).select("doc", "sub", "text", "spans")
    cut = hit.mapInArrow(run, "_d long, _s int, n_removed long, n_spans long, cut_sha256 string").dropDuplicates(["_d", "_s"])
    doc, sub = place_of(F.col("doc_id"), F.col("text"))
    base = docs.select("doc_id", doc.alias("doc"), sub.alias("sub"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = base.join(cut, (F.col("doc") == F.col("_d")) & (F.col("sub") == F.col("_s")), "left")
    return joined.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("cut_sha256", "sha").alias("kept_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes taken out of its texts, all columns kept.

    A span that begins or ends within a character gives that character up to the text that stays.
    """
    d, s, spans_name = (free_name(docs, c) for c in ("doc", "sub", "spans"))
    doc, sub = place_of(F.col("doc_id"), F.col("text"))
    ranges = repeated_ranges(docs.select("doc_id", "text")).select(F.col("doc").alias(f"{d}_"), F.col("sub").alias(f"{s}_"), F.col("spans").alias(spans_name))
    placed = docs.withColumn(d, doc).withColumn(s, sub)
    hit = placed.join(ranges, (F.col(d) == F.col(f"{d}_")) & (F.col(s) == F.col(f"{s}_")), "left").select(*docs.columns, spans_name)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            spans_of = b.rows.column(len(names))
            at = b.rows.schema.get_field_index("text")
            texts = b.rows.column(at).to_pylist()
            for i in np.flatnonzero(spans_of.is_valid().to_numpy(zero_copy_only=False)).tolist():
                raw, cut = b.text(i), []
                for a, e in _spans(spans_of[i]):
                    while a < e and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while e > a and e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    cut.append((a, e))
                texts[i] = _keep(raw, cut).decode()
            cols = [pa.array(texts, pa.string()) if k == at else b.rows.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return hit.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each text without its repeated 100-byte strings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeat_digests(docs, repeated_ranges(docs))
