"""Helpers that the operators share: text as byte blocks, words, shingles, shared folders.

A *block* is a run of whole documents of one Arrow batch whose texts hold at most ``block_bytes``
bytes together (a longer document is a block of its own), so that numpy work over a block needs
bounded memory whatever the batch size.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 1 << 19
#: A group of more than 1 / HOT_SHARE of all rows is joined by a broadcast of such groups.
HOT_SHARE = 2000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Rows and bytes of an Arrow batch between Spark and Python: of whole texts fewer rows than Spark's default.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session gets batches of bounded size where the user has set none."""
    conf = df.sparkSession.conf
    for key, value in BATCHES.items():
        if conf.get(key, None) is None:
            conf.set(key, value)
    return df


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset a temporary one on a single machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wish: str) -> str:
    """A name for an added column that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{wish}"
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            with np.errstate(over="ignore"):
                step = np.full(size, _BASE, np.uint64)
                step[0] = 1
                cls.up = np.multiply.accumulate(step)
                step[1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
                cls.down = np.multiply.accumulate(step)
        return cls.up, cls.down


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """uint64 sums S with S[j] - S[i] = hash of data[i:j] times base**i."""
    up, _ = _Powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), the same wherever a span stands."""
    _, down = _Powers.get(len(sums))
    return mix64((sums[end] - sums[start]) * down[start])


#: Spans of more bytes than this get a digest instead of mixed lanes.
_MOST_LANES = 64
_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LANE_ODD = (_M1, _M2)


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, count: int = 1, first: int = 0) -> np.ndarray:
    """``count`` (1 or 2) independent 64-bit keys of each byte span [start, end), a row each, from number ``first`` on: lanes of eight bytes mixed in one after the other.

    Unlike ``span_hash`` there is no algebra between the keys of different spans, so texts built by a
    rule don't collide more often than others.
    """
    n = end - start
    h = np.stack([mix64(n.astype(np.uint64) * _M2 + np.uint64((2 * k + 1) * int(_BASE) % (1 << 64))) for k in range(first, first + count)])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    most = 8 * _MOST_LANES
    if len(n) and n.max() > most:
        for i in np.flatnonzero(n > most).tolist():
            h[:, i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest(), np.uint64)[first : first + count]
    todo, at, rest = np.flatnonzero(n <= most), start, n
    if len(todo) < len(n):
        at, rest = at[todo], rest[todo]
    whole = len(todo) == len(n)  # the first lane needs no places
    while len(todo):
        w = lanes[at]
        w &= _LANE_MASK[np.minimum(rest, 8)]
        for k in range(count):
            if whole:
                h[k] = mix64((h[k] ^ w) * _LANE_ODD[first + k] + _BASE)
            else:
                h[k, todo] = mix64((h[k, todo] ^ w) * _LANE_ODD[first + k] + _BASE)
        on = np.flatnonzero(rest > 8)
        todo, at, rest, whole = todo[on], at[on] + 8, rest[on] - 8, False
    return h


@dataclass
class Block:
    """Whole documents: their batch rows, all bytes, and the offsets of each document."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if pa.types.is_string_view(col.type) or col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if offs is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < len(offsets) - 1:
            last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
            last = min(max(last, first + 1), len(offsets) - 1)
            lo, hi = offsets[first], offsets[last]
            yield Block(batch.slice(first, last - first), data[lo:hi], offsets[first : last + 1] - lo)
            first = last
    # Workers live on from stage to stage: what Arrow keeps of this one goes back to the system.
    pa.default_memory_pool().release_unused()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Words:
    """Words of a block: byte spans of the lower-cased data, and each document's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # per document, and one more at the end

    def hashes(self) -> np.ndarray:
        return span_keys(self.data, self.start, self.end)[0]


def words(block: Block) -> Words:
    """Runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; none crosses a document."""
    data = _LOWER[block.data]
    ink = ~_SPACE[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    inner = block.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = ink[inner]
    ends[inner - 1] = ink[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, block.offsets))


def shingles(w: Words, hashes: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's word shingles, and each document's range of them.

    A document of fewer than ``size`` words has its whole sequence as the one shingle, one without
    words has none. Shingles repeat as often as they occur; ``np.unique`` gives a document's set.
    """
    n = np.diff(w.first)
    odd = list(mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1))
    total = len(hashes)
    full = np.zeros(total, np.uint64)
    for k in range(min(size, total)):
        full[: total - k] += hashes[k:] * odd[k]
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(bounds[-1]) + np.repeat(w.first[:-1] - bounds[:-1], counts)
    out = full[at]
    for i in np.flatnonzero((n > 0) & (n < size)):
        seq = hashes[w.first[i] : w.first[i + 1]]
        out[bounds[i]] = np.uint64(len(seq)) + (seq * np.array(odd[: len(seq)], np.uint64)).sum(dtype=np.uint64)
    return mix64(out), bounds


def with_group(rows: DataFrame, groups: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row a group; groups of more than 1/HOT_SHARE of all rows, of which
    there are fewer than HOT_SHARE, are broadcast, so no task gathers a large one."""
    from pyspark.sql import functions as F

    hot = F.col(copies) > max(64, total // HOT_SHARE)
    near = rows.join(F.broadcast(groups.where(hot)), key, "left")
    done = near.where(F.col(copies).isNotNull() | F.col(key).isNull())
    rest = near.where(F.col(copies).isNull() & F.col(key).isNotNull()).select(rows.columns).join(groups.where(~hot), key, "left")
    return done.unionByName(rest)


def may_be_in(df: DataFrame, key: str, ids: DataFrame, bits: int = 23) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``ids`` (one column): a filter before an exact join.

    A bit array of fixed size, built by an aggregate, is broadcast: at most 2**(bits-6) rows of
    16 bytes however many ids there are. Beyond some 2**bits ids it lets all rows pass.
    """
    from pyspark.sql import functions as F

    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    name = ids.columns[0]
    one = ids.select(slot(F.col(name)).alias("_s")).select(F.shiftright("_s", 6).alias("_w"), F.expr("shiftleft(1L, cast(_s & 63 as int))").alias("_m"))
    table = one.groupBy("_w").agg(F.bit_or("_m").alias("_m"))
    marked = df.withColumn("_s", slot(F.col(key))).withColumn("_w", F.shiftright("_s", 6))
    return marked.join(F.broadcast(table), "_w").where(F.expr("(shiftright(_m, cast(_s & 63 as int)) & 1) = 1")).select(*df.columns)
