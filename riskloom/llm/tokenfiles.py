"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A shard file is: magic, SHA-256 of the dictionary, one zstandard frame a document, then the index
(doc ids, id counts and frame offsets as little-endian integers) and a footer with the index's place.
``read_document`` fetches one document with two small reads. The dictionary lies beside the shards.
Ids are kept as 16-bit integers where the vocabulary allows, else as 32-bit ones.

Tasks write under names of their own attempt; the manifest table lists those of the attempts that
Spark accepted, so a lost executor or a repeated task leaves only a file that nothing refers to.

Defined results: null and empty texts are a document with only the end id; null ids of documents
come first in the order and stay null; repeated doc ids stand side by side in any order; an empty
table gives no shard; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Block, shared_dir, small_batches, text_blocks
from .bpe import default_tokenizer
from .piecetable import PORTION, PieceTable, Store, distinct, piece_keys, piece_spans, portions

MAGIC = b"RLTOKEN1"
FOOTER = struct.Struct("<QQc7x8s")
HEAD = len(MAGIC) + 32
NULL_ID = -(1 << 63)
END_ID = 2
SHARD_BYTES = 64 << 20
DICT_BYTES = 64 << 10
DICT_DOCS = 400
DICT_SAMPLE_BYTES = 8 << 20


_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,!?;:")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def open_path(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class LibraryPieces:
    """Ids of texts by the tokenizers library; a bounded table remembers the ids of pieces between blanks.

    The table is open addressing over arrays: two 64-bit keys of a piece of at most ``LONGEST`` bytes,
    and where its ids lie in ``store``. A table or an id store that fills up starts anew. Probes tell
    whether the tokenizer's ids allow cuts at blanks, and at marks behind plain letters; one whose
    ids depend on blanks has its texts encoded whole.
    """

    SLOT_BITS = 21
    MOST_IDS = 1 << 23
    PROBES = ("a b", "a  b", " a", "a ", "a\nb", "\n\na1 !", "x. y")
    MARKED = (("ab", "."), ("ab", ",, "), ("Ab", ".cd"), ("x", "!\"'s"), ("it's", ";"), ("é b", ":?"))

    def __init__(self, tokenizer: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype(dtype)
        whole = self._encode([*self.PROBES])
        self.in_pieces = all(w == [i for x in self._encode(p.replace("\n", " ").split(" ")) for i in x] for p, w in zip(self.PROBES, whole, strict=True))
        #: Whether a mark behind a plain letter begins a piece of its own.
        self.at_marks = all(w == [i for x in self._encode([*p]) for i in x] for p, w in zip(self.MARKED, self._encode(["".join(p) for p in self.MARKED]), strict=True))
        self.table, self.store = PieceTable(self.SLOT_BITS, 2), Store(self.dtype)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)(texts, add_special_tokens=False)]

    def ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block one behind the other, and each document's range; a long text in portions."""
        if not self.in_pieces:
            coded = self._encode([block.text(i).decode() for i in range(len(block))])
            return np.fromiter(chain.from_iterable(coded), self.dtype), np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
        if len(block) > 1 or len(block.data) <= 4 * PORTION:
            return self._of_pieces(block.data, block.offsets)
        ids = np.concatenate([self._of_pieces(p, np.array([0, len(p)]))[0] for p in portions(block.data)])
        return ids, np.array([0, len(ids)])

    def _of_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table.full or self.store.used > self.MOST_IDS:
            self.table.clear()
            self.store.used = 0
        begins, ends = piece_spans(data, offsets)
        if self.at_marks:
            cut = np.flatnonzero(_MARK[data[1:]] & _LETTER[data[:-1]]) + 1
            begins[cut], ends[cut - 1] = True, True
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        bounds = np.searchsorted(start, offsets)
        if not len(start):
            return np.zeros(0, self.dtype), bounds
        keys = piece_keys(data, start, end)
        slot = self.table.find(keys)
        at, count = self.table.values[:, slot].astype(np.int64)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            first, which = distinct(keys[:, miss])
            first = miss[first]
            raw = data.tobytes()
            coded = self._encode([raw[a:e].decode() for a, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            place = self.store.add(np.fromiter(chain.from_iterable(coded), self.dtype, int(size.sum())), size)
            at[miss], count[miss] = place[which], size[which]
            short = end[first] - start[first] <= PieceTable.LONGEST
            self.table.insert(keys[:, first[short]], np.stack([place, size])[:, short])
        out, edges = self.store.gather(at, count)
        return out, edges[bounds]


_KNOWN: dict[tuple[str, str], LibraryPieces] = {}


def known_pieces(tokenizer: str, dtype: str) -> LibraryPieces:
    """The pieces that this Python worker remembers, from one task to the next."""
    if (tokenizer, dtype) not in _KNOWN:
        _KNOWN[tokenizer, dtype] = LibraryPieces(tokenizer, dtype)
    return _KNOWN[tokenizer, dtype]


def id_dtype(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary from serialized id arrays; of too few samples, their raw bytes."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES].ljust(8, b"\0")


class ShardWriter:
    def __init__(self, folder: str, dictionary: bytes) -> None:
        self.fs, path = open_path(folder)
        self.path = f"{path}/{uuid.uuid4().hex}.tok"
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.at = HEAD
        self.docs: list[int] = []
        self.counts: list[int] = []
        self.offsets: list[int] = []

    def add(self, doc_id: int, n: int, frame: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(n)
        self.offsets.append(self.at)
        self.out.write(frame)
        self.at += len(frame)

    def close(self, width: int) -> tuple[str, int, int, int]:
        for values, kind in ((self.docs, "<i8"), (self.counts, "<i8"), ([*self.offsets, self.at], "<i8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(FOOTER.pack(self.at, len(self.docs), bytes([width]), MAGIC))
        self.out.close()
        return self.path, len(self.docs), sum(self.counts), self.at


class ShardReader:
    """Index of a shard, and its documents in order or alone."""

    def __init__(self, folder: str, path: str, dictionary: bytes) -> None:
        self.file = open_path(folder)[0].open_input_file(path)
        size = self.file.size()
        place, n, width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or self.file.read_at(HEAD, 0) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} wasn't written with this dictionary")
        index = np.frombuffer(self.file.read_at(8 * (3 * n + 1), place), "<i8")
        self.docs, self.counts, self.offsets = index[:n], index[n : 2 * n], index[2 * n :]
        self.dtype = f"<u{width[0]}"
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(self.unpack.decompress(self.file.read_at(b - a, a)), self.dtype)

    def documents(self, block: int = 4 << 20) -> Iterator[np.ndarray]:
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + block)))
            j = min(j, n)
            base = int(self.offsets[i])
            data = self.file.read_at(int(self.offsets[j]) - base, base)
            for k in range(i, j):
                yield np.frombuffer(self.unpack.decompress(data[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base]), self.dtype)
            i = j


def sample_texts(docs: DataFrame, most: int, most_bytes: int = DICT_SAMPLE_BYTES) -> list[str]:
    """Up to ``most`` texts with ``most_bytes`` together, those with the smallest hashes; hashes and sizes are fetched first."""
    h = F.xxhash64("doc_id", "text", F.lit(3))
    sizes = docs.select(h.alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("h").limit(most).collect()
    picked, room = [], most_bytes
    for r in sizes:
        room -= r.n
        if room < 0:
            break
        picked.append(r.h)
    rows = docs.select(h.alias("h"), "text").where(F.col("h").isin(picked or [0])).dropDuplicates(["h"]).collect()
    return [r.text or "" for r in sorted(rows, key=lambda r: r.h)]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, dict_docs: int = DICT_DOCS) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order; the manifest: one row a shard."""
    spark = docs.sparkSession
    docs = small_batches(docs).select("doc_id", "text")
    dtype = id_dtype(tokenizer)
    sample = sample_texts(docs, dict_docs)
    end = np.array([end_id], dtype).tobytes()
    known = LibraryPieces(tokenizer, dtype)
    trained: list[bytes] = []
    for b in text_blocks(iter([pa.RecordBatch.from_arrays([pa.array(sample, pa.string())], ["text"])])):
        ids, bounds = known.ids(b)
        trained += [ids[bounds[k] : bounds[k + 1]].tobytes() + end for k in range(len(b))]
    dictionary = train_dictionary(trained)
    files, base = open_path(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/dictionary") as f:
        f.write(dictionary)
    width = int(dtype[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        known = known_pieces(tokenizer, dtype)
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_dict_id=False)
        done: list[tuple] = []
        shard = None
        for b in text_blocks(batches, block_bytes=1 << 20):
            docs_ = b.rows.column(0).fill_null(NULL_ID).to_pylist()
            ids, bounds = known.ids(b)
            for i, doc in enumerate(docs_):
                if shard is None:
                    shard = ShardWriter(folder, dictionary)
                raw = ids[bounds[i] : bounds[i + 1]].tobytes()
                shard.add(doc, len(raw) // width + 1, pack.compress(raw + end))
                if shard.at >= SHARD_BYTES:
                    done.append((part, len(done), shard.docs[0], *shard.close(width)))
                    shard = None
        if shard is not None:
            done.append((part, len(done), shard.docs[0], *shard.close(width)))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "first_doc", "path", "docs", "tokens", "bytes"), x, strict=True)) for x in done], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    made = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "part int, seq int, first_doc long, path string, docs long, tokens long, bytes long")
    made.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of the shards: doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit ids)."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_path(folder)
        with files.open_input_stream(f"{base}/dictionary") as f:
            dictionary = f.read()
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = ShardReader(folder, path, dictionary)
                start = at + np.concatenate([[0], np.cumsum(r.counts)])[:-1]
                sums = []
                for k, ids in enumerate(r.documents()):
                    if len(ids) != r.counts[k]:
                        raise ValueError(f"{path}: document {k} has {len(ids)} ids, its index says {r.counts[k]}")
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(r.docs, mask=r.docs == NULL_ID), pa.array(start, pa.int64()), pa.array(r.counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return shards.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(folder: str, path: str, place: int) -> np.ndarray:
    """The ids of one document of a shard, by its place in the shard."""
    files, base = open_path(folder)
    with files.open_input_stream(f"{base}/dictionary") as f:
        return ShardReader(folder, path, f.read()).document(place)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as token-id files, written and read back."""
    folder = shared_dir(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, default_tokenizer())
    return read_token_files(spark, folder)
