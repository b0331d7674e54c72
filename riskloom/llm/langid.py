"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a hash of its code point, so that letters of
all scripts have one and no alphabet is kept. A run of anything but letters and marks is one gap
letter. The vector of an n-gram binds (multiplies) its letters' vectors, each permuted (rolled) once
for every letter behind it; n-grams are those of words with a gap on either side, none crosses a gap. A text's vector bundles (adds) the vectors of all its n-grams; a
language's prototype bundles those of all its training texts. A text gets the language whose
prototype has the largest cosine with it, after the mean prototype has been taken off both.

Bundles are sums of integers, so they don't depend on the order of the work. Training adds n-gram
counts by language in tasks and bundles them there; Spark adds up one vector a language and task. A
prediction needs no shuffle; prototypes of at most ``MOST_LANGUAGES`` languages go to the tasks.

Defined results: a null text and one without a letter are ``und`` with score 0, and so is every text
if nothing was learned; a null language isn't learned from; of equal cosines the first language by
name counts; rows are handled alone, repeated ones count as often as they occur; an empty table gives
an empty one; extra columns are kept, and one that bears an added name is replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, mix64, small_batches, text_blocks

DIM = 1024
GRAM = 3
MOST_LANGUAGES = 4096
#: Code points of a long text that are handled at a time, and (language, n-gram) counts that a task keeps.
PART = 1 << 19
MOST_COUNTS = 1 << 18
#: Cells of a dense table of counts by document and n-gram.
CELLS = 1 << 21
GAP = 0x20
_BITS = 21


class _Letters:
    """By code point: the letter it stands for (its lower case, GAP if none), and whether it is a letter; filled as met."""

    table = np.full(0x110000, -1, np.int32)
    letter = np.zeros(0x110000, bool)

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        out = cls.table[points]
        if len(points) and out.min() < 0:
            for p in np.unique(points[out < 0]).tolist():
                c = chr(p)
                kind = unicodedata.category(c)[0]
                cls.table[p] = ord(c.lower()[0]) if kind in "LM" else GAP
                cls.letter[p] = kind == "L"
            out = cls.table[points]
        return out


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """+1 and -1 by code point, from hashes of (code point, place / 64)."""
    words = mix64(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + mix64(np.arange(1, dim // 64 + 1, dtype=np.uint64)))
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bound vectors of packed n-grams (int8)."""
    out = None
    for k in range(GRAM):  # the last letter first, not permuted
        points, at = np.unique((grams >> (_BITS * k)) & ((1 << _BITS) - 1), return_inverse=True)
        v = np.roll(letter_vectors(points, dim), k, axis=1)[at]
        out = v if out is None else out * v
    return out


def packed_grams(points: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each document's letters, with gaps around it, packed into 63 bits, and their documents."""
    # A gap before each document; those that follow a gap go, so one before and one after each word is left.
    edge = np.searchsorted(doc, np.arange(docs + 1))
    letters = np.insert(points, edge[:-1], GAP)
    owner = np.insert(doc, edge[:-1], np.arange(docs))
    letters, owner = np.append(letters, GAP), np.append(owner, docs)
    keep = letters != GAP
    keep[1:] |= letters[:-1] != GAP
    keep[0] = True
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    keep |= first
    letters, owner = letters[keep].astype(np.int64), owner[keep]
    out = letters[: len(letters) - GRAM + 1]
    for k in range(1, GRAM):
        out = (out << _BITS) | letters[k : len(letters) - GRAM + 1 + k]
    inside = owner[: len(out)]
    # The last letter of an n-gram may be the gap before the next document, no more of it.
    ok = (owner[GRAM - 2 : GRAM - 2 + len(out)] == inside) & (letters[GRAM - 2 : GRAM - 2 + len(out)] != GAP)
    return out[ok], inside[ok]


def _points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block, and each document's range of them."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    return points, heads[block.offsets]


def block_grams(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents of a block: the run's (documents, has a letter, n-grams, their place among the documents).

    A long document comes in several parts, which overlap by what an n-gram needs.
    """
    points, bounds = _points(block)
    letters = _Letters.of(points)
    for i, j in _runs(bounds):
        if j - i == 1 and bounds[j] - bounds[i] > PART:
            a = int(bounds[i])
            while a < bounds[j]:
                b = min(a + PART, int(bounds[j]))
                # A part ends behind a word, so that no n-gram is lost; a run of letters without a gap makes it longer.
                gap = np.flatnonzero(letters[b : bounds[j]] == GAP)
                b = b + int(gap[0]) + 1 if len(gap) else int(bounds[j])
                grams, at = packed_grams(letters[a:b], np.zeros(b - a, np.int64), 1)
                yield np.array([i]), np.array([_Letters.letter[points[a:b]].any()]), grams, at
                a = b
            continue
        part = slice(int(bounds[i]), int(bounds[j]))
        doc = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
        has = np.zeros(j - i, bool)
        has[doc[_Letters.letter[points[part]]]] = True
        grams, at = packed_grams(letters[part], doc, j - i)
        yield np.arange(i, j), has, grams, at


def _runs(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of some PART / 2 code points, so that tables by document and n-gram stay small."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + PART // 2, side="right")) - 1
        j = min(max(j, i + 1), n, i + 4096)
        yield i, j
        i = j


def distinct_grams(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams, and for each n-gram which it is; by a table where the letters are few."""
    letters = np.unique(np.concatenate([grams >> (2 * _BITS), grams & ((1 << _BITS) - 1)])) if len(grams) else grams
    k = len(letters)
    if GRAM == 3 and 0 < k <= 80:
        middle = (grams >> _BITS) & ((1 << _BITS) - 1)
        number = np.full(int(letters[-1]) + 1, -1, np.int64)
        number[letters] = np.arange(k)
        if middle.max() <= letters[-1] and number[middle].min() >= 0:
            small = (number[grams >> (2 * _BITS)] * k + number[middle]) * k + number[grams & ((1 << _BITS) - 1)]
            used = np.flatnonzero(np.bincount(small, minlength=k**3))
            which = np.zeros(k**3, np.int64)
            which[used] = np.arange(len(used))
            packed = (letters[used // (k * k)] << (2 * _BITS)) | (letters[used // k % k] << _BITS) | letters[used % k]
            return packed, which[small]
    return np.unique(grams, return_inverse=True)


def text_vectors(grams: np.ndarray, at: np.ndarray, docs: int, dim: int = DIM) -> np.ndarray:
    """Bundles of the n-grams of each of ``docs`` documents (float32; exact, as sums stay under 2**24)."""
    out = np.zeros((docs, dim), np.float32)
    packed, which = distinct_grams(grams)
    wide = max(1, CELLS // max(docs, 1))
    for a in range(0, len(packed), wide):
        b = min(a + wide, len(packed))
        some = slice(None) if b - a == len(packed) else (which >= a) & (which < b)
        counts = np.bincount(at[some] * (b - a) + which[some] - a, minlength=docs * (b - a)).reshape(docs, b - a)
        out += counts.astype(np.float32) @ gram_vectors(packed[a:b], dim).astype(np.float32)
    return out


class Prototypes:
    """Languages in order, their mean-free prototypes of length one, and the mean."""

    def __init__(self, bundles: dict[str, np.ndarray]) -> None:
        self.languages = sorted(bundles)
        m = np.stack([bundles[k] for k in self.languages]).astype(np.float64) if bundles else np.zeros((0, DIM))
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        self.mean = m.mean(axis=0) if len(m) > 1 else np.zeros(m.shape[1])
        m = m - self.mean
        self.unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and (1 + cosine) / 2 for each bundle."""
        v = vectors.astype(np.float64)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) - self.mean
        cos = (v @ self.unit.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        pick = np.round(cos, 12).argmax(axis=1)
        return pick, np.clip((1 + cos[np.arange(len(cos)), pick]) / 2, 0, 1)


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", most_languages: int = MOST_LANGUAGES) -> Prototypes:
    """Prototypes of all languages of ``docs``, from whole texts; more than ``most_languages`` are refused."""

    def bundle(lang_at: np.ndarray, grams: np.ndarray, n: np.ndarray, into: dict[int, np.ndarray]) -> None:
        for k in np.unique(lang_at).tolist():
            mine = np.flatnonzero(lang_at == k)
            total = into.setdefault(k, np.zeros(DIM, np.int64))
            for a in range(0, len(mine), 4096):
                some = mine[a : a + 4096]
                total += (n[some].astype(np.float64) @ gram_vectors(grams[some]).astype(np.float64)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        number: dict[str, int] = {}
        sums: dict[int, np.ndarray] = {}
        held = [np.zeros(0, np.int64)] * 3

        def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            lang_at, grams, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((grams, lang_at))
            lang_at, grams, n = lang_at[order], grams[order], n[order]
            new = np.ones(len(n), bool)
            new[1:] = (lang_at[1:] != lang_at[:-1]) | (grams[1:] != grams[:-1])
            first = np.flatnonzero(new)
            return [lang_at[first], grams[first], np.add.reduceat(n, first) if len(first) else n]

        parts: list[list[np.ndarray]] = []
        for b in text_blocks(batches, text):
            mine = []
            for x in b.rows.column(b.rows.schema.get_field_index(lang)).to_pylist():
                if x not in number:
                    number[x] = len(names)
                    names.append(x)
                mine.append(number[x])
            of = np.array(mine, np.int64)
            for docs_, _, grams, at in block_grams(b):
                packed, which = distinct_grams(grams)
                code, pos = np.unique(of[docs_], return_inverse=True)
                counts = np.bincount(pos[at] * max(1, len(packed)) + which, minlength=len(code) * len(packed))
                some = np.flatnonzero(counts)
                parts.append([code[some // max(1, len(packed))], packed[some % max(1, len(packed))], counts[some]])
            if sum(len(p[0]) for p in parts) + len(held[0]) > MOST_COUNTS:
                held, parts = merged([held, *parts]), []
                if len(held[0]) > MOST_COUNTS // 2:
                    bundle(*held, sums)
                    held = [np.zeros(0, np.int64)] * 3
        bundle(*merged([held, *parts]), sums)
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([names[k]] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(total)], ["lang", "i", "v"])

    learned = small_batches(docs).where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    text, lang = "text", "lang"
    sums = learned.mapInArrow(run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("v"))
    rows = vectors.where(F.exists("v", lambda c: c != 0)).limit(most_languages + 1).collect()
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    return Prototypes({r.lang: np.array(r.v) for r in rows})


def predict_languages(docs: DataFrame, model: Prototypes, text: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred and score."""
    new = {"lang_pred", "score", text.lower()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = pa.array([*model.languages, "und"], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, text):
            pick, score = np.full(len(b), len(model.languages)), np.zeros(len(b))
            long_, seen = None, False  # of a document in parts: its bundle so far, and whether it has a letter
            last = -1
            for docs_, has, grams, at in block_grams(b):
                v = text_vectors(grams, at, len(docs_)).astype(np.float64)
                if len(docs_) == 1 and docs_[0] == last:
                    v, has = v + long_, has | seen
                last, long_, seen = int(docs_[0]) if len(docs_) == 1 else -1, v, has
                if model.languages:
                    best, s = model.best(v)
                    pick[docs_], score[docs_] = np.where(has, best, len(model.languages)), np.where(has, s, 0.0)
            cols = [b.rows.column(b.rows.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, names.take(pa.array(pick)), pa.array(score)], schema.names)

    return small_batches(docs).mapInArrow(run, schema)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose fold isn't 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.where(fold() != 2).select("text", "lang"))
    held = docs.select("doc_id", (fold() == 2).alias("held_out"), "text")
    return predict_languages(held, model)
