"""Toxicity: a convolutional text classifier in numpy, with decision thresholds by language.

A word's vector is the sum of hashed embeddings of the word and of its first 4 and 6 bytes. Filters
of several widths run over each whole text, their maxima are pooled, and a dense layer gives the
probability. Only embeddings of buckets that two training texts hold are trained; others are zero.
The model is fitted in the driver on at most ``sample_rows`` labelled rows (those with the smallest
hash of their id), ``sample_bytes`` of their text (one text an id) and at most four fifths of all; scoring covers all rows and whole texts, in tasks,
without a shuffle. Every labelled row that wasn't fitted counts for its language's threshold: Spark
scores it and adds it up by (language, score bin, toxic).

Defined results: null and empty texts score like a text without words; a label row that lacks its
document, or whose label is null, is not used; a repeated label row counts as often as it occurs;
without any usable label every score is 0.5 and no text is rejected; a null or unseen language, and
one with fewer than three toxic or three clean rows to count, takes the threshold 0.5. Extra columns are kept, and one that bears an added name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, free_name, mix64, prefix_hash, small_batches, span_hash, text_blocks, words

SAMPLE_ROWS = 6000
SAMPLE_BYTES = 96 << 20
#: A power of two, so that a score is in bin k or above exactly if it is k / BINS or more.
BINS = 1024
BUCKET_BITS, DIM, FILTERS, WIDTHS = 17, 8, 8, (1, 2, 3)
PAD = max(WIDTHS) - 1


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def word_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Three bucket numbers a word, and each document's range of words."""
    w = words(block)
    sums = prefix_hash(w.data)
    cols = [span_hash(sums, w.start, w.end)]
    for k in (4, 6):
        cols.append(mix64(span_hash(sums, w.start, np.minimum(w.end, w.start + k)) + np.uint64(k)))
    return (np.stack(cols, axis=1) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), w.first


class TextCNN:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.table = np.zeros((1 << BUCKET_BITS, DIM), np.float32)
        self.conv = [rng.normal(0, 0.4, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.dense = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)
        self.thresholds: dict[str, float] = {}

    def _layout(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each word when PAD empty rows follow each document, and each document's first row."""
        n = np.diff(first)
        start = np.concatenate([[0], np.cumsum(n + PAD)])
        return np.arange(first[-1]) + np.repeat(start[:-1] - first[:-1], n), start

    def pooled(self, ids: np.ndarray, first: np.ndarray, where: bool = False):
        at, start = self._layout(first)
        rows = int(start[-1])
        vec = np.zeros((rows + PAD, DIM), np.float32)
        for c in range(ids.shape[1]):
            vec[at] += self.table[ids[:, c]]
        outside = np.ones(rows, bool)
        outside[at] = False
        out, spots = [], []
        for k, weights, bias in zip(WIDTHS, self.conv, self.bias, strict=True):
            z = vec[:rows] @ weights[0]
            for j in range(1, k):
                z += vec[j : rows + j] @ weights[j]
            z[outside] = -1e9
            best = np.maximum.reduceat(z, start[:-1], axis=0)
            out.append(np.maximum(best + bias, 0))
            if where:
                row = np.arange(rows)[:, None]
                spots.append(np.minimum.reduceat(np.where(z == best[np.repeat(np.arange(len(first) - 1), np.diff(start))], row, rows), start[:-1], axis=0))
        return np.concatenate(out, axis=1), (vec, at, spots)

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        logit = self.pooled(ids, first)[0] @ self.dense + self.shift
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))

    def fit(self, docs: list[np.ndarray], toxic: np.ndarray, epochs: int | None = None, batch: int = 32, rate: float = 0.08, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        seen = np.zeros(1 << BUCKET_BITS, np.int32)
        for d in docs:
            seen[np.unique(d)] += 1
        trained = seen >= 2
        self.table[trained] = rng.normal(0, 0.05, (int(trained.sum()), DIM))
        rate_sum = {k: np.full_like(v, 1e-3) for k, v in (("table", self.table), ("dense", self.dense), ("bias", self.bias))}
        conv_sum = [np.full_like(c, 1e-3) for c in self.conv]
        shift_sum = 1e-3
        for _ in range(epochs or min(40, max(4, -(-20_000 // len(docs))))):
            order = rng.permutation(len(docs))
            for b in range(0, len(order), batch):
                pick = order[b : b + batch]
                ids = np.concatenate([docs[i] for i in pick])
                first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
                pool, (vec, at, spots) = self.pooled(ids, first, where=True)
                p = 1 / (1 + np.exp(-(pool @ self.dense + self.shift)))
                err = ((p - toxic[pick]) / len(pick)).astype(np.float32)
                g_dense = pool.T @ err
                g_pool = np.outer(err, self.dense) * (pool > 0)
                word_at = np.full(len(vec), -1, np.int64)
                word_at[at] = np.arange(len(at))
                moved, pulls = [], []
                for w, (k, weights) in enumerate(zip(WIDTHS, self.conv, strict=True)):
                    g = g_pool[:, w * FILTERS : (w + 1) * FILTERS]
                    d, f = np.nonzero(g)
                    pull = g[d, f][:, None]
                    g_conv = np.zeros_like(weights)
                    for j in range(k):
                        spot = spots[w][d, f] + j
                        part = np.zeros((FILTERS, DIM), np.float32)
                        np.add.at(part, f, pull * vec[spot])
                        g_conv[j] = part.T
                        moved.append(spot)
                        pulls.append(pull * weights[j].T[f])
                    conv_sum[w] += g_conv**2
                    weights -= rate * g_conv / np.sqrt(conv_sum[w])
                    g_bias = g.sum(0)
                    rate_sum["bias"][w] += g_bias**2
                    self.bias[w] -= rate * g_bias / np.sqrt(rate_sum["bias"][w])
                rate_sum["dense"] += g_dense**2
                self.dense -= rate * g_dense / np.sqrt(rate_sum["dense"])
                shift_sum += float(err.sum()) ** 2
                self.shift -= np.float32(rate * float(err.sum()) / shift_sum**0.5)
                rows, pull = np.concatenate(moved), np.concatenate(pulls)
                word = np.where(rows < len(word_at), word_at[np.minimum(rows, len(word_at) - 1)], -1)
                bucket, pull = ids[word[word >= 0]].ravel(), np.repeat(pull[word >= 0], ids.shape[1], axis=0)
                bucket, pull = bucket[trained[bucket]], pull[trained[bucket]]
                one, at = np.unique(bucket, return_inverse=True)
                g_table = np.zeros((len(one), DIM), np.float32)
                np.add.at(g_table, at, pull)
                rate_sum["table"][one] += g_table**2
                self.table[one] -= rate * g_table / np.sqrt(rate_sum["table"][one])

    def calibrate(self, counts: Iterable[tuple[str, int, int, int]]) -> None:
        """By language the threshold with the fewest errors, the nearest to 0.5; from (lang, bin, toxic, n)."""
        groups: dict[str, np.ndarray] = {}
        for name, at, toxic, n in counts:
            groups.setdefault(name, np.zeros((2, BINS), np.int64))[toxic, at] += n
        for name, (clean, toxic) in groups.items():
            if min(clean.sum(), toxic.sum()) < 3:
                continue
            errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
            best = np.flatnonzero(errors == errors.min()) / BINS
            near = best[np.argmin(np.abs(best - 0.5))]
            self.thresholds[name] = float(np.clip(near, 0.05, 0.95))


def _sample(docs: DataFrame, picked: DataFrame, sample_bytes: int) -> pa.Table:
    """doc_id, toxic, text, lang of the picked labels; one text an id, by hash, and ``sample_bytes`` of text at most."""
    found = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))).alias("x"))
    sizes = found.select("doc_id", "toxic", "x.h", "x.n").toArrow().to_pandas().sort_values(["doc_id", "toxic"])
    order = sizes.assign(o=mix64(sizes["doc_id"].to_numpy(np.int64).view(np.uint64))).sort_values("o")
    ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(order["doc_id"][order["n"].cumsum() <= sample_bytes].unique(), pa.int64())}))
    texts = docs.join(F.broadcast(ids), "doc_id").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("x"))
    return texts.select("doc_id", "toxic", "x.text", "x.lang").toArrow()


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> TextCNN | None:
    """The classifier, learned from at most ``sample_rows`` labelled rows with ``sample_bytes`` of text for
    which ``usable`` holds; the others calibrate it."""
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if usable is not None:
        picked = picked.where(usable)
    known = picked.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = known.count()
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "toxic").limit(min(sample_rows, n - n // 5))
    lang = "lang" if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    rows = _sample(docs.select("doc_id", "text", lang), picked, sample_bytes)
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    texts: list[np.ndarray] = []
    for b in text_blocks(iter(rows.combine_chunks().to_batches())):
        ids, first = word_features(b)
        texts += [ids[first[i] : first[i + 1]] for i in range(len(b))]
    toxic = rows.column("toxic").to_numpy().astype(np.float32)
    # The driver keeps neither texts nor their features longer than it needs them.
    del rows, b, ids
    pa.default_memory_pool().release_unused()
    model = TextCNN()
    model.fit(texts, toxic)
    texts.clear()
    # Scored before the join, so that no text is shuffled.
    scored = score_toxicity(docs.select("doc_id", "text", lang).where("doc_id IS NOT NULL AND lang IS NOT NULL"), model)
    scored = scored.select("doc_id", "lang", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    rest = known.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_anti")
    model.calibrate(map(tuple, scored.join(rest, "doc_id").groupBy("lang", "bin", "toxic").count().collect()))
    return model


def score_toxicity(df: DataFrame, model: TextCNN | None, text: str = "text", keep_text: bool = False, prefix: str = "") -> DataFrame:
    """Add ``score``, ``predicted`` (score >= 0.5), ``threshold`` (of the row's language) and ``rejected``, their names behind ``prefix``."""
    fields = [T.StructField(prefix + name, kind) for name, kind in (("score", T.DoubleType()), ("predicted", T.IntegerType()), ("threshold", T.DoubleType()), ("rejected", T.BooleanType()))]
    new = {f.name for f in fields} | (set() if keep_text else {text})
    kept = [f for f in df.schema.fields if f.name not in new]
    shared = small_batches(df).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in text_blocks(batches, text, 1 << 18):
            score = m.scores(*word_features(b)) if m is not None else np.full(len(b), 0.5)
            at = b.rows.schema.get_field_index("lang")
            langs = b.rows.column(at).to_pylist() if at >= 0 else [None] * len(b)
            limit = np.array([m.thresholds.get(x, 0.5) if m is not None else 0.5 for x in langs])
            out = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(limit, pa.float64()), pa.array((score >= limit) & (m is not None))]
            yield pa.RecordBatch.from_arrays([b.rows.column(b.rows.schema.get_field_index(f.name)) for f in kept] + out, [f.name for f in kept + fields])

    return df.mapInArrow(run, T.StructType(kept + fields))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold of their language; all columns are kept."""
    prefix = free_name(docs, "toxicity_")
    return score_toxicity(docs, fit_toxicity(docs, labels), keep_text=True, prefix=prefix).where(~F.col(f"{prefix}rejected")).select(docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text; learned without the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, usable=fold() != 0)
    return score_toxicity(docs, model).withColumn("held_out", fold() == 0).select("doc_id", "held_out", "score", "predicted", "threshold", "rejected")


