"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The tokens of the vocabulary (words that occur often enough, the end of a text, and one token for
all others) have a context vector and a target vector. The vectors of the three tokens before, each
times a matrix of its position, add up to the predicted vector; its products with the target vectors
are the logits. Words are cut into some sqrt(V) classes, so that products of whole batches of
predicted vectors with all classes, and with all words of a class, give exactly normalised
log-probabilities. A word outside the vocabulary gets the probability of the token for others times
its smoothed share of them, for which the counts of all training words are used; that share leaves
half a count for words never seen, as the base does.

Noise-contrastive estimation runs in tasks over every token of all training documents, for the class
and for the word within it: each token is learned from in one of the rounds (small corpora pass over
theirs many times), and Spark averages the parameters after each round. A batch's tokens are sorted
by class, and those of a class share its noise words, so that the work is done by matrix products. The vocabulary holds every word that occurs ``LEAST`` times and makes up 1 / ``SHARE`` of
all tokens, so it has ``SHARE`` words at most (17 MB of parameters), whatever the input. The ``KNOWN``
most frequent words' counts are broadcast; the counts of all other words are joined.

Defined results: null and empty texts are one end token; a null doc_id counts as an empty text for
the fold; repeated rows are scored alike; without training documents every token has its share of
the half counts alone; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import small_batches, stored, text_blocks, words

KNOWN = 1 << 19
#: A word is in the vocabulary if it occurs LEAST times and makes up 1 / SHARE of all training tokens, so there are SHARE words at most.
LEAST, SHARE = 8, 1 << 17
DIM, CONTEXT, ROUNDS = 16, 3, 2
#: Each training token is learned from once, and small corpora MORE / tokens times more.
MORE = 1_500_000
#: Tokens of a batch, of which a block has some eight; gradients add up in units of LEAST_BATCH tokens.
LEAST_BATCH, MOST_BATCH = 256, 8192
NOISE_CLASSES, NOISE_WORDS = 24, 8
FLUSH_BYTES = 16 << 20
OTHER, END = 0, 1
END_HASH = np.uint64(0x9D5F3A7E21C4B680)


@dataclass
class Lexicon:
    """Hashes in order, their counts and model ids, and the totals of all training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    tokens: int
    distinct: int
    size: int

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def model_ids(self, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, self.ids[at], OTHER) if len(self.ids) else np.zeros(len(at), np.int64)


def word_counts(train: DataFrame) -> DataFrame:
    """(h, c): count of each word hash, and of the end token under its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = docs = 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.append(h, END_HASH).view(np.int64)), pa.array(np.append(c, docs).astype(np.int64))], ["h", "c"])

        for b in text_blocks(batches):
            parts.append(words(b).hashes())
            size, docs = size + len(b.data), docs + len(b)
            if size >= FLUSH_BYTES:
                yield flush()
                parts, size, docs = [], 0, 0
        if docs:
            yield flush()

    return stored(train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")


def lexicon(counts: DataFrame, known: int = KNOWN, least: int = LEAST, share: int = SHARE) -> Lexicon:
    """The known words, found by a threshold from a histogram of the counts, so that no task sorts them all."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    end = F.col("h") == F.lit(int(END_HASH.view(np.int64)))
    # Words by (rounded logarithm of the) count, then by 64 classes of their hash: whole cells fit under ``known``.
    cell = F.struct((-F.floor(8 * F.log2("c"))).alias("level"), F.pmod("h", F.lit(64)).alias("part"))
    cells = counts.where(~end).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    room, last = known, (1, 0)
    for x in sorted(cells, key=lambda x: (x["cell"]["level"], x["cell"]["part"])):
        room -= x["n"]
        if room < 0:
            break
        last = (x["cell"]["level"], x["cell"]["part"])
    top = counts.where(~end & (cell <= F.struct(F.lit(last[0]).cast("long").alias("level"), F.lit(last[1]).cast("long").alias("part")))).toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    ends = counts.where(end).toArrow()
    h, c = (np.concatenate([top.column(x).to_numpy(), ends.column(x).to_numpy()]) for x in ("h", "c"))
    h = h.view(np.uint64)
    ids = np.zeros(len(h), np.int64)
    words_ = np.flatnonzero((h != END_HASH) & (c >= max(least, -(-int(total["n"]) // share))))
    ids[words_] = np.arange(len(words_)) + 2
    ids[h == END_HASH] = END
    order = np.argsort(h)
    return Lexicon(h[order], c[order], ids[order], int(total["n"]), int(total["v"]), len(words_) + 2)


def _tokens(w, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Model ids of all tokens of a block (the words and one end a document), each document's first one,
    the tokens before each (END before a document), and the words' lookups."""
    at, there = lex.find(w.hashes())
    n = np.diff(w.first)
    first = w.first + np.arange(len(w.first))
    ids = np.full(first[-1], END, np.int64)
    place = np.arange(w.first[-1]) + np.repeat(np.arange(len(n)), n)
    ids[place] = lex.model_ids(at, there)
    before = np.full((len(ids), CONTEXT), END, np.int64)
    inner = np.arange(len(ids)) - np.repeat(first[:-1], n + 1)
    for k in range(CONTEXT):
        ok = np.flatnonzero(inner > k)
        before[ok, k] = ids[ok - k - 1]
    return ids, first, before, at, there


class LogBilinear:
    """r = sum over the tokens before of E[token] C[position]; logit of a class r . S + s, of a word in it r . T + b.

    Words are ordered by frequency and cut into classes of about equal sums of the square roots of
    their counts. P(word) = P(class) P(word in its class), both normalised by matrix products.
    """

    def __init__(self, counts: np.ndarray, dim: int = DIM, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        v = len(counts)
        mass = counts + 0.5
        self.order = np.argsort(-mass, kind="stable")
        root = np.cumsum(np.sqrt(mass[self.order]))
        classes = max(1, round(v**0.5))
        of = np.minimum((root / root[-1] * classes).astype(np.int64), classes - 1)
        of = np.unique(of, return_inverse=True)[1]
        self.rank = np.empty(v, np.int64)  # place of a word in the order, in which classes are runs
        self.rank[self.order] = np.arange(v)
        self.cls = of[self.rank]
        self.first = np.searchsorted(of, np.arange(of[-1] + 2))
        mass = mass[self.order]
        self.class_q = np.add.reduceat(mass, self.first[:-1]) / mass.sum()
        self.word_q = mass / (self.class_q * mass.sum())[of]  # within the class, in order
        f = np.float32
        self.params = {
            "E": rng.normal(0, 0.1, (v, dim)).astype(f), "C": np.stack([np.eye(dim) * x for x in (0.6, 0.3, 0.2, *[0.1] * CONTEXT)[:CONTEXT]]).astype(f),
            "S": rng.normal(0, 0.1, (len(self.class_q), dim)).astype(f), "s": np.log(self.class_q).astype(f),
            "T": rng.normal(0, 0.1, (v, dim)).astype(f), "b": np.log(self.word_q).astype(f),
        }
        self.cum = np.concatenate([[0.0], np.cumsum(self.word_q)])  # of all classes one behind the other
        self.class_cum = np.cumsum(self.class_q)
        self.class_noise, self.word_noise = np.log(NOISE_CLASSES * self.class_q).astype(f), np.log(NOISE_WORDS * self.word_q).astype(f)
        self.sums: dict[str, np.ndarray] = {}

    def context(self, before: np.ndarray) -> np.ndarray:
        p = self.params
        return sum(p["E"][before[:, k]] @ p["C"][k] for k in range(CONTEXT))

    def _step(self, name: str, rows: np.ndarray | slice, grad: np.ndarray, rate: float) -> None:
        """Adagrad on some rows, each there once."""
        p = self.params[name]
        s = self.sums.setdefault(name, np.full(p.shape, 1e-2, np.float32))
        now = s[rows] + grad * grad
        s[rows] = now
        p[rows] += np.float32(rate) * grad / np.sqrt(now)

    def _added(self, rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows and the sums of their gradients."""
        rows = rows.astype(np.uint16 if len(self.rank) <= 1 << 16 else np.uint32)  # sorted by radix
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = _runs(rows)
        return rows[first].astype(np.int64), np.add.reduceat(grad[order], first, axis=0)

    def learn(self, before: np.ndarray, target: np.ndarray, rng: np.random.Generator, rate: float = 0.15) -> None:
        """One step of noise-contrastive estimation on a batch, for the class and for the word within it."""
        p, n, one = self.params, len(target), np.float32(1 / LEAST_BATCH)
        sig = lambda z: 0.5 + 0.5 * np.tanh(0.5 * z)
        order = np.argsort(self.cls[target], kind="stable")
        before, target = before[order], target[order]
        c, w = self.cls[target], self.rank[target]
        first = _runs(c)
        own = c[first]  # the batch's classes, whose tokens are runs
        r = self.context(before)
        S, s = p["S"], p["s"] - self.class_noise
        x = np.minimum(np.searchsorted(self.class_cum, rng.random(NOISE_CLASSES)), len(self.class_q) - 1)
        up = (1 - sig(np.einsum("nd,nd->n", r, S[c]) + s[c])) * one
        down = sig(r @ S[x].T + s[x]) * one
        g_r = up[:, None] * S[c] - down @ S[x]
        g_S, g_s = np.zeros_like(S), np.zeros_like(s)
        g_S[own], g_s[own] = np.add.reduceat(up[:, None] * r, first, axis=0), np.add.reduceat(up, first)
        np.subtract.at(g_S, x, down.T @ r)
        np.subtract.at(g_s, x, down.sum(0))
        T, b = p["T"], p["b"]
        low, high = self.cum[self.first[own]], self.cum[self.first[own + 1]]
        y = np.searchsorted(self.cum[1:], low[:, None] + rng.random((len(own), NOISE_WORDS)) * (high - low)[:, None])
        y = np.clip(y, self.first[own][:, None], self.first[own + 1][:, None] - 1)
        T_w, T_y, b_y = T[w], T[y], b[y] - self.word_noise[y]
        up = (1 - sig(np.einsum("nd,nd->n", r, T_w) + b[w] - self.word_noise[w])) * one
        g_r += up[:, None] * T_w
        grad = np.empty((n + y.size, T.shape[1] + 1), np.float32)
        grad[:n, :-1], grad[:n, -1] = up[:, None] * r, up
        noise = grad[n:].reshape(*y.shape, -1)
        for k, (lo, hi) in enumerate(zip(first.tolist(), [*first[1:].tolist(), n], strict=True)):
            down = sig(r[lo:hi] @ T_y[k].T + b_y[k]) * one
            g_r[lo:hi] -= down @ T_y[k]
            noise[k, :, :-1], noise[k, :, -1] = -(down.T @ r[lo:hi]), -down.sum(0)
        rows, grad = self._added(np.concatenate([w, y.ravel()]), grad)
        g_C = np.stack([p["E"][before[:, k]].T @ g_r for k in range(CONTEXT)])
        rows_e, grad_e = self._added(before.T.ravel(), np.concatenate([g_r @ p["C"][k].T for k in range(CONTEXT)]))
        every = slice(None)
        for name, at, g in (("S", every, g_S), ("s", every, g_s), ("T", rows, grad[:, :-1]), ("b", rows, grad[:, -1]), ("E", rows_e, grad_e), ("C", every, g_C)):
            self._step(name, at, g, rate)

    def learn_all(self, before: np.ndarray, ids: np.ndarray, number: int, rounds: int, passes: float, rng: np.random.Generator) -> int:
        """Learn from every token of a block whose turn is round ``number``, ``passes`` times (at least once); the number learned from."""
        pool = np.arange(number, len(ids), rounds)
        batch, learned = min(MOST_BATCH, max(LEAST_BATCH, len(pool) // 8)), 0
        while passes > 0 and len(pool):
            pick = rng.permutation(pool)
            if passes < 1:
                pick = pick[: int(passes * len(pool) + rng.random())]
            for lo in range(0, len(pick), batch):
                at = pick[lo : lo + batch]
                self.learn(before[at], ids[at], rng)
            learned, passes = learned + len(pick), passes - 1
        return learned

    def log_probabilities(self, before: np.ndarray, target: np.ndarray, batch: int = 4096) -> np.ndarray:
        """Natural log P(target | tokens before), normalised, in batches of contexts against all classes,
        then, class by class, against all words of the class."""
        p, out = self.params, np.empty(len(target))
        r = np.empty((len(target), p["E"].shape[1]), np.float32)
        cls, rank = self.cls[target], self.rank[target]
        for lo in range(0, len(target), batch):
            cut = slice(lo, lo + batch)
            r[cut] = self.context(before[cut])
            out[cut] = _log_softmax_at(r[cut] @ p["S"].T + p["s"], cls[cut])
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(len(self.first)))
        for c in np.flatnonzero(np.diff(edge)):
            words_ = slice(self.first[c], self.first[c + 1])
            step = max(64, (1 << 20) // (self.first[c + 1] - self.first[c]))
            for lo in range(edge[c], edge[c + 1], step):
                at = order[lo : min(lo + step, edge[c + 1])]
                out[at] += _log_softmax_at(r[at] @ p["T"][words_].T + p["b"][words_], rank[at] - self.first[c])
        return out


def _runs(x: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), at].astype(np.float64)
    return own - np.log(np.exp(z, out=z).sum(axis=1, dtype=np.float64))


def train(learn: DataFrame, lex: Lexicon, counts: np.ndarray, rounds: int = ROUNDS) -> LogBilinear:
    """The model, fitted in tasks on all tokens of all training documents and averaged after each round.

    Each round takes every ``rounds``-th token of each block, with the tokens before it. Tasks give their
    parameters in pieces of 64K numbers with the number of tokens they learned from; Spark adds the
    pieces up, piece by piece.
    """
    model = LogBilinear(counts)
    passes = 1 + MORE / max(1, lex.tokens)
    sc = learn.sparkSession.sparkContext
    piece = 1 << 16
    shapes = {k: v.shape for k, v in model.params.items()}

    def pieces(params: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([params[k].ravel() for k in shapes])

    for number in range(rounds):
        shared = sc.broadcast((lex, model.params))

        def run(batches: Iterator[pa.RecordBatch], number: int = number, shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            lex, params = shared.value
            mine = LogBilinear(counts)
            mine.params = {k: v.copy() for k, v in params.items()}
            rng = np.random.default_rng([number, TaskContext.get().partitionId()])
            learned = 0
            for b in text_blocks(batches):
                ids, _, before, _, _ = _tokens(words(b), lex)
                learned += mine.learn_all(before, ids, number, rounds, passes, rng)
            if learned:
                flat = pieces(mine.params)
                parts = [flat[lo : lo + piece] for lo in range(0, len(flat), piece)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(learned)] * len(parts)), pa.array([x.tobytes() for x in parts], pa.binary())], ["piece", "weight", "numbers"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}  # the pieces dealt to this task, each one array
            for b in batches:
                for k, weight, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    x = np.frombuffer(raw, np.float32).astype(np.float64) * weight
                    if k in held:
                        held[k][0] += weight
                        held[k][1] += x
                    else:
                        held[k] = [weight, x]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x[0] for x in held.values()]), pa.array([(x[1] / x[0]).astype(np.float32).tobytes() for x in held.values()], pa.binary())], ["piece", "weight", "numbers"])

        schema = "piece int, weight double, numbers binary"
        got = learn.select("text").mapInArrow(run, schema).repartition("piece").mapInArrow(add, schema).toArrow().to_pylist()
        if not got:
            break
        flat = np.concatenate([np.frombuffer(x["numbers"], np.float32) for x in sorted(got, key=lambda x: x["piece"])])
        at = 0
        for k, shape in shapes.items():
            size = int(np.prod(shape))
            model.params[k] = flat[at : at + size].reshape(shape).copy()
            at += size
    return model


def score_texts(docs: DataFrame, train_on: Column, known: int = KNOWN, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    docs = small_batches(docs).select("doc_id", "text", (~train_on).alias("held_out"))
    learn = docs.where(~F.col("held_out"))
    counts = word_counts(learn)
    lex = lexicon(counts, known, least, share)
    in_model = lex.ids > 0
    other_tokens = lex.tokens - int(lex.counts[in_model].sum())
    other_words = lex.distinct - int(in_model.sum())
    own = np.zeros(lex.size)
    own[OTHER] = other_tokens
    own[lex.ids[in_model]] = lex.counts[in_model]
    model = train(learn, lex, own)
    model.sums = {}
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))
    base_norm = float(np.log10(lex.tokens + 0.5 * (lex.distinct + 1)))
    other_norm = float(np.log10(other_tokens + 0.5 * (other_words + 1)))
    end_count = int(lex.counts[lex.hashes == END_HASH].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        logs = np.log10(lex.counts + 0.5)
        end_log = float(np.log10(end_count + 0.5))
        for b in text_blocks(batches):
            w = words(b)
            h = w.hashes()
            ids, first, before, at, there = _tokens(w, lex)
            each = logs[at] * there if len(logs) else np.zeros(len(at))
            by_doc = lambda x, f=w.first: (s := np.concatenate([[0], np.cumsum(x)]))[f[1:]] - s[f[:-1]]
            n = np.diff(w.first)
            log_p = by_doc(model.log_probabilities(before, ids) / np.log(10), first)
            other = lex.model_ids(at, there) == OTHER
            rare, times = [], []
            for i in range(len(b)):
                a, e = w.first[i], w.first[i + 1]
                u, c = np.unique(h[a:e][~there[a:e]], return_counts=True)
                rare.append(u.view(np.int64))
                times.append(c)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rare])]).astype(np.int32)
            cat = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0, t)]).astype(t)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [b.rows.column(0), b.rows.column(2), b.rows.column(3), pa.array(n + 1, pa.int64()), pa.array(by_doc(there) + (end_count > 0), pa.int64()), pa.array(by_doc(each) + end_log), pa.array(log_p + by_doc(each * other)), pa.array(by_doc(other), pa.int64()), cat(rare, np.int64), cat(times, np.int32)],
                ["doc_id", "held_out", "row_id", "n_tokens", "n_known", "base", "model", "n_other", "rare", "times"],
            )

    part = docs.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(run, "doc_id long, held_out boolean, row_id long, n_tokens long, n_known long, base double, model double, n_other long, rare array<bigint>, times array<int>")
    part = stored(part, "lm-parts")
    tail = part.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_id", F.col("x.rare").alias("h"), F.col("x.times").alias("k"))
    tail = tail.join(counts, "h", "left").groupBy("row_id").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tail_known"))
    all_ = part.drop("rare", "times").join(tail, "row_id", "left").withColumn("tail", F.coalesce("tail", F.lit(0.0)))
    return all_.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail") - F.col("n_tokens") * base_norm).alias("base_score"), (F.col("model") + F.col("tail") - F.col("n_other") * other_norm).alias("score"),
    )


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts; learned from four of five folds."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold() != 1)
