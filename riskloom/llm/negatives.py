"""Hard negatives by exact inner-product search in cover trees.

Vectors are integers. A candidate x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest
norm of its tree, so that all lie on one sphere and the inner product with a query falls with the
distance. The rows are dealt to the nearest of a few pivots (the top level, from a bounded sample),
a pivot's rows to blocks of at most ``BLOCK_ROWS`` by a hash, and each block becomes a cover tree:
a node's points are spread over centres that lie far from each other, level by level, and each node
keeps the true covering radius of what lies under it. Radii bound all inner products under a node
from above and below; a best-first descent skips nodes whose bounds lie outside of what a query still
wants, and leaves are verified exactly.

Queries (anchors) are a Parquet table that every task reads in batches, one tree after the other: a
stated query set against all rows, in blocks, without a join. An anchor's own block is searched when
its tree is built, which gives a bound that prunes most of the other trees where the data have clusters.

Defined results: rows with a null id, label or vector or with a null or non-finite component take no
part; vectors are compared with those of the same length only; rows equal in id, label and vector
count once, other rows that share an id are rows of their own (ties by vector), and none of them is a
positive of another; an empty table gives an empty one; extra columns are not read. Scores have to
fit 64 bits, else ValueError.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import forget, stored

BLOCK_ROWS = 1 << 15
CELL_ROWS = 2048
MOST_CELLS = 256
SAMPLE_ROWS = 8192
CENTRES = 16
LEAF_ROWS = 256
BATCH = 256
_FAR = np.iinfo(np.int64).max


@dataclass
class CoverTree:
    """Rows in tree order, and nodes by number: the root is 0 and children follow one another."""

    rows: np.ndarray  # integers, a row each
    ids: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    centre: np.ndarray  # by node: place of its centre among the rows
    radius: np.ndarray  # in the augmented space
    reach: np.ndarray  # in the plain one
    low_label: np.ndarray
    high_label: np.ndarray
    first: np.ndarray  # rows [first, last) lie under the node
    last: np.ndarray
    child: np.ndarray  # children [child, child_end); none: a leaf
    child_end: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> CoverTree:
        wide = rows.astype(np.float64)
        square = (wide**2).sum(axis=1)
        full = np.concatenate([wide, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], axis=1)
        nodes: list[list] = []
        order: list[np.ndarray] = []

        def node(points: np.ndarray, centre: int) -> list:
            apart = full[points] - full[centre]
            plain = np.sqrt((apart[:, :-1] ** 2).sum(axis=1).max())
            return [points, centre, float(np.sqrt((apart**2).sum(axis=1).max())), float(plain)]

        todo = [node(np.arange(len(rows)), int(square.argmin()))] if len(rows) else []
        at = 0
        children: list[tuple[int, int]] = []
        while at < len(todo):  # breadth first: levels one after the other
            points, centre, radius, _ = todo[at]
            begin = len(todo)
            if len(points) > LEAF_ROWS and radius > 0:
                # The parent's centre stays one (nesting); each next one is the point that is covered worst.
                centres = [centre]
                apart = np.sqrt(((full[points] - full[centre]) ** 2).sum(axis=1))
                owner = np.zeros(len(points), np.int64)
                while len(centres) < CENTRES and (worst := int(apart.argmax())) >= 0 and (apart[worst] > radius / 2 or len(centres) < 2):
                    centres.append(int(points[worst]))
                    d = np.sqrt(((full[points] - full[centres[-1]]) ** 2).sum(axis=1))
                    nearer = d < apart
                    apart[nearer], owner[nearer] = d[nearer], len(centres) - 1
                todo += [node(points[owner == k], c) for k, c in enumerate(centres) if (owner == k).any()]
            children.append((begin, len(todo)))
            at += 1
        # Rows in the order of the leaves, so that what lies under a node is one range.
        spans: list[tuple[int, int]] = [(0, 0)] * len(todo)

        def lay(k: int, n: int) -> int:
            stack = [(k, False)]
            while stack:
                j, done = stack.pop()
                a, b = children[j]
                if done:
                    spans[j] = (spans[a][0], spans[b - 1][1])
                elif a == b:
                    order.append(todo[j][0][np.lexsort((keys[todo[j][0]], ids[todo[j][0]]))])
                    spans[j] = (n, n + len(todo[j][0]))
                    n += len(todo[j][0])
                else:
                    stack.append((j, True))
                    stack += [(c, False) for c in range(b - 1, a - 1, -1)]
            return n

        if todo:
            lay(0, 0)
        perm = np.concatenate(order) if order else np.zeros(0, np.int64)
        place = np.empty(len(perm), np.int64)
        place[perm] = np.arange(len(perm))
        labels = labels[perm]
        nodes = [(place[t[1]], t[2], t[3], labels[a:b].min(), labels[a:b].max(), a, b, *c) for t, (a, b), c in zip(todo, spans, children, strict=True)]
        cols = [np.array(c) for c in zip(*nodes, strict=True)] or [np.zeros(0, np.int64)] * 9
        return cls(rows[perm], ids[perm], keys[perm], labels, *cols)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        small = self.rows
        for kind in (np.int16, np.int32):
            if len(small) == 0 or small.size == 0 or max(int(small.max()), -int(small.min())) <= np.iinfo(kind).max:
                small = small.astype(kind)
                break
        np.savez(out, **{**self.__dict__, "rows": small})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as z:
            return cls(**{k: z[k] for k in z.files})

    def search(self, vectors: np.ndarray, own: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each probe the ``most`` first rows by (score falling, id, key) whose score lies in [low, high] and whose
        label is (``same``) or isn't the probe's; rows with the id ``own`` are left out where ``same``.

        Gives probe numbers, places of rows and scores. Probes descend together: a node is opened for those that want it.
        """
        n = len(vectors)
        if not n or not len(self.rows):
            none = np.zeros(0, np.int64)
            return none, none, none
        rows, probes = self.rows.astype(np.float64), vectors.astype(np.float64)
        size = np.sqrt((rows**2).sum(axis=1).max())
        norm = np.sqrt((probes**2).sum(axis=1))
        exact = size * norm.max() < 2**52
        if not exact and size * norm.max() >= 2**62:
            raise ValueError("an inner product doesn't fit 64 bits")
        whole = size**2 + norm**2
        slack = 1 + 1e-9 * whole
        wanted = low.astype(np.float64)
        top = [[] for _ in range(n)]  # heaps of (score, -id, -key, place), the worst first

        def bounds(node: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            dot = rows[self.centre[node]] @ probes[who].T
            far = np.sqrt(np.maximum(whole[who] - 2 * dot, 0))
            r, plain = self.radius[node][:, None], self.reach[node][:, None] * norm[who]
            up = np.minimum((whole[who] - np.maximum(far - r, 0) ** 2) / 2, dot + plain) + slack[who]
            down = np.maximum((whole[who] - (far + r) ** 2) / 2, dot - plain) - slack[who]
            fits = (self.low_label[node][:, None] <= labels[who]) & (labels[who] <= self.high_label[node][:, None])
            if not same:
                fits = ~(fits & (self.low_label[node] == self.high_label[node])[:, None])
            return np.where(fits & (down <= high[who]), np.minimum(up, high[who]), -np.inf), down

        start = np.arange(n)
        queue: list[tuple[float, int, np.ndarray, np.ndarray]] = []

        def push(node: np.ndarray, who: np.ndarray) -> None:
            up, _ = bounds(node, who)
            for k, j in enumerate(node.tolist()):
                live = up[k] >= wanted[who]
                if live.any():
                    heapq.heappush(queue, (-float((up[k] - wanted[who])[live].max()), j, who[live], up[k][live]))

        push(np.zeros(1, np.int64), start)
        while queue:
            _, j, who, up = heapq.heappop(queue)
            who = who[up >= wanted[who]]  # what was found since may have closed the node for some
            if not len(who):
                continue
            a, b = int(self.child[j]), int(self.child_end[j])
            if a < b:
                push(np.arange(a, b), who)
                continue
            a, b = int(self.first[j]), int(self.last[j])
            got = (rows[a:b] @ probes[who].T).astype(np.int64) if exact else self.rows[a:b].astype(np.int64) @ vectors[who].T.astype(np.int64)
            ok = (got >= wanted[who]) & (got >= low[who]) & (got <= high[who]) & ((self.labels[a:b, None] == labels[who]) == same)
            if same:
                ok &= self.ids[a:b, None] != own[who]
            if ok.sum() > 2 * most * len(who):  # many copies: a leaf's rows stand by id, so the first of equal scores are enough
                rank = np.argsort(np.where(ok, -got, _FAR), axis=0, kind="stable")[:most]
                first = np.zeros_like(ok)
                np.put_along_axis(first, rank, True, axis=0)
                ok &= first
            for r, c in zip(*np.nonzero(ok), strict=True):
                p = int(who[c])
                item = (int(got[r, c]), -int(self.ids[a + r]), -int(self.keys[a + r]), a + int(r))
                heap = top[p]
                if len(heap) < most:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
                if len(heap) == most:
                    wanted[p] = max(wanted[p], heap[0][0])
        flat = [(p, x[3], x[0]) for p, heap in enumerate(top) for x in heap]
        out = np.array(flat, np.int64).reshape(len(flat), 3)
        return out[:, 0], out[:, 1], out[:, 2]


def usable(rows: DataFrame, vec_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """id, label, x (integers floor(scale * component)) and key (a hash of x and label) of the rows that take part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    d = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)).cast("long"))
    d = d.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    return d.withColumn("key", F.xxhash64("x", "label")).dropDuplicates(["id", "label", "key"])


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), len(flat) // len(col) if len(col) else 0)


def pivots(rows: DataFrame, cells: int, sample_rows: int) -> dict[int, np.ndarray]:
    """By vector length up to ``cells`` centres far from each other, from the ``sample_rows`` rows with the smallest hashes."""
    t = rows.select("x", F.xxhash64("id", "key").alias("h")).orderBy("h").limit(sample_rows).toArrow().to_pandas()
    out = {}
    for dim, g in t.groupby(t["x"].map(len)):
        m = np.stack(g["x"].to_list()).astype(np.float64).reshape(len(g), dim)
        apart = ((m - m[0]) ** 2).sum(axis=1)
        picked = [0]
        while len(picked) < min(cells, len(m)) and apart.max() > 0:
            picked.append(int(apart.argmax()))
            apart = np.minimum(apart, ((m - m[picked[-1]]) ** 2).sum(axis=1))
        out[int(dim)] = m[picked]
    return out


def blocks_of(rows: DataFrame, block_rows: int, cell_rows: int, sample_rows: int) -> DataFrame:
    """``rows`` with dim, cell (the nearest pivot) and block: a hash deals the rows of a large cell."""
    n = rows.count()
    centres = pivots(rows, int(np.clip(n // cell_rows, 1, MOST_CELLS)), sample_rows)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("x").value_lengths().to_numpy()
            cell = np.zeros(len(b), np.int32)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                if dim in centres and dim:
                    c = centres[dim]
                    m = _matrix(b.column("x").take(pa.array(at))).astype(np.float64)
                    cell[at] = ((c**2).sum(axis=1) - 2 * m @ c.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int32)), pa.array(cell)], [*b.schema.names, "dim", "cell"])

    schema = "id long, label long, x array<long>, key long, dim int, cell int"
    dealt = stored(rows.select("id", "label", "x", "key").mapInArrow(nearest, schema), "negatives-cells")
    parts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / (0.8 * block_rows)).cast("int").alias("parts"))
    # At most MOST_CELLS rows a length of vectors: as many lengths as the data have, and Spark decides on a broadcast.
    return dealt.join(parts, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", "key", F.lit(5)), F.col("parts")).cast("int")).drop("parts")


_BLOCK = "dim int, tree binary, anchors array<struct<id: long, key: long, label: long, x: array<long>, low: long>>"


def cover_trees(rows: DataFrame, is_anchor: Column, positives: int, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row a block: its tree, and its anchors with the score of their ``positives``-th same-label row in it."""

    def build(g: pd.DataFrame) -> pd.DataFrame:
        dim = int(g["dim"].iloc[0])
        x = np.stack(g["x"].to_list()).astype(np.int64).reshape(len(g), dim)
        tree = CoverTree.build(x, g["id"].to_numpy(np.int64), g["key"].to_numpy(np.int64), g["label"].to_numpy(np.int64))
        own = np.flatnonzero(g["anchor"].to_numpy(bool))
        low = np.full(len(own), -_FAR)
        for k in range(0, len(own), BATCH):
            who = own[k : k + BATCH]
            probe, _, score = tree.search(x[who], g["id"].to_numpy()[who], g["label"].to_numpy()[who], True, low[k : k + BATCH].copy(), np.full(len(who), _FAR), positives)
            count = np.bincount(probe, minlength=len(who))
            least = np.full(len(who), _FAR)
            np.minimum.at(least, probe, score)
            low[k : k + BATCH] = np.where(count == positives, least, -_FAR)
        anchors = [{"id": int(g["id"].iloc[i]), "key": int(g["key"].iloc[i]), "label": int(g["label"].iloc[i]), "x": x[i].tolist(), "low": int(b)} for i, b in zip(own, low, strict=True)]
        return pd.DataFrame({"dim": [dim], "tree": [tree.to_bytes()], "anchors": [anchors]})

    dealt = blocks_of(rows, block_rows, cell_rows, sample_rows).withColumn("anchor", is_anchor)
    return stored(dealt.groupBy("dim", "cell", "block").applyInPandas(build, _BLOCK), "negatives-trees")


def _batches(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    where, at = fs.FileSystem.from_uri(path)
    files = [f.path for f in where.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet")]
    if files:
        yield from (b for b in pads.dataset(files, filesystem=where, format="parquet").to_batches(batch_size=rows) if b.num_rows)


def search_all(trees: DataFrame, probes: DataFrame, same: bool, most: int) -> DataFrame:
    """(id, key, at, found, found_key, score): what each tree finds for each probe of a stored table (id, key, label, x, at, low, high)."""
    path = probes.stored_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tree = CoverTree.from_bytes(raw.as_py())
                for q in _batches(path, BATCH):
                    q = q.filter(pa.array(q.column("x").value_lengths().to_numpy() == dim))
                    if not q.num_rows:
                        continue
                    v = {c: q.column(c).to_numpy() for c in ("id", "key", "label", "at", "low", "high")}
                    x = _matrix(q.column("x")).reshape(q.num_rows, dim)
                    probe, place, score = tree.search(x, v["id"], v["label"], same, v["low"], v["high"], most)
                    if len(probe):
                        cols = [v["id"][probe], v["key"][probe], v["at"][probe], tree.ids[place], tree.keys[place], score]
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["id", "key", "at", "found", "found_key", "score"])

    n = max(1, trees.count())
    return trees.select("dim", "tree").repartition(n).mapInArrow(run, "id long, key long, at long, found long, found_key long, score long")


def _first(found: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("id", "key", "at").orderBy(F.desc("score"), "found", "found_key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (id, label, x, key).

    An anchor's positives are its first other rows of its label; of each positive the negatives are
    the first rows of another label with low * positive <= 100 * negative <= high * positive.
    """
    trees = cover_trees(rows, is_anchor, positives, block_rows, cell_rows)
    a = trees.select(F.explode("anchors").alias("a")).select("a.*")
    far = F.lit(int(_FAR))
    probes = stored(a.select("id", "key", "label", "x", F.lit(0).cast("long").alias("at"), "low", far.alias("high")), "negatives-anchors")
    near = stored(_first(search_all(trees, probes, True, positives), positives), "negatives-positives")
    # 100 * score in [low * p, high * p]: the bounds rounded inwards, in decimals, which don't overflow.
    p = F.col("score").cast("decimal(38,0)")
    windows = near.select("id", "key", F.col("rank").cast("long").alias("at"), F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high"))
    wide = stored(windows.where("low <= high").join(probes.select("id", "key", "label", "x"), ["id", "key"]).select("id", "key", "label", "x", "at", "low", "high"), "negatives-windows")
    found = _first(search_all(trees, wide, False, negatives), negatives)
    pos = near.select("id", "key", F.col("rank").cast("long").alias("at"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(pos, ["id", "key", "at"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors (ids divisible by 100) among all vectors; labels of ids divisible by 7 are the next ones."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    e = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(usable(e, "vec_id", "label", "embedding", 256), F.col("id") % 100 == 0)
