"""Hard negatives against brute force: clusters, ties, repeated and odd rows, several trees."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import negatives
from riskloom.llm.negatives import CoverTree, hard_negatives, usable

SCHEMA = "vec_id long, label int, embedding array<float>, id string, x int"


def brute(rows, anchor, scale=256, k=5):
    good = {(i, lab, tuple(int(np.floor(np.float64(np.float32(c)) * scale)) for c in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for i, lab, v in good:
        if i % anchor:
            continue
        dot = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: E731, B023
        pos = sorted((-dot(w), j) for j, m, w in good if m == lab and j != i and len(w) == len(v))[:k]
        for s, j in pos:
            neg = sorted((-dot(w), n) for n, m, w in good if m != lab and len(w) == len(v) and 80 * -s <= 100 * dot(w) <= 100 * -s)[:k]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(neg, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1, (6, 8))
    v = [centre[k % 6] + rng.normal(0, 0.3, 8) for k in range(900)]
    out = [(k, int(rng.integers(0, 4)), [float(c) for c in np.float32(x)]) for k, x in enumerate(v)]
    out += [(2000 + k, k % 3, out[5][2]) for k in range(60)]  # copies of one vector: ties by id
    out += [(3000, None, out[0][2]), (3010, 1, None), (None, 1, out[0][2]), (3020, 1, [float("nan")] * 8), (3030, 1, [None] * 8), (3040, 1, [float("inf")] + [0.0] * 7)]
    out += [(4000 + k, k % 2, [1.0, float(k)]) for k in range(40)] + [(4100 + 10 * k, k % 2, []) for k in range(3)]  # other lengths
    return out


@pytest.mark.parametrize(("block_rows", "cell_rows"), [(1 << 15, 2048), (64, 40)])
def test_equals_brute_force(spark, rows, monkeypatch, block_rows, cell_rows):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 16)
    monkeypatch.setattr(negatives, "BATCH", 7)
    df = spark.createDataFrame([(*r, "own", 1) for r in [*rows, rows[10]]], SCHEMA).repartition(3)
    got = hard_negatives(usable(df, "vec_id", "label", "embedding", 256), F.col("id") % 10 == 0, block_rows=block_rows, cell_rows=cell_rows).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10)


def test_empty_and_all_odd(spark):
    for data in ([], [(100, None, None, "a", 1)], [(100, 1, [1.0, 2.0], "a", 1)]):
        df = spark.createDataFrame(data, SCHEMA)
        assert hard_negatives(usable(df, "vec_id", "label", "embedding", 256), F.col("id") % 100 == 0).count() == 0


def test_nodes_cover_their_rows_and_outside_nodes_are_skipped():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 2, (2000, 16)) for c in rng.normal(0, 300, (8, 16))]).astype(np.int64)
    t = CoverTree.build(x, np.arange(len(x)), np.arange(len(x)), np.arange(len(x)) % 2)
    t = CoverTree.from_bytes(t.to_bytes())
    full = np.concatenate([t.rows, np.sqrt(((x**2).sum(axis=1).max() - (t.rows.astype(float) ** 2).sum(axis=1)))[:, None]], axis=1)
    assert sorted(t.ids.tolist()) == list(range(len(x))) and (t.child_end - t.child).max() <= negatives.CENTRES
    for k in range(len(t.centre)):
        a, b = t.first[k], t.last[k]
        assert a <= t.centre[k] < b and np.linalg.norm(full[a:b] - full[t.centre[k]], axis=1).max() <= t.radius[k] + 1e-6
        if t.child[k] < t.child_end[k]:
            assert t.first[t.child[k]] == a and t.last[t.child_end[k] - 1] == b
    opened = []
    t.labels = type("Seen", (np.ndarray,), {"__getitem__": lambda s, i: opened.append(i) or np.asarray(s).__getitem__(i)})(t.labels.shape, t.labels.dtype, t.labels.tobytes())
    probe, place, score = t.search(x[:1], np.array([0]), np.array([0]), True, np.array([-(1 << 62)]), np.array([1 << 62]), 5)
    want = np.sort((x[::2] @ x[0])[1:])[::-1][:5]
    assert sorted(score.tolist(), reverse=True) == want.tolist() and len(opened) < len(x) / negatives.LEAF_ROWS / 3


def test_large_numbers_are_exact_or_refused():
    x = np.array([[1 << 29, 3], [1 << 29, 5], [7, 1]])
    t = CoverTree.build(x, np.arange(3), np.arange(3), np.zeros(3, np.int64))
    _, place, score = t.search(x[:1], np.array([0]), np.array([0]), True, np.array([-(1 << 62)]), np.array([1 << 62]), 2)
    assert sorted(score.tolist()) == [7 * (1 << 29) + 3, (1 << 58) + 15]
    with pytest.raises(ValueError):
        CoverTree.build(x * 8, np.arange(3), np.arange(3), np.zeros(3, np.int64)).search(x[:1] * 8, np.array([0]), np.array([0]), True, np.array([0]), np.array([1 << 62]), 2)
