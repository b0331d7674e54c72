"""Dynamic itemset counting against plain counts: odd texts, slots that collide, texts in portions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskloom.llm import phrases
from riskloom.llm.phrases import Scan, collocations, frequent_phrases

LOWER = {k: k + 32 for k in range(65, 91)}


def words_of(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def counts(rows, longest=4):
    f = defaultdict(Counter)
    for lang, text in rows:
        for w in words_of(text):
            for n in range(1, longest + 1):
                f[lang or "und"].update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    return f


def plain(rows, threshold, most):
    out = []
    for lang, f in counts(rows).items():
        total = sum(v for k, v in f.items() if " " not in k)
        cand = {k: v for k, v in f.items() if " " in k and v >= threshold}
        found = []
        for p, a in cand.items():
            w = p.split(" ")
            cuts = [(2000000 * a // (f[x] + f[y]), k, f[x], f[y]) for k in range(1, len(w)) for x, y in [(" ".join(w[:k]), " ".join(w[k:]))]]
            if not any(f" {p} " in f" {q} " and q != p and 100 * b >= 80 * a for q, b in cand.items()):
                score, _, lo, hi = min(cuts)
                found.append((-score, -a, p.encode(), p, lo, hi))
        out += [(lang, r, p, -a, lo, hi, total, -s) for r, (s, a, _, p, lo, hi) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows(texts):
    rng = np.random.default_rng(8)
    vocab = ["New", "york", "city", "the", "of", "é", "x y", "'tis", "a-b", "1st", "and"]
    out = [(("en", "fr", None)[k % 3], t) for k, t in enumerate(texts)]
    for k in range(200):
        w = list(rng.choice(vocab, 12))
        if k % 3 == 0:
            w[2:5] = ["new", "YORK", "city"]
        if k > 120:  # a phrase that is frequent in the later shards only
            w[7:11] = ["late", "comers", "are", "here"]
        out.append((("en", "fr", None)[k % 4 % 3], "".join(x + str(rng.choice([" ", "  ", "\t", ", ", "\n", " "])) for x in w)))
    return out + [out[-1]] * 40


@pytest.mark.parametrize(("threshold", "shards", "slot_bits"), [(4, 3, 22), (9, 5, 3), (2, 1, 10)])
def test_counts_are_exact(spark, rows, threshold, shards, slot_bits):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n int, phrase string").repartition(4)
    freq, words = frequent_phrases(df, threshold, shards=shards, slot_bits=slot_bits)
    got = freq.collect()
    f = counts(rows)
    assert sorted((r.lang, r.phrase, r.f) for r in got) == sorted((lang, p, c) for lang, x in f.items() for p, c in x.items() if c >= threshold)
    assert all(r.n == r.phrase.count(" ") + 1 and (r.start == 0) == (r.n == 1) for r in got)
    assert {r.lang: r.words for r in words.collect()} == {lang: sum(c for p, c in x.items() if " " not in p) for lang, x in f.items()}
    if shards > 1:  # lengths are interleaved: some longer phrases are active before all words have been counted
        assert any(r.n == 2 and r.start < shards for r in got)


def test_collocations_equal_a_plain_version(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for most in (2000, 5):
        assert sorted(tuple(r) for r in collocations(df, 5, most=most).collect()) == plain(rows, 5, most)


def test_long_texts_in_portions(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 40)
    rng = np.random.default_rng(1)
    text = "".join(str(rng.choice(["aa", "b", "ccc", "verylongwordwithoutanyblankinit" * 3])) + str(rng.choice([" ", "  ", ". ", "\n"])) for _ in range(400)).strip()
    # Everything looks frequent, so the last scan's texts are all phrases.
    scan = Scan(9, 3, 4, np.zeros(4, np.int8), np.ones(4, bool))
    got = Counter()
    words = 0
    for x in scan.parts(np.frombuffer(text.encode(), np.uint8), "en"):
        if len(x) == 2:
            words += int(x[1].sum())
            continue
        key, _, c, rows = x
        for phrase, count in zip(rows(np.arange(len(key))).column("phrase").to_pylist(), c.tolist(), strict=True):
            got[phrase] += count
    assert words == len(text.replace(".", " ").split())
    assert got == counts([("en", text)])["en"]


def test_colliding_keys_are_counted_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "HELD", 3)
    # One key for all words of a length: only the second keys tell them apart.
    monkeypatch.setattr(phrases, "mix64", lambda x: np.asarray(x) % np.uint64(5) + np.uint64(1))
    scan = Scan(9, 3, 2, np.zeros(4, np.int8), np.ones(4, bool))
    text = "a b c d e f g h a b c d a b . x y a"
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array([text, text, "a a a"])], ["lang", "text"])
    got = Counter()
    for b in scan.by_text(iter([batch])):
        for r in b.to_pylist():
            got[r["phrase"]] += r["c"]
    want = counts([("en", text), ("en", text), ("en", "a a a")], 2)["en"]
    assert got.pop("") == sum(v for k, v in want.items() if " " not in k) and {k for k in got if " " not in k} == {k for k in want if " " not in k}
    assert all(got[k] == v for k, v in want.items() if " " not in k)


def test_texts_are_made_from_the_first_portions(spark, monkeypatch):
    """Texts of frequent phrases are looked for where they were missing, not counted anew in the whole corpus."""
    made, write = [], phrases.stored

    def stored(df, label):
        table = write(df, label)
        if label == "phrases-missing":
            made.append(table.count())
        return table

    monkeypatch.setattr(phrases, "stored", stored)
    texts = ["new york city and the of"] * 600 + ["rare pair"] * 4
    freq, words = frequent_phrases(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"), 4)
    f = {p: c for p, c in counts([("en", t) for t in texts])["en"].items() if c >= 4}
    assert {(r.phrase, r.f) for r in freq.collect()} == set(f.items()) and words.first().words == 600 * 6 + 8
    assert made[0] == len(f) and made[1] <= 3 and made[-1] == 0 and len(made) <= phrases.PORTIONS + 1


def test_keys_that_collide_keep_their_own_counts(monkeypatch):
    import pyarrow as pa

    real = phrases.mix64
    # The first keys have few values; words are told apart by the second ones alone.
    monkeypatch.setattr(phrases, "mix64", lambda x: real(np.asarray(x)) % np.uint64(3) << np.uint64(8))
    got = Counter()
    for b in Scan(0, 3, 1, np.full(4, phrases.NEVER, np.int8)).by_key(iter([pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["a b c d e f g a a", "b b"])], ["lang", "text"])])):
        for r in b.to_pylist():
            got[r["key"], r["twin"]] += r["c"]
    assert sorted(got.values()) == [1, 1, 1, 1, 1, 3, 3] and len({k for k, _ in got}) <= 3


def test_late_scans_make_second_keys_of_what_is_active_only(monkeypatch):
    import pyarrow as pa

    made, real = [], phrases.span_keys
    monkeypatch.setattr(phrases, "span_keys", lambda data, start, end, count=1, first=0: made.append((first + count - 1, len(start))) or real(data, start, end, count, first))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 2), pa.array(["a b c d e f g h", "a b x"])], ["lang", "text"])
    reached = np.full(1 << 16, phrases.NEVER, np.int8)
    for word in (b"a", b"b"):
        key = phrases.mix64(real(np.frombuffer(word, np.uint8), np.array([0]), np.array([1]))[0] + np.uint64(phrases._lang_key("en")))
        reached[int(key[0] >> np.uint64(8)) & 0xFFFF] = 6
    out = [r for b in Scan(7, 3, 4, reached).by_key(iter([batch])) for r in b.to_pylist()]
    # "a b" alone is active; the 11 words get first keys, and four of them second ones.
    assert sum(r["c"] for r in out) == 2 and made == [(0, 11), (1, 4)]
    early = [r for b in Scan(2, 7, 4, reached).by_key(iter([batch])) for r in b.to_pylist()]
    late = [r for b in Scan(7, 7, 4, reached).by_key(iter([batch])) for r in b.to_pylist()]
    assert len(early) == 9 and {(r["key"], r["twin"]) for r in out} == {(r["key"], r["twin"]) for r in late}


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations(df).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("en", " ,. ")], "lang string, text string")).count() == 0
