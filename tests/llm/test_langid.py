"""Hyperdimensional language profiles against a plain version, by held-out accuracy, and on odd rows."""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from riskloom.llm import langid
from riskloom.llm.langid import DIM, fit_languages, letter_vectors, predict_languages

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int, key string"


def plain_vector(text: str) -> np.ndarray:
    letters = [32]
    for c in text:
        p = ord(c.lower()[0]) if unicodedata.category(c)[0] in "LM" else 32
        if p != 32 or letters[-1] != 32:
            letters.append(p)
    if letters[-1] != 32:
        letters.append(32)
    v = {p: letter_vectors(np.array([p]))[0].astype(np.int64) for p in set(letters)}
    total = np.zeros(DIM, np.int64)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b != 32:  # n-grams of words with a gap on both sides; none crosses a gap
            total += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return total


def plain_model(rows):
    sums = defaultdict(lambda: np.zeros(DIM, np.int64))
    for text, lang in rows:
        if text is not None and lang is not None:
            sums[lang] += plain_vector(text)
    return {k: v for k, v in sums.items() if v.any()}


def has_letter(t):
    return any(c.isalpha() for c in t or "")


@pytest.fixture(scope="module")
def rows(texts):
    rng = np.random.default_rng(2)
    make = lambda alphabet, n: " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 8))) for _ in range(n))
    out = []
    for k in range(40):
        out.append((make("abcdefgh ij", 30 + k), "aa"))
        out.append((make("fghijklmnéß", 20 + k), "bb"))
        out.append((make("жзиклмноп", 10), "cc"))
    out += [(t, ("xx", None)[i % 2]) for i, t in enumerate(texts)]
    out += [("漢字 " * 40 + "".join(chr(0x4E00 + k) for k in range(300)), "zh"), ("İSTANBUL été ½ १२ नमस्ते", "tr"), ("12 34 !!", "aa"), ("x", "aa"), (" ", "aa"), (None, "aa"), (None, None)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "k") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def test_equals_a_plain_version(spark, rows):
    df = frame(spark, rows)
    model = fit_languages(df)
    sums = plain_model(rows)
    want = langid.Prototypes(sums)
    assert model.languages == want.languages and np.allclose(model.unit, want.unit)
    got = predict_languages(df, model)
    assert got.columns == ["doc_id", "lang", "key", "lang_pred", "score"]
    for r in got.collect():
        t = rows[r.doc_id][0]
        if not has_letter(t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        pick, score = want.best(plain_vector(t)[None])
        assert r.lang_pred == want.languages[pick[0]] and r.score == pytest.approx(score[0]) and 0 <= r.score <= 1


@pytest.mark.parametrize("part", [langid.PART, 64])
def test_block_vectors_are_the_plain_ones(rows, monkeypatch, part):
    # Parts and runs end at gaps, so small ones change nothing.
    import pyarrow as pa

    monkeypatch.setattr(langid, "PART", part)
    monkeypatch.setattr(langid, "CELLS", 1 << 21 if part > 64 else 50)
    from riskloom.llm.blocks import text_blocks

    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string())], ["text"])
    at = 0
    for b in text_blocks(iter([batch]), block_bytes=3000):
        got = np.zeros((len(b), DIM))
        for docs, has, grams, of in langid.block_grams(b):
            got[docs] += langid.text_vectors(grams, of, len(docs))
            assert has.tolist() == [has_letter(rows[at + k][0]) for k in docs]
        for k in range(len(b)):
            assert np.array_equal(got[k], plain_vector(rows[at + k][0] or "")), rows[at + k]
        at += len(b)
    assert at == len(rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in langid.op12_language_id(spark, sf).collect() if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) >= 0.97


def test_nothing_learned_and_empty(spark, rows):
    df = frame(spark, rows)
    nothing = fit_languages(df.where("lang IS NULL"))
    assert {(r.lang_pred, r.score) for r in predict_languages(df, nothing).collect()} == {("und", 0.0)}
    one = fit_languages(df.where("lang = 'bb'"))
    assert {r.lang_pred for r in predict_languages(df, one).collect()} == {"bb", "und"}
    empty = df.where("doc_id < 0")
    assert predict_languages(empty, fit_languages(empty)).count() == 0
    with pytest.raises(ValueError):
        fit_languages(df, most_languages=2)
