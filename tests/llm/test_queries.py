"""Every opN_ query by its contract: columns, types, folds and values, on a small folder of odd rows."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pytest

from riskloom.llm import queries

CONTRACT = {
    "op1_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op2_balanced_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_lm_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_warc_segments": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_decontaminate": "doc_id bigint, item_id bigint",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_bpe_round_trip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[6]), (None, texts[16]), (3, texts[17]), (6, texts[6]), (90, "abc " * 400_000)]
    docs = [(i, t, ("en", None)[k % 2], "s", None, "own", 7, 0.5) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string, shard long, score double").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(len(texts))] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, texts[12]), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    html = [None, "", "<p>x</p>", "<p>x</p>", "é" * 9000]
    spark.createDataFrame([(i, "http://h", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    rng = np.random.default_rng(1)
    vectors = [(k, k % 10, [float(x) for x in np.float32(rng.normal(size=6))]) for k in range(250)] + [(300, None, [0.0] * 6), (400, 1, None), (500, 2, [None] * 6), (600, 3, [float("nan")] * 6)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at, rows, html


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, folder, name):
    from riskloom.llm.bpe import default_tokenizer

    at, rows, html = folder
    df = queries.QUERIES[name](spark, at)
    kinds = dict(df.dtypes)
    want = [x.split() for x in CONTRACT[name].split(", ")]
    assert {c: kinds.get(c) for c, _ in want} == dict(want)
    got = df.collect()
    raw = [(i, (t or "").encode()) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5
    if name == "op6_warc_segments":
        first = {h or "": min(k for k, x in enumerate(html) if (x or "") == (h or "")) for h in html}
        digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == [(k, len((h or "").encode()), digest(h), "response" if first[h or ""] == k else "revisit", None if first[h or ""] == k else first[h or ""]) for k, h in enumerate(html)]
        return
    if name == "op11_hard_negatives":
        assert {r.anchor_id for r in got} == {0, 100, 200} and all(80 * r.positive_score <= 100 * r.negative_score <= 100 * r.positive_score and 1 <= r.rank <= 5 for r in got)
        return
    if name == "op13_collocations":
        # One document of "abc " 400,000 times is all that repeats often enough in its language.
        of = {(r.lang, r.phrase): r for r in got}
        lang = next(k for k, _ in of)
        r = of[lang, "abc abc abc abc"]
        assert {r.rank for r in got if r.lang == lang} == set(range(1, 1 + sum(r.lang == lang for r in got))) and r.a == 399_997 and (r.l, r.r) in {(400_000, 399_998), (399_999, 399_999)}
        assert r.score == 2_000_000 * r.a // (r.l + r.r) and ("en", "abc abc") not in of and ("und", "abc abc") not in of
        return
    if name == "op8_decontaminate":
        assert {(r.doc_id, r.item_id) for r in got} == {(10, 1), (11, 1), (12, 1)}
        return
    assert sorted((key(r.doc_id) for r in got)) == sorted(key(i) for i, _ in rows)
    if name == "op1_media_columns":
        pad = lambda b: b + bytes(-len(b) % 64 or (64 if not b else 0))
        assert sorted((key(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted((key(i), len(b), len(pad(b)), hashlib.sha256(pad(b)).hexdigest(), zlib.crc32(pad(b)[-64:])) for i, b in raw)
    if name == "op2_balanced_shards":
        assert sorted((key(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((key(i), len(b) + 1, zlib.crc32(b)) for i, b in raw)
        count = np.bincount([r.shard for r in got], minlength=16)
        assert len(count) == 16 and np.ptp(count) <= 1 and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(count[s])) for s in range(16))
    if name in ("op3_token_files", "op10_bpe_round_trip"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(default_tokenizer())
        coded = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
        pack = lambda ids: np.array(ids, "<u4").tobytes()
        if name == "op3_token_files":
            assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((key(i), len(x) + 1, zlib.crc32(pack([*x, 2]))) for i, x in coded)
            got.sort(key=lambda r: r.start)
            assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
            assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)
        else:
            want = sorted((key(i), len(x), hashlib.sha256(pack(x)).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in coded)
            assert sorted((key(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    if name == "op4_lm_scores":
        assert all(r.held_out == (fold(r.doc_id) == 1) and r.score < 0 and r.base_score < 0 for r in got)
    if name == "op9_toxicity":
        assert all(r.held_out == (fold(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    if name == "op12_language_id":
        text = {key(i): t for i, t in rows if rows.count((i, t)) == len([1 for j, _ in rows if j == i])}
        assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
        assert {r.lang_pred for r in got} <= {"en", "und"} and all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[key(r.doc_id)] or "")) for r in got if key(r.doc_id) in text)
