"""Media columns, token files, WARC archives, BPE: round trips and brute force."""

from __future__ import annotations

import base64
import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bpe, media, ngramjoin, tokenfiles, warc
from riskloom.llm.blocks import Block, shared_dir
from riskloom.llm.blocks import words as word_spans
from riskloom.llm.piecetable import PieceTable, distinct, portions

WORD_BPE = bpe.default_tokenizer()


def test_jpeg_keeps_payloads(docs, texts):
    rows = media.jpeg_thumbnails(media.store_as_jpeg(docs)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        n, payload, tail = media.expected_payload(texts[r.doc_id])
        assert (r.n_bytes, bytes(r.thumb), zlib.crc32(bytes(r.thumb)[-64:])) == (n, payload, tail)
        assert r.width == 512 and r.height == 8 * (len(payload) // 64) and r.key == "k"


def test_jpeg_long_and_foreign_streams():
    long_ = np.tile(np.arange(256, dtype=np.uint8), 4096)
    images = media.encode_payloads(long_, np.array([len(long_) // 64]))
    parts = media.thumbnails(images)[0]
    assert len(parts) == 3 and b"".join(p.tobytes() for _, _, p in parts) == long_.tobytes()
    with pytest.raises(ValueError):
        media.thumbnails([b"no jpeg"])


def test_features_see_whole_texts(spark):
    rng = np.random.default_rng(3)
    base = "".join(chr(c) for c in rng.integers(97, 123, 1_500_000))
    late = base[:600_000] + base[600_000:].upper()  # darker after 600,000 bytes, which is more than one image
    one = base[:1_400_000] + "!" + base[1_400_001:]
    texts = [base, late, one, base, "short", ""]
    rows = media.jpeg_thumbnails(media.store_as_jpeg(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    feature = [(r.width, r.height, r.thumb_hash, r.thumb_digest) for r in rows]
    assert feature[0] == feature[3] and len(set(feature)) == 5 and rows[0].images == 3 and rows[0].thumb_hash != rows[1].thumb_hash
    for r, t in zip(rows, texts, strict=True):  # brute force: means of 8 x 8 areas of the payload, 64 bytes a row
        px = np.frombuffer(media.expected_payload(t)[1], np.uint8).reshape(-1, 64)
        assert r.height == 8 * len(px) and r.width == 512 and r.thumb_digest == hashlib.sha256(px.tobytes()).hexdigest()[:16]
        if len(px) >= 8:
            edge = [k * len(px) // 8 for k in range(9)]
            cell = np.array([[px[edge[i] : edge[i + 1], 8 * j : 8 * j + 8].mean() for j in range(8)] for i in range(8)])
            assert r.thumb_hash == np.packbits(cell.ravel() > cell.mean()).tobytes().hex()


def test_jpeg_null_on_error(spark):
    df = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    rows = media.jpeg_thumbnails(df, on_error="null").orderBy("doc_id").collect()
    assert [r.thumb for r in rows] == [None, None] and rows[1].images == 0


def test_bpe_equals_the_library(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    rows = bpe.encode_and_decode(docs, WORD_BPE, keep_ids=True).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_reads_long_texts_in_portions(spark, texts, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "PORTION", 64)
    tok = Tokenizer.from_file(WORD_BPE)
    long_ = [" ".join([t or "" for t in texts] * 3), "  " + texts[6] + " \n ", "x" * 500 + " " + "y" * 300, " " * 400, texts[11]]
    known = bpe.RememberedPieces(bpe.MergeList(WORD_BPE), bits=6)  # so small that it starts anew again and again
    for t in long_:
        parts = list(portions(np.frombuffer(t.encode(), np.uint8), 64))
        assert b"".join(p.tobytes() for p in parts) == t.encode()
        ids = [i for p in parts for i in known.coded(p, np.array([0, len(p)]))[0].tolist()]
        assert ids == tok.encode(t, add_special_tokens=False).ids
    schema = bpe.encode_and_decode(spark.createDataFrame(list(enumerate(long_)), "doc_id long, text string").coalesce(1), WORD_BPE, keep_ids=True).collect()
    for r in schema:
        ids = tok.encode(long_[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_piece_table_keeps_and_forgets():
    t = PieceTable(4, 1)
    both = lambda *h: np.array([h, [7] * len(h)], np.uint64)
    h = both(1, 17, 33, 49, 2)  # four of them want one slot
    t.insert(h, np.arange(5)[None])
    assert t.values[0, t.find(h)].tolist() == [0, 1, 2, 3, 4] and t.find(both(65, 3)).tolist() == [-1, -1]
    other = np.array([[1], [8]], np.uint64)  # the first key of another piece
    assert t.find(other).tolist() == [-1]
    t.insert(other, np.array([[9]]))
    assert t.values[0, t.find(other)].tolist() == [9] and t.values[0, t.find(h)].tolist() == [0, 1, 2, 3, 4]
    t.clear()
    assert t.find(h).tolist() == [-1] * 5


@pytest.mark.parametrize("more", [-1, 0, 1, 5000])
def test_piece_table_takes_more_keys_than_slots(more):
    t = PieceTable(4, 1)
    n = 16 + more
    keys = np.stack([np.arange(1, n + 1), np.arange(n)]).astype(np.uint64)
    t.insert(keys, np.arange(n)[None])
    assert t.full and t.held == 8
    found = t.find(keys)
    assert (found >= 0).sum() == 8 and t.values[0, found[found >= 0]].tolist() == list(range(8))


def test_distinct_looks_at_both_keys():
    first, which = distinct(np.array([[5, 5, 5, 1], [1, 2, 1, 1]], np.uint64))
    assert len(first) == 3 and which[0] == which[2] != which[1]


def rule_words(n: int = 1024) -> tuple[str, str]:
    """The two words of x -> xy, y -> yx from a and from b: a polynomial hash modulo 2**64 can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_built_by_a_rule_are_told_apart(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    a, b = rule_words()
    texts = [a, b, f"{a} {b}", f"{b} {a} {a}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {i: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.ids) for r in bpe.encode_and_decode(df, WORD_BPE, keep_ids=True).collect()} == want
    folder = shared_dir(spark, "tokens")
    tokenfiles.write_token_files(df, folder, WORD_BPE)
    end = np.array([2], "<u4").tobytes()
    assert {r.doc_id: r.ids_crc32 for r in tokenfiles.read_token_files(spark, folder).collect()} == {i: zlib.crc32(x + end) for i, x in want.items()}
    words = Block(None, np.frombuffer(f"{a} {b}".encode(), np.uint8), np.array([0, 2049]))
    h = word_spans(words).hashes()
    assert len(h) == 2 and h[0] != h[1]
    links = spark.createDataFrame([(1, f"{a} x"), (2, f"{b} x"), (3, f"{a} x")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(links).collect()} == {1: 1, 2: 2, 3: 1}


def test_token_files_take_long_texts_in_portions():
    from tokenizers import Tokenizer

    known = tokenfiles.LibraryPieces(WORD_BPE, "<u2")
    known.table = PieceTable(19, 2)  # fewer slots than pieces
    part = " ".join(map(str, range(280_000))) + " "
    solid = "".join("abcdefghij0123456789"[(k * k + k // 7) % 20] for k in range(50_000)) * 100
    tok = Tokenizer.from_file(WORD_BPE)
    for text, again in ((part, 11), (solid, 1)):  # 21 MB of far more pieces than slots, 5 MB without a blank
        raw = np.frombuffer(text.encode() * again, np.uint8)
        ids, bounds = known.ids(Block(None, raw, np.array([0, len(raw)])))
        assert bounds.tolist() == [0, len(ids)] and known.table.held <= 1 << 18
        assert np.array_equal(ids, np.tile(np.array(tok.encode(text, add_special_tokens=False).ids, "<u2"), again))


def test_bpe_streams_long_words():
    m = bpe.MergeList(WORD_BPE)
    word = ("thereisnospaceinthisword" * 400).encode()
    whole = m.merge([*[bpe.byte_symbols()[b] for b in word[:-1]], bpe.byte_symbols()[word[-1]] + m.suffix])
    t = bpe.WordTransducer(m)
    out, most = [], 0
    for at in range(0, len(word), 37):
        out += t.feed(word[at : at + 37])
        most = max(most, len(t.pending))
    out += t.finish()
    assert out == [m.vocab[x] for x in whole] and most <= 2 * m.lookahead + 40


def test_decoder_waits_for_whole_characters():
    m = bpe.MergeList(WORD_BPE)
    enc = bpe.PieceEncoder(m)
    d = bpe.TokenDecoder(m, "text")
    assert d.decode(list(enc.encode("é中x"))) == "é中x "
    assert d._bytes(b"\xe4\xb8") == "" and d.finish() == "�"


def test_token_files(spark, docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    folder = shared_dir(spark, "tokens")
    manifest = tokenfiles.write_token_files(docs, folder, WORD_BPE)
    rows = tokenfiles.read_token_files(spark, folder).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([*range(len(texts)), 6])
    at = 0
    for r in rows:
        ids = np.array([*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    first = manifest.orderBy("part", "seq").first()
    assert tokenfiles.read_document(folder, first.path, 0).tolist() == [2]
    with pytest.raises(ValueError):
        tokenfiles.ShardReader(folder, first.path, b"another dictionary")


def test_empty_tables(spark, empty):
    assert media.jpeg_thumbnails(media.store_as_jpeg(empty)).count() == 0
    assert bpe.encode_and_decode(empty, WORD_BPE).count() == 0
    folder = shared_dir(spark, "tokens")
    tokenfiles.write_token_files(empty, folder, WORD_BPE)
    assert tokenfiles.read_token_files(spark, folder).count() == 0
    folder = shared_dir(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.reassemble(warc.read_warc(spark, folder)).count() == 0


def test_warc_round_trip(spark):
    html = [None, "", "<p>x</p>", "<p>x</p>", "é" * 20_000, "<b>" + "long " * 9000, "é" * 20_000]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://h/{i}\r\nX: y", h, 0) for i, h in enumerate(html)] + [(5, "http://h/5", html[5], 0)], "page_id long, url string, html string, type int")
    folder = shared_dir(spark, "warc")
    warc.write_warc(pages, folder)
    back = warc.reassemble(warc.read_warc(spark, folder)).orderBy("page_id").collect()
    assert [r.page_id for r in back] == [0, 1, 2, 3, 4, 5, 5, 6] and {r.status for r in back} == {"ok"}
    for r in back:
        raw = (html[r.page_id] or "").encode()
        first = next(i for i, h in enumerate(html) if (h or "") == (html[r.page_id] or ""))
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
        assert r.payload is None if r.type == "revisit" else bytes(r.payload) == raw


def test_warc_plan_has_no_broadcast_of_records(spark):
    folder = shared_dir(spark, "warc")
    warc.write_warc(spark.createDataFrame([(k, "u", "y" * 20_000) for k in range(4)], "page_id long, url string, html string"), folder)
    back = warc.reassemble(warc.read_warc(spark, folder))
    assert back.count() == 4 and "Broadcast" not in back._jdf.queryExecution().executedPlan().toString()


def test_warc_reports_lost_segments(spark):
    folder = shared_dir(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "u", "y" * 50_000)], "page_id long, url string, html string"), folder)
    recs = warc.read_warc(spark, folder)
    assert warc.reassemble(recs.where("segment IS NULL OR segment <> 3")).first().status == "missing segment"
    wrong = recs.withColumn("total", F.when(F.col("total").isNotNull(), F.col("total") + 1))
    assert warc.reassemble(wrong).first().status == "wrong total length"
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
