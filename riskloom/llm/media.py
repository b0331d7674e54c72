"""Media columns: baseline JPEG images, read as DC-only luminance thumbnails.

``store_as_jpeg`` keeps bytes losslessly in a grey baseline JPEG: one 8x8 block a byte, whose DC
coefficient (quantiser 8) is the byte, so each block decodes to a flat patch of that sample value
and the thumbnail at one eighth scale is the payload. ``jpeg_thumbnails`` reads any baseline JPEG:
it parses the markers, decodes the Huffman scans of many restart intervals in lockstep (all AC
coefficients are skipped) and returns dimensions, luminance thumbnail and thumbnail hash.

Defined results: null and empty text give one row of 64 zero bytes; an image longer than 65,535
lines continues in a further JPEG stream of the same column value; bytes that aren't a baseline
JPEG raise ``ValueError`` (``jpeg_thumbnails(..., on_error="null")`` gives nulls instead). Rows are
handled alone, so ties, repeated rows and extra columns need no rule; extra columns are kept unless
they bear a name that the operator adds, which then is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import small_batches, text_blocks

ROW = 64
MAX_ROWS = 8191

# The code length of each DC size category, and the one AC code (end of block).
DC_LENGTHS = {0: 5, 1: 4, 2: 3, 3: 3, 4: 2, 5: 4, 6: 5, 7: 2, 8: 6}
AC_LENGTHS = {0x00: 1}


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A DHT body (counts and symbols) and {symbol: (code, length)}."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(1 for s in order if lengths[s] == n) for n in range(1, 17))
    code, last, out = 0, 0, {}
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    return counts + bytes(order), out


_DC_BODY, _DC_CODES = _canonical(DC_LENGTHS)
_AC_BODY, _AC_CODES = _canonical(AC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\x01\x01\x00\x00\x01\x00\x01\x00\x00")
        + _segment(0xDB, b"\x00" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + _DC_BODY)
        + _segment(0xC4, b"\x10" + _AC_BODY)
        + _segment(0xDD, struct.pack(">H", ROW))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference + 255: code with its value bits and the end-of-block code, and their length."""
    code, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    eob, eob_len = _AC_CODES[0]
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = _DC_CODES[size]
        value = d if d >= 0 else d + (1 << size) - 1
        code[d + 255] = ((c << size | value) << eob_len) | eob
        length[d + 255] = n + size + eob_len
    return code, length


_CODE, _LENGTH = _diff_codes()


def encode_payloads(payload: np.ndarray, rows_of: np.ndarray) -> list[bytes]:
    """JPEG streams of payloads that stand one behind the other; ``rows_of``: their rows of 64 bytes."""
    px = payload.reshape(-1, ROW).astype(np.int16) - 128
    diff = px.copy()
    diff[:, 1:] -= px[:, :-1]
    diff += 255
    code, length = _CODE[diff], _LENGTH[diff]
    offset = np.cumsum(length, axis=1)
    bits = offset[:, -1].copy()
    offset -= length
    size = (bits + 7) >> 3
    start = np.cumsum(size) - size
    total = int(size.sum())
    at = (offset >> 3) + start[:, None]
    value = (code << (24 - (offset & 7) - length).astype(np.uint32)).ravel()
    at = at.ravel()
    raw = np.bincount(at, value >> 16, total + 2)
    raw[1:] += np.bincount(at, (value >> 8) & 255, total + 2)[:-1]
    raw[2:] += np.bincount(at, value & 255, total + 2)[:-2]
    scan = raw[:total].astype(np.uint8)
    pad = (size << 3) - bits
    scan[start + size - 1] |= ((1 << pad) - 1).astype(np.uint8)
    # Images of at most MAX_ROWS rows: (document, first row, rows).
    images = [(d, r0, min(MAX_ROWS, n - r0)) for d, n in enumerate(rows_of.tolist()) for r0 in range(0, n, MAX_ROWS)]
    n_rows = np.array([n for _, _, n in images])
    first = np.cumsum(n_rows) - n_rows
    ff = scan == 0xFF
    stuffed = np.concatenate([[0], np.cumsum(ff)])
    row_out = size + (stuffed[start + size] - stuffed[start]) + 2
    heads = [_header(n) for _, _, n in images]
    head_len = np.array([len(h) for h in heads])
    lead = np.zeros(len(size), np.int64)
    lead[first] = head_len
    row_at = np.cumsum(row_out + lead) - row_out
    out = np.zeros(int((row_out + lead).sum()), np.uint8)
    row_of = np.repeat(np.arange(len(size)), size)
    to = np.arange(total) - start[row_of] + row_at[row_of] + stuffed[:-1] - stuffed[start][row_of]
    out[to] = scan
    ends = row_at + row_out - 2
    out[ends] = 0xFF
    out[ends + 1] = 0xD0 + ((np.arange(len(size)) - np.repeat(first, n_rows)) & 7)
    out[ends[first + n_rows - 1] + 1] = 0xD9
    image_at = row_at[first] - head_len
    for a, h in zip(image_at.tolist(), heads, strict=True):
        out[a : a + len(h)] = np.frombuffer(h, np.uint8)
    image_end = np.append(image_at[1:], len(out))
    docs: list[list[bytes]] = [[] for _ in rows_of]
    for (d, _, _), a, b in zip(images, image_at.tolist(), image_end.tolist(), strict=True):
        docs[d].append(out[a:b].tobytes())
    return [x[0] if len(x) == 1 else b"".join(x) for x in docs]


class _Frame:
    """What the markers of one JPEG stream say; ``tables`` is equal for streams that decode alike."""

    __slots__ = ("blocks", "dri", "height", "luma", "mcus", "quant", "scan", "tables", "width")


def parse_markers(data: bytes, at: int = 0) -> tuple[_Frame, int]:
    """The frame that starts at ``at``, and the place behind its EOI marker."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    f, p = _Frame(), at + 2
    dht: dict[int, bytes] = {}
    dqt: dict[int, int] = {}
    comps: list[tuple[int, int, int, int]] = []
    f.dri = 0
    while True:
        if p + 4 > len(data) or data[p] != 0xFF:
            raise ValueError("broken marker")
        marker = data[p + 1]
        if marker == 0xFF:
            p += 1
            continue
        n = struct.unpack_from(">H", data, p + 2)[0]
        body = data[p + 4 : p + 2 + n]
        p += 2 + n
        if marker == 0xDB:
            q = 0
            while q < len(body):
                wide = body[q] >> 4
                dqt[body[q] & 15] = struct.unpack_from(">H" if wide else ">B", body, q + 1)[0]
                q += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            q = 0
            while q < len(body):
                k = 17 + sum(body[q + 1 : q + 17])
                dht[body[q]] = body[q + 1 : q + k]
                q += k
        elif marker == 0xC0:
            bits, f.height, f.width, k = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only 8-bit samples are baseline")
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
        elif marker == 0xDD:
            f.dri = struct.unpack(">H", body)[0]
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            break
    if not comps or body[0] != len(comps):
        raise ValueError("one interleaved scan is expected")
    use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    if len(comps) == 1:
        hmax = vmax = 1
        comps = [(comps[0][0], 1, 1, comps[0][3])]
    f.mcus = (-(-f.width // (8 * hmax)), -(-f.height // (8 * vmax)))
    f.luma = (comps[0][1], comps[0][2])
    f.quant = dqt[comps[0][3]]
    f.blocks = tuple(i for i, c in enumerate(comps) for _ in range(c[1] * c[2]))
    f.tables = (f.blocks, tuple((dht[use[c[0]] >> 4], dht[16 | (use[c[0]] & 15)]) for c in comps))
    end = p
    while True:
        end = data.index(b"\xff", end)
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end += 2
        elif data[end + 1] == 0xFF:
            end += 1
        elif data[end + 1] == 0xD9:
            break
        else:
            raise ValueError("one scan is expected")
    f.scan = (p, end)
    return f, end + 2


def _lookup(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of the next 16 bits: symbol and code length (0: no code)."""
    symbol, length = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int8)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            lo = code << (16 - n)
            symbol[lo : lo + (1 << (16 - n))], length[lo : lo + (1 << (16 - n))] = body[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


_LOOKUPS: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def decode_scans(frames: list[_Frame], scans: list[bytes]) -> list[np.ndarray]:
    """Luminance DC coefficients (mcu, block) of frames with equal ``tables``, decoded in lockstep."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    scan_at = np.cumsum([0] + [len(s) for s in scans])
    after_ff = np.zeros(len(raw), bool)
    after_ff[1:] = raw[:-1] == 0xFF
    after_ff[scan_at[:-1][scan_at[:-1] < len(raw)]] = False
    marker = after_ff & (raw >= 0xD0) & (raw <= 0xD7)
    drop = (after_ff & (raw == 0)) | marker
    drop[:-1] |= marker[1:]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    data = np.concatenate([raw[~drop], np.zeros(4, np.uint8)]).astype(np.uint32)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    per = np.array([f.mcus[0] * f.mcus[1] for f in frames])
    dri = np.array([f.dri or f.mcus[0] * f.mcus[1] for f in frames])
    n_seg = -(-per // dri)
    first = np.cumsum(n_seg) - n_seg
    seg_at = np.zeros(int(n_seg.sum()), np.int64)
    seg_at[first] = kept[scan_at[:-1]]
    others = np.ones(len(seg_at), bool)
    others[first] = False
    seg_at[others] = kept[np.flatnonzero(marker) + 1]
    image = np.repeat(np.arange(len(frames)), n_seg)
    count = np.minimum(dri[image], per[image] - (np.arange(len(seg_at)) - first[image]) * dri[image])
    blocks, bodies = frames[0].tables
    lut = []
    for body in (b for pair in bodies for b in pair):
        if body not in _LOOKUPS:
            _LOOKUPS[body] = _lookup(body)
        lut.append(_LOOKUPS[body])
    luma = sum(1 for b in blocks if b == 0)
    out = np.zeros((len(seg_at), int(count.max()), luma), np.int16)
    pos, limit = seg_at << 3, len(window) - 1
    pred = np.zeros((len(bodies), len(seg_at)), np.int32)
    low = [np.int32((1 << s) - 1) for s in range(17)]
    low_of, half_of = np.array(low), np.array([0] + [1 << (s - 1) for s in range(1, 17)], np.int32)

    def peek(p: np.ndarray) -> np.ndarray:
        at = p >> 3
        if int(at.max(initial=0)) > limit:
            raise ValueError("the scan ends too early")
        return (window[at] >> (8 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    for mcu in range(out.shape[1]):
        live = slice(None) if mcu < int(count.min()) else np.flatnonzero(count > mcu)
        here = pos[live]
        seen = 0
        for comp in blocks:
            (dc_sym, dc_len), (ac_sym, ac_len) = lut[2 * comp], lut[2 * comp + 1]
            bits = peek(here)
            size, n = dc_sym[bits], dc_len[bits]
            if not n.all():
                raise ValueError("no such DC code")
            here = here + n
            value = (peek(here) >> (16 - size).astype(np.uint32)).astype(np.int32)
            value -= np.where(value < half_of[size], low_of[size], 0)
            here += size
            pred[comp, live] += value
            if comp == 0:
                out[live, mcu, seen] = pred[0, live]
                seen += 1
            todo, k = None, None
            while True:
                p = here if todo is None else here[todo]
                bits = peek(p)
                sym, n = ac_sym[bits], ac_len[bits]
                if not n.all():
                    raise ValueError("no such AC code")
                p = p + n + (sym & 15)
                if todo is None:
                    here = p
                    if not sym.any():
                        break
                    todo, k = np.arange(len(here)), np.ones(len(here), np.int32)
                else:
                    here[todo] = p
                k = k + (sym >> 4) + 1
                go = (sym != 0) & (k < 64)
                todo, k = todo[go], k[go]
                if not len(todo):
                    break
        pos[live] = here
    return [out[a : a + n].reshape(-1, luma)[: f.mcus[0] * f.mcus[1]] for f, a, n in zip(frames, first.tolist(), n_seg.tolist(), strict=True)]


def thumbnails(values: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each column value its images: width, height, DC-only luminance at one eighth scale."""
    by: dict[tuple, list[tuple[int, int, _Frame, bytes]]] = {}
    out: list[list] = [[] for _ in values]
    for i, data in enumerate(values):
        at = 0
        while at < len(data):
            frame, end = parse_markers(data, at)
            by.setdefault(frame.tables, []).append((i, len(out[i]), frame, data[slice(*frame.scan)]))
            out[i].append(None)
            at = end
    for group in by.values():
        for (i, k, f, _), dc in zip(group, decode_scans([g[2] for g in group], [g[3] for g in group]), strict=True):
            (cols, rows), (h, v) = f.mcus, f.luma
            grid = dc.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h).astype(np.int32)
            px = np.clip((grid * f.quant + 1024 + 4) >> 3, 0, 255).astype(np.uint8)
            out[i][k] = (f.width, f.height, px[: -(-f.height // 8), : -(-f.width // 8)])
    return out


def average_hash(px: np.ndarray) -> str:
    """64 bits: which of 8 x 8 areas of the thumbnail are lighter than their mean."""
    rows, cols = (np.arange(8) * n // 8 for n in px.shape)
    if min(px.shape) < 8:
        cell = px[np.ix_(rows, cols)].astype(np.float64)
    else:
        cell = np.add.reduceat(np.add.reduceat(px.astype(np.int64), rows, axis=0), cols, axis=1)
        cell = cell / np.outer(np.diff(np.append(rows, px.shape[0])), np.diff(np.append(cols, px.shape[1])))
    return np.packbits(cell.ravel() > cell.mean()).tobytes().hex()


def stacked(images: list[tuple[int, int, np.ndarray]]) -> tuple[int, int, np.ndarray]:
    """All images of a value under one another: the largest width, all heights, thumbnails padded with black."""
    if len(images) == 1:
        return images[0]
    wide = max(px.shape[1] for _, _, px in images)
    return max(w for w, _, _ in images), sum(h for _, h, _ in images), np.concatenate([np.pad(px, ((0, 0), (0, wide - px.shape[1]))) for _, _, px in images])


def _schema(df: DataFrame, fields: list[T.StructField]) -> tuple[list[str], T.StructType]:
    new = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in new]
    return [f.name for f in keep], T.StructType(keep + fields)


def store_as_jpeg(df: DataFrame, text: str = "text", media: str = "media", keep_text: bool = False) -> DataFrame:
    """Add ``n_bytes`` and the JPEG column that holds the text's UTF-8 bytes, zero-padded to rows of 64."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())]
    keep, schema = _schema(df if keep_text else df.drop(text), fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, text, 1 << 20):
            n = np.diff(b.offsets)
            rows = np.maximum(1, -(-n // ROW))
            payload = np.zeros(int(rows.sum()) * ROW, np.uint8)
            start = (np.cumsum(rows) - rows) * ROW
            payload[np.arange(len(b.data)) + np.repeat(start - b.offsets[:-1], n)] = b.data
            images = encode_payloads(payload, rows)
            yield pa.RecordBatch.from_arrays([b.rows.column(b.rows.schema.get_field_index(c)) for c in keep] + [pa.array(n, pa.int64()), pa.array(images, pa.binary())], [*keep, "n_bytes", media])

    return small_batches(df).mapInArrow(run, schema)


def jpeg_thumbnails(df: DataFrame, media: str = "media", on_error: str = "raise") -> DataFrame:
    """Replace the JPEG column by width and height (of all its images under one another), number of images,
    media size and hash, thumbnail bytes (``thumb``, all images one behind the other), ``thumb_hash`` (which
    areas of all images are light) and ``thumb_digest`` (of all thumbnail bytes)."""
    fields = [
        T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("images", T.IntegerType()),
        T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()),
        T.StructField("thumb", T.BinaryType()), T.StructField("thumb_hash", T.StringType()), T.StructField("thumb_digest", T.StringType()),
    ]
    keep, schema = _schema(df.drop(media), fields)

    def read(values: list[bytes]) -> list[list]:
        try:
            return thumbnails(values)
        except (ValueError, KeyError, IndexError, struct.error):
            if on_error == "raise" or len(values) == 1:
                if on_error == "raise":
                    raise
                return [[]]
            return [x for v in values for x in read([v])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, media, 2 << 20):
            values = [b.text(i) for i in range(len(b))]
            cols: list[list] = [[] for _ in fields]
            for value, images in zip(values, read(values), strict=True):
                if images:
                    width, height, px = stacked(images)
                    thumb = b"".join(one.tobytes() for _, _, one in images)
                    row = (width, height, len(images), len(value), hashlib.sha256(value).hexdigest(), thumb, average_hash(px), hashlib.sha256(thumb).hexdigest()[:16])
                else:
                    row = (None, None, 0, len(value), hashlib.sha256(value).hexdigest(), None, None, None)
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.rows.column(b.rows.schema.get_field_index(c)) for c in keep] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*keep, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text kept as a baseline JPEG and read back through its DC-only thumbnail."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = jpeg_thumbnails(store_as_jpeg(docs))
    tail = F.expr("substring(thumb, -64, 64)")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("thumb").cast("long").alias("payload_bytes"),
        F.sha2("thumb", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumb_hash", "thumb_digest").alias("feature"),
        "width",
        "height",
        "images",
    )


def expected_payload(text: str | None) -> tuple[int, bytes, int]:
    """Brute force for tests: unpadded length, padded payload, crc32 of its last 64 bytes."""
    raw = (text or "").encode()
    padded = raw + bytes(-len(raw) % ROW or (ROW if not raw else 0))
    return len(raw), padded, zlib.crc32(padded[-ROW:])


