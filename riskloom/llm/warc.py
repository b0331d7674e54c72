"""WARC archives: writing with deduplication and segmentation, and segment reassembly.

``write_warc`` writes a ``response`` record for each page, or a ``revisit`` of the page with the
smallest id that has the same payload. The HTTP block uses chunked transfer framing; a block of more
than ``segment_bytes`` is cut into segments, whose ``continuation`` records go to an archive of
their own. ``read_warc`` parses the archives into record rows, and ``reassemble`` groups
continuation records by origin identifier, orders them by segment number, checks that the numbers
have no gap and that the lengths add up, and decodes the chunked framing. Blocks without segments
skip the grouping. A group is the segments of one record, never more.

Tasks write under names of their own attempt; the manifest lists those that Spark accepted.

Defined results: null html is an empty payload; null url is written as an empty URI; repeated rows
give a row each, with equal results, and all rows of a payload's smallest page id are its response;
a null page id stays null, counts as larger than any other when the response is chosen; an
incomplete record has a null payload and says why in ``status``; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import shared_dir, small_batches

SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
ARCHIVE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20
SPACE = uuid.UUID("5b5b8f4e-0a4e-4d5c-9d58-0d6f6e1f2a77")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}|{digest}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are allowed, a cut body raises."""
    out, at = [], 0
    while True:
        line_end = body.index(b"\r\n", at)
        size = int(body[at:line_end].split(b";")[0], 16)
        at = line_end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


class Archive:
    """One growing archive of gzip members, a member a record."""

    def __init__(self, folder: str) -> None:
        self.fs, base = fs.FileSystem.from_uri(folder)
        self.path = f"{base}/{uuid.uuid4().hex}.warc.gz"
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.at = self.records = 0

    def add(self, fields: dict[str, str], block: bytes) -> None:
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
        member = gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)
        self.out.write(member)
        self.at += len(member)
        self.records += 1


def write_warc(pages: DataFrame, folder: str, least_revisit: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html); the manifest: one row an archive."""
    spark = pages.sparkSession
    pages = small_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    slim = pages.select("page_id", "sha", F.octet_length("html").alias("n")).where(F.col("n") >= least_revisit)
    first = slim.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first_id IS NOT NULL").drop("copies")
    # Only ids and digests meet by content; the pages themselves are dealt by page and content, so a
    # page that is everywhere has no task of its own.
    later = slim.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(F.xxhash64("page_id", "sha").alias("k"), F.col("first_id").alias("refers")).distinct()
    rows = pages.withColumn("k", F.xxhash64("page_id", "sha")).join(later, "k", "left").select("page_id", "url", "html", "refers")
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Archive] = {}
        done: list[tuple[str, int, int]] = []

        def put(kind: str, fields: dict[str, str], block: bytes) -> None:
            if kind not in open_:
                open_[kind] = Archive(folder)
            a = open_[kind]
            a.add(fields, block)
            if a.at >= ARCHIVE_BYTES:
                close(kind)

        def close(kind: str) -> None:
            a = open_.pop(kind)
            a.out.close()
            done.append((a.path, a.records, a.at))

        for b in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = html.encode()
                digest = digest32(payload)
                rid = record_id(page, digest)
                uri = "".join(c for c in url or "" if c.isprintable())
                fields = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": rid, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Page-ID": "" if page is None else str(page), "Content-Type": "application/http;msgtype=response"}
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if refers is not None:
                    fields |= {"WARC-Refers-To": record_id(refers, digest), "WARC-Refers-To-Page-ID": str(refers), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    put("main", fields, http + b"X-Payload-Length: %d\r\n\r\n" % len(payload))
                    continue
                block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
                if len(block) <= segment_bytes:
                    put("main", fields, block)
                    continue
                put("main", fields | {"WARC-Segment-Number": "1"}, block[:segment_bytes])
                for k, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
                    more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Target-URI": uri, "WARC-Segment-Origin-ID": rid, "WARC-Segment-Number": str(k)}
                    if at + segment_bytes >= len(block):
                        more["WARC-Segment-Total-Length"] = str(len(block))
                    put("more", more, block[at : at + segment_bytes])
        for kind in list(open_):
            close(kind)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x, strict=True)) for x in done])

    rows.mapInArrow(run, "path string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an uncompressed archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive is cut short")
        yield fields, block


RECORD = "record_id string, type string, page_id long, refers_to long, digest string, origin_id string, segment int, total long, block binary"
_TYPES = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record of the archives in the manifest."""
    manifest = spark.read.parquet(f"{folder}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with files.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as member:
                    for f, block in records(io.BufferedReader(member, 1 << 18)):
                        whole = lambda k, f=f: int(f[k]) if f.get(k) else None
                        rows.append((f["warc-record-id"], f["warc-type"], whole("warc-page-id"), whole("warc-refers-to-page-id"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, f.get("warc-segment-origin-id"), whole("warc-segment-number"), whole("warc-segment-total-length"), block))
                        size += len(block)
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(run, RECORD)


def reassemble(recs: DataFrame) -> DataFrame:
    """Response and revisit records with whole blocks: segments joined, verified and unchunked.

    Adds payload (null for a revisit or an incomplete record), payload_bytes, payload_digest, status.
    """
    main = recs.where("type <> 'continuation'")
    alone = main.where("segment IS NULL").withColumn("parts", F.lit(None).cast("array<struct<segment:int,total:bigint,block:binary>>"))
    more = recs.where("type = 'continuation'").groupBy(F.col("origin_id").alias("record_id")).agg(F.array_sort(F.collect_set(F.struct("segment", "total", "block"))).alias("parts"))
    # Spark takes the records for as small as the manifest they are read from, so it must not choose a broadcast.
    cut = main.where("segment IS NOT NULL").hint("merge").join(more.hint("merge"), "record_id", "left").select(*main.columns, "parts")
    schema = "page_id long, type string, refers_to long, payload binary, payload_bytes long, payload_digest string, status string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kind, page, refers, digest, segment, block, parts in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("type", "page_id", "refers_to", "digest", "segment", "block", "parts")), strict=True):
                status = "ok"
                if segment is not None:
                    parts = parts or []
                    numbers = [p["segment"] for p in parts]
                    whole = block + b"".join(p["block"] for p in parts)
                    if segment != 1 or numbers != list(range(2, len(parts) + 2)) or not parts or parts[-1]["total"] is None:
                        status = "missing segment"
                    elif parts[-1]["total"] != len(whole):
                        status = "wrong total length"
                    block = whole
                if kind == "revisit":
                    n = next((int(x.split(b":")[1]) for x in block.split(b"\r\n") if x.lower().startswith(b"x-payload-length:")), None)
                    out.append((page, kind, refers, None, n, digest, status))
                    continue
                payload = None
                if status == "ok":
                    try:
                        payload = payload_of(block)
                    except ValueError:
                        status = "broken framing"
                found = digest32(payload) if payload is not None else None
                if payload is not None and digest and found != digest:
                    status = "wrong digest"
                out.append((page, kind, refers, payload, None if payload is None else len(payload), found, status))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "type", "refers_to", "payload", "payload_bytes", "payload_digest", "status"])

    return alone.select(*main.columns, "parts").unionByName(cut).mapInArrow(run, schema)


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as segmented archives, written, read back and reassembled."""
    folder = shared_dir(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    back = reassemble(read_warc(spark, folder))
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "status")
