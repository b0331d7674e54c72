"""BPE encoding and decoding as streaming transducers with bounded lookahead.

``MergeList.lookahead`` is computed from the merge list: the most symbols left of a change of the
right context that the change can still alter. A run of merges that reacts to another right context
moves the first differing boundary leftwards only by a merge of higher rank whose right part begins
at that boundary, so the longest such chain of rising ranks bounds it. ``WordTransducer`` therefore
reads symbols into a buffer, and whenever the buffer holds twice the lookahead it emits the tokens
that end at least a lookahead before its end: nothing that follows can change them. Its memory is
constant for words of any length. ``TokenDecoder`` turns ids into text one at a time.

Texts are read in portions of ``PORTION`` bytes, piece by piece (a piece ends at a space or a line
feed, which no token crosses), and a bounded table remembers the ids of short pieces met before. A
run without space and line feed is one portion, held as bytes, text and 32-bit ids.

Defined results: null and empty texts have no tokens and decode to the empty string. Rows are handled
alone; an empty table gives an empty one; extra columns are kept, and one that bears an added name is
replaced. The tokenizer file is a parameter; its truncation and padding are not applied.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .blocks import small_batches, text_blocks
from .piecetable import PORTION, PieceTable, Store, distinct, piece_keys, piece_spans, portions

SLOT_BITS = 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeList:
    """Vocabulary and merges of a tokenizer file, and the sufficient lookahead in symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.after: dict[str, dict[str, int]] = {}
        for (a, b), r in self.ranks.items():
            self.after.setdefault(a, {})[b] = r
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.nfc = any(s["type"] == "NFC" for s in steps)
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.pattern = next((s["pattern"]["Regex"] for s in pre if s["type"] == "Split"), None)
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.lookahead = self._lookahead(pairs)

    def _symbols(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        left_of = {a + b: a for a, b in pairs}
        reach: dict[str, int] = {}  # by token: symbols that merges of higher rank can reach beyond it
        for a, b in reversed(pairs):
            far = self._symbols(a) + reach.get(a, 0)
            while b is not None:
                if reach.get(b, 0) < far:
                    reach[b] = far
                b = left_of.get(b)
        return max(reach.values(), default=0) + max((self._symbols(t) for t in self.vocab), default=1)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges by rank, leftmost first, until none applies."""
        none, nothing, after = len(self.ranks), {}, self.after
        rank = [after.get(a, nothing).get(b, none) for a, b in zip(symbols, symbols[1:])]
        while rank:
            best = min(rank)
            if best == none:
                break
            i = rank.index(best)
            new = symbols[i] + symbols[i + 1]
            symbols[i : i + 2] = [new]
            del rank[i]
            if i:
                rank[i - 1] = after.get(symbols[i - 1], nothing).get(new, none)
            if i < len(rank):
                rank[i] = after.get(new, nothing).get(symbols[i + 1], none)
        return symbols


class WordTransducer:
    """Ids of one word, its bytes fed in any portions; emits tokens once they are stable."""

    def __init__(self, merges: MergeList) -> None:
        self.m, self.table = merges, byte_symbols()
        self.pending: list[str] = []

    def feed(self, data: bytes) -> Iterator[int]:
        room = 2 * self.m.lookahead + 2
        if len(self.pending) + len(data) <= room:
            self.pending += [self.table[b] for b in data]
            return
        for at in range(0, len(data), room):
            self.pending += [self.table[b] for b in data[at : at + room]]
            while len(self.pending) > room:
                yield from self._stable(room)

    def _stable(self, room: int) -> Iterator[int]:
        done = 0
        for token in self.m.merge(self.pending[:room]):
            if done + len(token) > room - self.m.lookahead:
                break
            done += len(token)
            yield self.m.vocab[token]
        del self.pending[:done]

    def finish(self) -> Iterator[int]:
        if self.pending:
            self.pending[-1] += self.m.suffix
            for token in self.m.merge(self.pending):
                yield self.m.vocab[token]
        self.pending = []


class PieceEncoder:
    """Ids of a piece of text without space or line feed: special tokens, normaliser, words."""

    def __init__(self, merges: MergeList) -> None:
        self.m = merges
        self.words = regex.compile(merges.pattern) if merges.pattern else None
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(merges.special, key=len, reverse=True)) + ")") if merges.special else None
        self.transducer = WordTransducer(merges)

    def _normal(self, s: str) -> str:
        if self.m.nfc and not s.isascii():
            s = unicodedata.normalize("NFC", s)
        if self.m.lower:
            s = s.lower() if s.isascii() else "".join(c.lower() for c in s)
        return s

    def encode(self, piece: str) -> Iterator[int]:
        if piece.isascii() and piece.isalpha():  # one word of the common pattern, whatever the case
            yield from self._word(self._normal(piece))
            return
        for part in self.special.split(piece) if self.special and "<" in piece else (piece,):
            if part in self.m.special:
                yield self.m.special[part]
                continue
            part = self._normal(part)
            for word in (x.group() for x in self.words.finditer(part)) if self.words else (part,):
                yield from self._word(word)

    def _word(self, word: str) -> Iterator[int]:
        yield from self.transducer.feed(word.encode())
        yield from self.transducer.finish()


class TokenDecoder:
    """Ids to text, one at a time.

    A tokenizer file that declares no decoder has its token strings joined by one blank (mode
    ``tokens``). Mode ``text`` undoes the byte symbols: bytes wait until they complete a UTF-8
    character (a byte that can't is U+FFFD) and an end-of-word mark becomes a blank.
    """

    def __init__(self, merges: MergeList, mode: str | None = None) -> None:
        self.m = merges
        self.mode = mode or ("text" if merges.decoder else "tokens")
        self.first = True
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.wait = bytearray()

    def _bytes(self, data: bytes, last: bool = False) -> str:
        out = []
        for b in data:
            need = 1 if not self.wait or self.wait[0] < 0xC2 else 2 if self.wait[0] < 0xE0 else 3 if self.wait[0] < 0xF0 else 4
            if self.wait and not 0x80 <= b < 0xC0:
                out.append("�")
                self.wait.clear()
            self.wait.append(b)
            lead = self.wait[0]
            need = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
            if len(self.wait) >= need:
                out.append(self.wait.decode(errors="replace") if need else "�")
                self.wait.clear()
        if last and self.wait:
            out.append("�")
            self.wait.clear()
        return "".join(out)

    def step(self, token_id: int) -> str:
        token = self.m.tokens[token_id]
        if self.mode == "tokens":
            lead = "" if self.first else " "
            self.first = False
            return lead + token
        if token in self.m.special:
            return self._bytes(b"", True) + token
        word_end = bool(self.m.suffix) and token.endswith(self.m.suffix)
        token = token.removesuffix(self.m.suffix) if word_end else token
        return self._bytes(bytes(self.byte_of[c] for c in token), word_end) + (" " if word_end else "")

    def finish(self) -> str:
        self.first = True
        return self._bytes(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join([self.step(i) for i in ids]) + self.finish()

    def decode_array(self, ids: np.ndarray, step: int = 1 << 14) -> bytes:
        """UTF-8 text of an array of ids, ``step`` of them as objects at a time."""
        said = ["".join([self.step(i) for i in ids[k : k + step].tolist()]).encode() for k in range(0, len(ids), step)]
        return b"".join(said) + self.finish().encode()


class RememberedPieces:
    """Ids and decoded text of the pieces of texts, by the transducers; a bounded table remembers short pieces."""

    MOST_NUMBERS = 1 << 23

    def __init__(self, merges: MergeList, bits: int = SLOT_BITS) -> None:
        self.encoder, self.decoder = PieceEncoder(merges), TokenDecoder(merges)
        self.gap = b" " if self.decoder.mode == "tokens" else b""
        self.table, self.ids, self.said = PieceTable(bits, 4), Store(np.uint32), Store(np.uint8)

    def coded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all documents and their bounds, decoded bytes (a gap behind each piece) and their bounds."""
        if self.table.full or max(self.ids.used, self.said.used // 2) > self.MOST_NUMBERS:
            self.table.clear()
            self.ids.used = self.said.used = 0
        begins, ends = piece_spans(data, offsets)
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        bounds = np.searchsorted(start, offsets)
        keys = piece_keys(data, start, end)
        slot = self.table.find(keys)
        of = self.table.values[:, slot].astype(np.int64)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            first, which = distinct(keys[:, miss])
            first = miss[first]
            raw = data.tobytes()
            ids, said = [], []
            for a, e in zip(start[first].tolist(), end[first].tolist(), strict=True):
                one = np.fromiter(self.encoder.encode(raw[a:e].decode()), np.uint32)
                ids.append(one)
                text = self.decoder.decode_array(one)
                said.append(text + self.gap if text else b"")
            n_ids, n_said = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids, said))
            at_ids = self.ids.add(np.concatenate(ids), n_ids)
            at_said = self.said.add(np.frombuffer(b"".join(said), np.uint8), n_said)
            values = np.stack([at_ids, n_ids, at_said, n_said])
            of[:, miss] = values[:, which]
            short = end[first] - start[first] <= PieceTable.LONGEST
            self.table.insert(keys[:, first[short]], values[:, short])
        ids, edges = self.ids.gather(of[0], of[1])
        said, said_edges = self.said.gather(of[2], of[3])
        return ids, edges[bounds], said, said_edges[bounds]


def encode_and_decode(df: DataFrame, tokenizer: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 (and ``ids``) to each row; the text column goes."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    types = [pa.int64(), pa.string(), pa.string()]
    if keep_ids:
        fields, types = [*fields, T.StructField("ids", T.BinaryType())], [*types, pa.binary()]
    new = {f.name for f in fields} | {text}
    kept = [f for f in df.schema.fields if f.name not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_pieces(tokenizer)
        gap = len(known.gap)
        for b in text_blocks(batches, text, PORTION):
            cols: list[list] = [[] for _ in fields]

            def put(n: int, ids_sha: str, said_sha: str, ids: bytes, cols: list[list] = cols) -> None:
                for c, x in zip(cols, (n, ids_sha, said_sha, ids), strict=False):
                    c.append(x)

            if len(b) == 1 and len(b.data) > 2 * PORTION:
                n, ids_sha, said_sha, wait, kept_ids = 0, hashlib.sha256(), hashlib.sha256(), b"", []
                for part in portions(b.data, PORTION):
                    ids, _, said, _ = known.coded(part, np.array([0, len(part)]))
                    n += len(ids)
                    ids_sha.update(ids.tobytes())
                    said = wait + said.tobytes()
                    # The gap behind the last piece of all isn't part of the text.
                    wait = said[len(said) - gap :] if gap else b""
                    said_sha.update(said[: len(said) - gap])
                    if keep_ids:
                        kept_ids.append(ids.tobytes())
                put(n, ids_sha.hexdigest(), said_sha.hexdigest(), b"".join(kept_ids))
            else:
                ids, at, said, said_at = known.coded(b.data, b.offsets)
                for i in range(len(b)):
                    one = ids[at[i] : at[i + 1]].tobytes()
                    put(len(one) // 4, hashlib.sha256(one).hexdigest(), hashlib.sha256(said[said_at[i] : max(said_at[i], said_at[i + 1] - gap)].tobytes()).hexdigest(), one)
            yield pa.RecordBatch.from_arrays([b.rows.column(b.rows.schema.get_field_index(f.name)) for f in kept] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.name for f in kept + fields])

    return small_batches(df).mapInArrow(run, T.StructType(kept + fields))


_KNOWN: dict[str, RememberedPieces] = {}


def known_pieces(path: str) -> RememberedPieces:
    """The pieces that this Python worker remembers, from one task to the next."""
    if path not in _KNOWN:
        merges = MergeList(path)
        _KNOWN[path] = RememberedPieces(merges)
    return _KNOWN[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text through the encoding and the decoding transducer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_and_decode(docs, default_tokenizer())
