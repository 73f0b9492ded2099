"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three machines are compiled from a model file: the normaliser (a dummy prefix, spaces written as U+2581), the pieces (a
dictionary whose entries are the arcs from place to place of a text), and byte fallback (an arc for each character that
no piece has, which spells its UTF-8 bytes). A text composed with them is a lattice, and the encoding is its shortest
path in the tropical semiring. For a unigram model an arc costs its negated score. For a BPE model the state is the last
piece, and an arc costs 0 if its piece may follow that one and infinity if not: two pieces may stand side by side if
merging their text anew gives just them. That leaves the one path that the merges make, and no merge is ever simulated on
a text; the pairs are compiled as they are met. Only if equal scores leave a text no path at all do merges decide.

No piece goes on past a space into the next word, so lattices are cut there, and each worker remembers the paths of
the last words it has met, CACHE of them at most.

Null text is empty text and has no pieces. Texts that already hold U+2581 decode to a space there, as in the library.
Only identity normalisation is compiled; a model with a character map is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE = 400_000
# Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return n, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


class Model:
    """A model file's pieces, scores and settings."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict = {}
        normal: dict = {}
        for n, v in fields(data):
            if n == 1:
                p = dict(fields(v))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.types.append(p.get(3, NORMAL))
            elif n == 2:
                trainer = dict(fields(v))
            elif n == 3:
                normal = dict(fields(v))
        self.kind = trainer.get(3, UNIGRAM)
        self.prefix, self.strip, self.escape = bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1))
        if normal.get(2) or not self.escape or self.kind not in (UNIGRAM, BPE) or USER in self.types:
            raise ValueError("only unigram and BPE models without a character map and user symbols are compiled")
        if self.strip:
            raise ValueError("models that strip spaces can't be decoded back")


class Transducer:
    def __init__(self, data: bytes):
        m = self.model = Model(data)
        self.arcs = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(m.types) if t == UNKNOWN), 0)
        self.longest = max(map(len, self.arcs), default=1)
        self.chars = {c for p in self.arcs for c in p}
        self.begins = {p[:k] for p in self.arcs for k in range(1, len(p) + 1)}
        # a word is cut off before its spaces only if no piece holds a space after something else
        whole = any(SPACE in p.lstrip(SPACE) for p in self.arcs)
        line = "" if "\n" in self.chars else "\n"
        self.words = re.compile(r"(?s).+" if whole else rf"{'|'.join([line] * bool(line) + [f'{SPACE}*[^{SPACE}{line}]+', f'{SPACE}+'])}")
        self.follows: dict[str, dict[str, bool]] = {}
        self.memory: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        return (SPACE if self.model.prefix and text else "") + text.replace(" ", SPACE)

    def merge(self, text: str) -> list[str]:
        """Pieces of a text by merges, best score first and leftmost among equals; for the compiler. Linear but for a heap's logarithm."""
        parts, scores, arcs, n = list(text), self.model.scores, self.arcs, len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int) -> tuple[float, int, str] | None:
            j = after[i]
            k = arcs.get(parts[i] + parts[j]) if j < n else None
            return None if k is None else (-scores[k], i, parts[i] + parts[j])

        heap = [p for i in range(n) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != whole:
                continue  # one of the two has merged elsewhere
            parts[i], parts[j], after[i] = whole, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        return [p for p in parts if p]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether b may stand after a; a is empty where nothing can merge with b."""
        if len(self.follows) > 50_000:
            self.follows.clear()
        got = self.merge(a + b) == ([a, b] if a else [b])
        self.follows.setdefault(a, {})[b] = got
        return got

    def path(self, word: str) -> list[str]:
        """The shortest path through a word's lattice; characters without a piece come alone."""
        if self.model.kind == BPE:
            return self.bpe_path(word)
        arcs, n = self.arcs, len(word)
        longest = self.longest
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
        least = min((s for s, t in zip(self.model.scores, self.model.types, strict=True) if t == NORMAL), default=0.0) - 10.0
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                k = arcs.get(word[start:end])
                cost = -self.model.scores[k] if k is not None else -least if end - start == 1 else math.inf
                if best[start][0] + cost < best[end][0]:
                    best[end] = (best[start][0] + cost, start)
        out = []
        while n:
            out.append(word[best[n][1] : n])
            n = best[n][1]
        return out[::-1]

    def bpe_path(self, word: str) -> list[str]:
        """All finite paths cost 0, so the first that a search in depth reaches is a shortest one.

        What stands before a place that the search has reached is the one encoding of that part, so a place from which
        the end can't be reached once never can, and every place is left but once.
        """
        arcs, begins, follows, n = self.arcs, self.begins, self.follows, len(word)
        out: list[str] = []
        ways: list[list[str]] = []  # at each step, the arcs not tried yet, the longest last
        at, last, dead = 0, "", set()
        while True:
            options: list[str] = []
            end = at + 1
            while end <= n and (piece := word[at:end]) in begins:
                if piece in arcs:
                    options.append(piece)
                end += 1
            if end == at + 1:
                options.append(word[at])  # a character that no piece has: bytes, which merge with nothing
            while True:
                known = follows.get(last) or {}
                while options:
                    piece = options.pop()
                    if at + len(piece) in dead:
                        continue
                    ok = known.get(piece)
                    if ok is None:
                        ok = piece not in arcs or self.may_follow(last, piece)
                    if ok:
                        break
                else:
                    dead.add(at)
                    if not out:
                        return self.split(word)
                    at -= len(out.pop())
                    last = out[-1] if out and out[-1] in arcs else ""
                    options = ways.pop()
                    continue
                break
            out.append(piece)
            ways.append(options)
            at += len(piece)
            last = piece if piece in arcs else ""
            if at == n:
                return out

    def split(self, word: str) -> list[str]:
        """merge, but characters that no piece has keep what's around them apart."""
        out, run = [], ""
        for c in word:
            if c in self.arcs or c in self.chars:
                run += c
            else:
                out += [*(self.merge(run) if run else []), c]
                run = ""
        return out + (self.merge(run) if run else [])

    def word(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers."""
        ids: list[int] = []
        for p in self.path(word):
            k = self.arcs.get(p)
            if k is not None:
                ids.append(k)
            elif self.bytes:
                ids += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        got = np.array(ids, "<i4").tobytes()
        if len(word) <= 64:
            self.memory[word] = got
        return got

    def encode(self, text: str) -> bytes:
        words = self.words.findall(self.normalise(text))
        if len(self.memory) > CACHE:
            self.memory.clear()
        known = self.memory.get
        got = list(map(known, words))
        if None in got:
            got = [g if g is not None else known(w) or self.word(w) for g, w in zip(got, words, strict=True)]
        return b"".join(got)

    def encode_ids(self, text: str) -> list[int]:
        return np.frombuffer(self.encode(text), "<i4").tolist()

    def decode(self, ids) -> str:
        """The text that the ids spell; bytes that aren't UTF-8 become U+FFFD, control pieces nothing."""
        if not hasattr(self, "spelled"):
            m = self.model
            raw = {i: bytes([b]) for b, i in self.bytes.items()}
            self.spelled = [raw.get(i, b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode()) for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True))]
        out = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.model.prefix and out.startswith(" ") else out


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encode(model: bytes, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer(model)
        for b in batches:
            for k in range(0, b.num_rows, 512):  # a few texts at a time
                part = b.slice(k, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                raw = [t.encode(x) for x in texts]
                sizes = np.array([len(r) // 4 for r in raw], np.int64)
                flat = np.frombuffer(b"".join(raw), "<i4")
                decoded = [t.decode(np.frombuffer(r, "<i4").tolist()) for r in raw]
                same = pa.array([d == x.replace(SPACE, " ") for d, x in zip(decoded, texts, strict=True)], pa.bool_())
                n = pa.array(sizes, pa.int64())
                if digest:
                    cols = [part.column(0), n, pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]), same]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])
                else:
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), ids, n, pa.array(decoded), same], ["doc_id", "ids", "n_pieces", "decoded", "round_trip"])

    return run


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """docs (doc_id, text, ..) -> doc_id, ids, n_pieces, decoded, round_trip (the decoded text is the text, U+2581 read as a space)."""
    textscan.small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_encode(model, False), f"doc_id {kind}, ids array<int>, n_pieces bigint, decoded string, round_trip boolean")


def digest_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """As encode_documents, with SHA-256 of the ids (little-endian 32-bit) and of the decoded text in place of both."""
    textscan.small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_encode(model, True), f"doc_id {kind}, n_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def decode_rows(rows: DataFrame, model: bytes) -> DataFrame:
    """rows (doc_id, ids, ..) -> doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", F.col("ids")).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
