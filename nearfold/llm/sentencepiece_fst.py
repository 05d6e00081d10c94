"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser (one state;
an arc from space to the space mark, all else as it is, and one mark put out
in front), the pieces (a tree of states over their characters, whose leaves
put out the piece and lead back to a state that remembers it) and the byte
fallback (arcs from characters that no piece covers to their UTF-8 byte
pieces).  A text is composed with them arc by arc, and its ids are the labels
of the shortest path in the tropical semiring (least sum), found best first.

Arc weights of a unigram model are the pieces' negative scores.  Those of a
byte-pair model make the shortest path the merges' result: going from piece x
to piece y costs 0 where merging would leave the boundary between them, else
infinity; the arcs of infinite weight are not made.  These weights are worked
out from the merge order on first use.  No byte-pair piece reads past the
start of a run of spaces, so the path of a text is the paths of its chunks in
a row, and a chunk's path is kept for its next occurrence.  In runs of two
spaces or more all pieces have one score and the leftmost merge wins; their
transducer reads a run from the left, in time in proportion to its length.

Defined results: null text is as empty text and has no ids; decoding gives the
text back but for space marks, which come back as spaces; bytes that are not
UTF-8 decode to U+FFFD; of paths of equal weight the one with the longer
pieces in front wins; null or repeated doc_ids keep their rows; very long
texts and words take time in proportion to their length; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kept, strings, table

MARK = "▁"
UNIGRAM, BPE = 1, 2
ZERO, ONE = float("inf"), 0.0  # of the tropical semiring
#: Distinct chunks, and arc weights, that a worker keeps; beyond it that memory is emptied.
MEMO, WEIGHTS = 400_000, 800_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(b: bytes):
    """(number, value) of each field of a protocol buffer message."""

    def varint(i):
        out = shift = 0
        while True:
            x, i = b[i], i + 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool, int]:
    """(piece, score, type) by id, whether a mark is put in front, and the kind. Refuses what isn't compiled here."""
    pieces, front, kind = [], True, UNIGRAM
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, 1)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
            if kind not in (UNIGRAM, BPE):
                raise ValueError("only unigram and byte-pair models are compiled")
        elif number == 3:
            f = dict(_fields(value))
            front = bool(f.get(3, 1))
            if f.get(2) or f.get(4, 1):
                raise ValueError("only identity normalisers that keep white space are compiled")
    return pieces, front, kind


class Transducer:
    NORMAL, BYTE = 1, 6

    def __init__(self, path: str):
        self.compile(*read_model(path))

    def compile(self, pieces: list[tuple[str, float, int]], front: bool, kind: int) -> None:
        self.front, self.kind = front, kind
        self.text = [p for p, _, _ in pieces]
        self.score = [s for _, s, _ in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == self.NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == self.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: Arcs of the normaliser's state that change what they read.
        self.normal = {" ": MARK}
        self.parts: dict[str, tuple[str, str] | None] = {}
        #: Weights of the arcs from one piece to another, as far as known; and how many are.
        self.weights: dict[str, dict[str, float]] = {}
        self.known = 0
        self.runs: dict[int, list[int]] = {}
        self.memo: dict[str, bytes] = {}
        #: Pieces that have arcs: of a byte-pair model those that merging makes at all.
        self.made = {p: i for p, i in self.ids.items() if kind == UNIGRAM or len(p) == 1 or self.split(p) is not None}
        #: Weight of an arc of the byte fallback: beyond that of any piece, so that it is for characters without one.
        self.unknown = ONE if kind == BPE else 10.0 - min((self.score[i] for i in self.ids.values()), default=0.0)
        if kind == UNIGRAM and max((self.score[i] for i in self.ids.values()), default=0.0) > 0:
            raise ValueError("weights below zero")
        #: The tree of pieces: arcs by character, and the piece that ends in each state.
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for p in self.made:
            state = 0
            for c in p:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(None)
                state = self.arcs[state][c]
            self.ends[state] = p

    # --- compilation ---

    def merge(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """Symbols after all merges, best score first and leftmost of equals; and the last merge."""
        last = None
        while len(symbols) > 1:
            best = None
            for i in range(len(symbols) - 1):
                k = self.ids.get(symbols[i] + symbols[i + 1])
                if k is not None and (best is None or self.score[k] > best[0]):
                    best = (self.score[k], i)
            if best is None:
                break
            i = best[1]
            last = (symbols[i], symbols[i + 1])
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols, last

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes the piece; None for one character and for pieces that merging never makes."""
        if piece not in self.parts:
            symbols, last = self.merge(list(piece))
            self.parts[piece] = last if len(symbols) == 1 else None
        return self.parts[piece]

    def finite(self, x: str, y: str) -> bool:
        """Whether the arc from x to y has weight 0: no merge over their boundary ever comes first.

        Both pieces are taken apart, the one made later first, and at each
        step the parts at the boundary must not merge before what was taken
        apart was made.
        """
        a, b, score, ids, parts = x, y, self.score, self.ids, self.parts
        # Scores of the merges that made the piece a is part of, and b.
        made_a = made_b = float("-inf")
        while True:
            k = ids.get(a + b)
            # On equal scores the leftmost merge wins: the boundary's comes before one to its right only.
            if k is not None and score[k] > made_a and score[k] >= made_b:
                return False
            da, db = parts.get(a), parts.get(b)
            if da is None and db is None:
                return True
            if db is None or da is not None and score[ids[a]] < score[ids[b]]:
                made_a, a = score[ids[a]], da[1]
            else:
                made_b, b = score[ids[b]], db[0]

    def weight(self, x: str, y: str) -> float:
        """Weight of the arc from the state after piece x (empty: at the start, or after bytes) over piece y."""
        if self.kind == UNIGRAM:
            return -self.score[self.made[y]]
        return ONE if not x or self.finite(x, y) else ZERO

    def run(self, n: int) -> list[int]:
        """Pieces of n space marks in a row: the leftmost of two neighbours that merge, as long as any do."""
        if n not in self.runs:
            sizes = {len(p) for p in self.ids if not p.strip(MARK)}
            done: list[int] = []
            left = n
            while left:
                size, left = 1, left - 1
                while not (done and done[-1] + size in sizes) and left and size + 1 in sizes:
                    size, left = size + 1, left - 1
                done.append(size)
                while len(done) > 1 and done[-2] + done[-1] in sizes:
                    size = done.pop()
                    done[-1] += size
            out = [self.ids[MARK * k] for k in done]
            if n > 256:
                return out
            self.runs[n] = out
        return self.runs[n]

    # --- composition and shortest path ---

    def path(self, s: str) -> list[int]:
        """Labels of the shortest path of a normalised chunk, best first; of equal weights the furthest."""
        arcs, ends, made, known, n = self.arcs, self.ends, self.made, self.weights, len(s)
        heap, back = [(ONE, 0, "", 0, "")], {}
        while heap:
            total, place, last, at, before = heappop(heap)
            here = (-place, last)
            if here in back:
                continue
            back[here] = (at, before)
            at = -place
            if at == n:
                break
            weights = known.get(last)
            if weights is None:
                weights = known[last] = {}
            state, j = arcs[0].get(s[at]), at + 1
            if state is None or ends[state] is None:
                # The byte fallback reads one character.
                heappush(heap, (total + self.unknown, -j, "", at, last))
            while state is not None:
                piece = ends[state]
                if piece is not None:
                    w = weights.get(piece)
                    if w is None:
                        w = weights[piece] = self.weight(last, piece)
                        self.known += 1
                    if w < ZERO:
                        heappush(heap, (total + w, -j, piece, at, last))
                if j == n:
                    break
                state = arcs[state].get(s[j])
                j += 1
        out = []
        while here[0]:
            before = back[here]
            out.append([made[here[1]]] if here[1] else [self.bytes[b] for b in s[before[0] : here[0]].encode("utf-8", "surrogatepass")])
            here = before
        if self.known > WEIGHTS:
            known.clear()
            self.known = 0
        return [i for ids in reversed(out) for i in ids]

    def chunk(self, text: str) -> list[int]:
        """Ids of a normalised chunk: space marks, then other characters."""
        word = text.lstrip(MARK)
        n = len(text) - len(word)
        if n < 2 or self.kind == UNIGRAM:
            return self.path(text)
        out = self.path(MARK + word)
        joined = self.text[out[0]] != MARK and self.text[out[0]].startswith(MARK)
        return self.run(n - 1) + out if joined else self.run(n) + out[1:]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        # Composition with the normaliser: it has one state, so each of its arcs is one replacement.
        for c, to in self.normal.items():
            text = text.replace(c, to)
        if self.front:
            text = MARK + text
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        chunks = _CHUNK.findall(text) if self.kind == BPE else [text]
        for c in set(chunks).difference(memo):
            memo[c] = np.array(self.chunk(c), dtype="<u4").tobytes()
        return b"".join([memo[c] for c in chunks])

    def decode(self, ids: list[int]) -> str:
        """The inverse path: byte runs to characters, marks to spaces, the front mark gone."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            out.append(self.text[i])
        out.append(_utf8(bytes(held)))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.front and text.startswith(" ") else text


def _utf8(b: bytes) -> str:
    return b.decode("utf-8", "replace")


#: A line break or space marks and what follows them up to the next mark or break.
_CHUNK = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_machines: dict[str, Transducer] = kept(__name__)


def machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def _encode(batches, path: str):
    fst = machine(path)
    for b in batches:
        ids = [np.frombuffer(fst.encode(t), "<i4") for t in strings(b.column(b.num_columns - 1))]
        off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        col = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*ids, np.zeros(0, "<i4")])))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], col], [*b.schema.names[:-1], "ids"])


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids of every text."""
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), partial(_encode, path=model or default_model()), "doc_id long, ids array<int>")


def _decode(batches, path: str):
    fst = machine(path)
    for b in batches:
        texts = [fst.decode(x or []) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(ids: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of every row of doc_id, ids."""
    return arrow_map(ids.select("doc_id", "ids"), partial(_decode, path=model or default_model()), "doc_id long, text string")


def _round(batches, path: str):
    fst = machine(path)
    for b in batches:
        rows = []
        for t in strings(b.column(1)):
            raw = fst.encode(t)
            back = fst.decode(np.frombuffer(raw, "<u4").tolist())
            rows.append((len(raw) // 4, zlib.crc32(raw), zlib.crc32(back.encode("utf-8", "replace")), back == t.replace(MARK, " "), np.frombuffer(raw, "<i4")))
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64()] * 3 + [pa.bool_(), pa.list_(pa.int32())])]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "same", "ids"])


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers), decoded_crc32, same, ids."""
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), partial(_round, path=model or default_model()), "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, same boolean, ids array<int>")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).drop("ids")
