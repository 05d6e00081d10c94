"""Token ids as binary segments: each document is one zstandard frame under a
shared dictionary, behind an offset index.

A segment is one row of a Parquet table, so any store that Spark writes will
do, and its ``body`` is laid out as (little-endian)

    magic 'NFTB', u32 version, u32 dictionary hash (crc32), u32 documents,
    documents x (i64 doc_id, u64 frame offset, u32 frame bytes, u32 ids),
    frames

so that one document is read by its index entry alone.  Segments are in
ascending doc_id order by (part, seq).  The dictionary is trained on the
serialised ids of at most DICT_DOCS documents chosen by hash, each of at most
DICT_CHARS characters: the dictionary serves short documents, and it changes
sizes only, never ids.

Defined results: null text is as empty text and holds the end id alone; null
doc_id sorts first, is stored as the least 64-bit number and comes back as
null; rows that repeat a doc_id each keep an entry; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, arrow_map, table

MAGIC, VERSION, NO_ID = b"NFTB", 1, -(1 << 63)
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])
DICT_DOCS, DICT_CHARS, DICT_BYTES = 1000, 16384, 65536
SEGMENT_BYTES = 1 << 20
END = 0
#: Distinct words that a worker keeps; beyond it the memory is emptied. Texts encoded at once.
MEMO, SLICE = 1_200_000, 3072
#: ASCII marks that end a word; they are a piece of their own after letters.
MARKS = string.punctuation
#: Before the first word of a text.
START = "\x02"
#: Texts whose cuts aren't certain: empty, white space next to another or at an end, or any but space and line break; START inside.
ODD = r"^$|\A[ \n]|[ \n]\z|[ \n]{2}|[\x02\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Exact ids of whole texts, with each distinct word encoded by the library once.

    The tokenizer's pre-tokenisation always cuts before the space of a word,
    at a line break, and between a word's letters and the marks that end it,
    where no white space is next to another.  Other texts go to the library
    whole.  Words are told apart by Arrow's dictionary encoding, so Python
    touches a word once a batch, and ids are put together in numpy.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold an added token, which the library cuts out first, go to it whole too.
        self.odd = "|".join([ODD, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        vocab = self.tokenizer.get_vocab()
        #: Bytes that each id stands for: a byte-level piece has a character for each.
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        self.width[list(vocab.values())] = [len(x) for x in vocab]
        #: Ids of a word with what is before it: a space (word alone), a line break, or START for nothing.
        self.memo: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Encodes words in one text, each with its gap before it, and splits the ids by the bytes they stand for."""
        new = [w.decode() for w in new]
        cut = {w: core for w in new if (core := w.rstrip(MARKS)) is not w and core and core[-1].isalpha()}
        tails = list({w[len(core) :] for w, core in cut.items()} - self.tails.keys())
        self.tails.update(zip(tails, self._direct(tails) if tails else ()))
        words = {cut.get(w, w) for w in new}
        found = {w: ids for w in cut.values() if (ids := self.memo.get(w.encode())) is not None}
        words = list(words - found.keys())
        parts = [w if w[0] == "\n" else f"\n{w[1:]}" if w[0] == START else f" {w}" for w in words]
        sizes = np.cumsum([len(p.encode()) for p in parts])
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids if words else [], dtype="<u4")
        stops = (4 * (np.searchsorted(np.cumsum(self.width[ids]), sizes, side="left") + 1)).tolist()
        raw, at = ids.tobytes(), 0
        for w, stop in zip(words, stops):
            found[w] = raw[at + 4 * (w[0] == START) : stop]
            at = stop
        for w, core in cut.items():
            found[w] = found[core] + self.tails[w[len(core) :]]
        self.memo.update((w.encode(), ids) for w, ids in found.items())

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of texts whose cuts are certain."""
        words = pc.split_pattern(pc.binary_join_element_wise(START, pc.replace_substring(texts, "\n", " \n"), ""), " ")
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        _, cuts, data = coded.dictionary.buffers()
        cuts, data = np.frombuffer(cuts, np.int32, len(coded.dictionary) + 1, 4 * coded.dictionary.offset).tolist(), data.to_pybytes()
        keys, memo = [data[x:y] for x, y in zip(cuts, cuts[1:])], self.memo
        found = list(map(memo.get, keys))
        if None in found:
            self._learn([k for k, ids in zip(keys, found) if ids is None])
            found = [memo[k] for k in keys]
        flat, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int32, len(found)) >> 2
        at = coded.indices.to_numpy(zero_copy_only=False)
        start, n = (np.cumsum(size, dtype=np.int32) - size)[at], size[at]
        stop = np.cumsum(n, dtype=np.int64)
        ids = flat[np.repeat(start - (stop - n).astype(np.int32), n) + np.arange(int(n.sum()), dtype=np.int32)]
        off = words.offsets.to_numpy() - words.offsets[0].as_py()
        counts = np.diff(np.concatenate([[0], stop])[off])
        if len(memo) > MEMO:
            memo.clear()
        return ids, counts

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is as empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        out: list[bytes] = []
        for i in range(0, len(texts), SLICE):
            part = texts.slice(i, SLICE)
            odd = pc.match_substring_regex(part, self.odd)
            ids, counts = self._plain(part.filter(pc.invert(odd)))
            raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            plain = iter(raw[a:b] for a, b in zip([0, *ends], ends))
            direct = iter(self._direct(part.filter(odd).to_pylist()))
            out += [next(direct) if o else next(plain) for o in odd.to_pylist()]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process; workers are reused over tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: bytes) -> bytes:
    return ids + END.to_bytes(4, "little")


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """At most DICT_BYTES; empty where the sample is too small to train on."""
    one_in = max(1, docs.count() // DICT_DOCS)
    short = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("dict")), F.lit(one_in)) == 0).where((F.length("text") <= DICT_CHARS) & (F.length("text") > 0))
    rows = short.select("text").limit(2 * DICT_DOCS).collect()
    samples = [with_end(x) for x in encoder(tokenizer).encode(sorted(r.text for r in rows)[:: max(1, len(rows) // DICT_DOCS)])]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def pack(entries: list[tuple[int, bytes, int]], dictionary: bytes) -> bytes:
    """Segment body of (doc_id, frame, number of ids) entries."""
    index = np.zeros(len(entries), INDEX)
    sizes = [len(f) for _, f, _ in entries]
    index["doc_id"] = [d for d, _, _ in entries]
    index["bytes"], index["ids"] = sizes, [n for _, _, n in entries]
    index["offset"] = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    head = MAGIC + np.array([VERSION, zlib.crc32(dictionary), len(entries)], "<u4").tobytes()
    return head + index.tobytes() + b"".join(f for _, f, _ in entries)


def open_segment(body: bytes, dictionary: bytes) -> tuple[np.ndarray, memoryview]:
    """Index and frames; refuses another format or another dictionary."""
    if body[:4] != MAGIC:
        raise ValueError("not a token segment")
    version, used, n = np.frombuffer(body, "<u4", 3, 4).tolist()
    if version != VERSION or used != zlib.crc32(dictionary):
        raise ValueError("segment of another version or dictionary")
    return np.frombuffer(body, INDEX, n, 16), memoryview(body)[16 + n * INDEX.itemsize :]


def _codec(dictionary: bytes, kind, **more):
    return kind(dict_data=zstandard.ZstdCompressionDict(dictionary), **more) if dictionary else kind(**more)


def read_document(body: bytes, dictionary: bytes, k: int) -> np.ndarray:
    """Ids of the k-th document of a segment, touching its own frame only."""
    index, frames = open_segment(body, dictionary)
    a, n = int(index["offset"][k]), int(index["bytes"][k])
    return np.frombuffer(_codec(dictionary, zstandard.ZstdDecompressor).decompress(bytes(frames[a : a + n])), "<u4")


def _write(batches, tokenizer: str, dictionary: bytes):
    from pyspark import TaskContext

    context = TaskContext.get()
    part, seq = context.partitionId() if context else 0, 0
    codec, enc = _codec(dictionary, zstandard.ZstdCompressor, level=3), encoder(tokenizer)
    held, size = [], 0

    def row():
        nonlocal seq, held, size
        out = {"part": part, "seq": seq, "n_docs": len(held), "n_ids": sum(n for _, _, n in held), "body": pack(held, dictionary)}
        seq, held, size = seq + 1, [], 0
        return pa.RecordBatch.from_pylist([out], schema=pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("body", pa.binary())]))

    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        for i in range(0, len(ids), SLICE):
            for d, raw in zip(ids[i : i + SLICE], enc.encode(texts.slice(i, SLICE))):
                raw = with_end(raw)
                frame = codec.compress(raw)
                held.append((NO_ID if d is None else d, frame, len(raw) // 4))
                size += len(frame) + INDEX.itemsize
                if size >= SEGMENT_BYTES:
                    yield row()
    if held:
        yield row()


def write_tokens(docs: DataFrame, ws: Workspace, tokenizer: str | None = None) -> tuple[DataFrame, bytes]:
    """Writes the segments of all documents, ascending by doc_id; gives their table and the dictionary."""
    tokenizer = tokenizer or default_tokenizer()
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    dictionary = train_dictionary(slim, tokenizer)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    rows = arrow_map(ordered, partial(_write, tokenizer=tokenizer, dictionary=dictionary), "part int, seq long, n_docs long, n_ids long, body binary")
    return ws.write(rows, "segments"), dictionary


def _read(batches, dictionary: bytes):
    codec = _codec(dictionary, zstandard.ZstdDecompressor)
    for b in batches:
        for part, seq, body in zip(*(b.column(i).to_pylist() for i in range(3))):
            index, frames = open_segment(body, dictionary)
            crcs = [zlib.crc32(codec.decompress(bytes(frames[a : a + n]))) for a, n in zip(index["offset"].tolist(), index["bytes"].tolist())]
            ids = index["ids"].astype("<i8")
            doc = pa.array(index["doc_id"], mask=index["doc_id"] == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(np.full(len(ids), seq, np.int64)), doc, pa.array(np.cumsum(ids) - ids), pa.array(ids), pa.array(crcs, pa.int64())], ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])


def segment_starts(segments: DataFrame) -> DataFrame:
    """part, seq, base: ids in all segments before; sums by part first, so that no window holds all segments."""
    by_part = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("s"))
    return own.join(parts, "part").select("part", "seq", (F.col("p") + F.col("s")).alias("base"))


def read_tokens(segments: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files."""
    docs = arrow_map(segments.select("part", "seq", "body"), partial(_read, dictionary=dictionary), "part int, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    out = docs.join(segment_starts(segments), ["part", "seq"])
    return out.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_binary(spark, sf_dir: str) -> DataFrame:
    segments, dictionary = write_tokens(table(spark, sf_dir, "documents"), Workspace(spark, "tokens"))
    return read_tokens(segments, dictionary)
