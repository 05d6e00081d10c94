"""Quality rules: counted base rules and a hashed n-gram logistic regression.

The regression reads word 1- and 2-grams and character (byte) 4-grams, hashed
into one weight table, is trained on labelled rows and calibrated (Platt) on
rows that it was not trained on, then scored in Arrow batches against a fixed
threshold.  Training takes at most TRAIN_ROWS labelled documents of at most
TRAIN_CHARS characters, chosen by hash of doc_id; counting and scoring cover
every whole text.

Defined results: null text is as empty text and fails the base rules; words
are separated by the six ASCII spaces; null or repeated doc_ids keep their
rows; labels that are null are ignored; with no usable labels the verdict is
the base rules' alone; an empty table gives an empty table; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, give_back, table, utf8

BITS = 17
TRAIN_ROWS, TRAIN_CHARS = 4000, 20000
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Calibrated probability of good quality from which a document is kept.
KEEP_FROM = 0.5
SYMBOLS = b"#*$%&|<>"
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def repeat_words(h: np.ndarray) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    if len(h) < 4:
        return 0
    tri = h[:-2] * _M1 + h[1:-1] * _M2 + h[2:] * _M3
    _, at, n = np.unique(tri, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(h), dtype=bool)
    for k in range(3):
        covered[k : len(h) - 2 + k] |= twice
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), int(np.count_nonzero((flat & 0xC0) != 0x80)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(h)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words


def features(text: bytes, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indices of the word n-grams and of the character 4-grams, with repeats."""
    shift = np.uint64(64 - BITS)
    pairs = h[:-1] * _M1 + h[1:] * _M2
    words = (np.concatenate([h, pairs]) * _M3) >> shift
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(b) < 4:
        return words.astype(np.int64), np.zeros(0, np.int64)
    quad = (b[:-3] << np.uint64(24)) | (b[1:-2] << np.uint64(16)) | (b[2:-1] << np.uint64(8)) | b[3:]
    return words.astype(np.int64), ((quad + _M2) * _M1 >> shift).astype(np.int64)


def margin(weights: np.ndarray, text: bytes, h: np.ndarray) -> float:
    w, c = features(text, h)
    return float((weights[w].mean() if len(w) else 0.0) + (weights[c].mean() if len(c) else 0.0))


class Model:
    """weights over hashed features; probability = 1 / (1 + exp(-(slope * margin + offset)))."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def probability(self, text: bytes, h: np.ndarray) -> float:
        z = self.slope * margin(self.weights, text, h) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _sparse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, cols, vals = [], [], []
    for i, t in enumerate(texts):
        for f in features(t, word_hashes(t.split())):
            if len(f):
                u, n = np.unique(f, return_counts=True)
                rows.append(np.full(len(u), i, np.int32))
                cols.append(u.astype(np.int32))
                vals.append((n / len(f)).astype(np.float32))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def fit(texts: list[bytes], good: list[int], steps: int = 150, penalty: float = 1e-5) -> Model | None:
    """Trains on four fifths, calibrates on the rest; None if a class is missing."""
    y = np.array(good, dtype=np.float64)
    if len(y) < 20 or y.min() == y.max():
        return None
    rows, cols, vals = _sparse(texts)
    fifth = np.arange(len(y)) % 5 == 4
    balance = np.where(y > 0, 0.5 / max(y[~fifth].mean(), 1e-3), 0.5 / max(1 - y[~fifth].mean(), 1e-3)) * ~fifth
    w, bias, g2 = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-10)
    b2 = 1e-10
    for _ in range(steps):
        z = np.bincount(rows, weights=w[cols] * vals, minlength=len(y)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * balance / max((~fifth).sum(), 1)
        g = np.bincount(cols, weights=err[rows] * vals, minlength=len(w)) + penalty * w / len(y)
        g2 += g * g
        w -= 1.0 * g / np.sqrt(g2)
        b2 += err.sum() ** 2
        bias -= 0.3 * err.sum() / np.sqrt(b2)
    z = np.bincount(rows, weights=w[cols] * vals, minlength=len(y)) + bias
    scale = max(float(np.abs(z[fifth]).max()), 1e-9)
    a, c, zz, yy = 1.0, 0.0, z[fifth] / scale, np.where(y[fifth] > 0, (y[fifth].sum() + 1) / (y[fifth].sum() + 2), 1 / ((1 - y[fifth]).sum() + 2))
    for _ in range(100):  # Newton steps of the two-parameter calibration
        p = 1 / (1 + np.exp(-np.clip(a * zz + c, -60, 60)))
        r = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - yy) * zz).sum(), (p - yy).sum()])
        hess = np.array([[(r * zz * zz).sum() + 1e-3, (r * zz).sum()], [(r * zz).sum(), r.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, c = a - step[0], c - step[1]
    return Model(w.astype(np.float32), a / scale, c + a / scale * bias)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list:
    """At most ``rows`` (text, label) pairs of at most ``chars`` characters, by hash of doc_id.

    A doc_id counts once, by its least label and text; so the hash share bounds
    what is broadcast and what comes to the driver at about twice ``rows``.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    # A share by hash rather than the least hashes, which every task would send to the driver.
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(max(1, known.count() // rows))) == 0)
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= chars)
    found = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return sorted(found, key=lambda r: (zlib.crc32(b"%d" % r.doc_id), r.doc_id))[:rows]


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows = training_rows(docs, labels, "quality")
    model = fit([r.text.encode() for r in rows], [r.y for r in rows])
    del rows
    give_back()
    return model


def judge(text: bytes, model: Model | None) -> tuple:
    words = text.split()
    h = word_hashes(words)
    counts = base_counts(text, words, h)
    failed = base_failed(counts[0], counts[4])
    p = model.probability(text, h) if model else 1.0
    return *counts, failed, p, not failed and p >= KEEP_FROM


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def _judge(batches, model):
    model = model.value
    for b in batches:
        out = [judge(t, model) for t in utf8(b.column(b.num_columns - 1))]
        cols = [pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()])]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], *NAMES])


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, probability and kept for every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), partial(_judge, model=model), f"doc_id long, {SCHEMA}")


def _keep(batches, model, at: int):
    model = model.value
    for b in batches:
        yield b.filter(pa.array([judge(t, model)[-1] for t in utf8(b.column(at))], pa.bool_()))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    from pyspark.sql.types import StructType

    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    fields = StructType(docs.schema.fields)
    return arrow_map(docs, partial(_keep, model=model, at=docs.columns.index("text")), fields)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("probability")
