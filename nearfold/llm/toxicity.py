"""Toxicity: a linear-chain conditional random field over words.

Each word is toxic or not.  Token labels for training come from document
labels: a word of a toxic training document is labelled toxic when one of its
features (the word itself, its prefixes) occurs in several toxic and hardly
any clean training documents.  The field has feature weights and a 2 x 2
transition table, fitted by gradient steps on the exact likelihood.  Scoring
runs forward-backward over every whole text; the marginals are summed up to a
document score and give the offending offsets.

Training takes at most TRAIN_ROWS labelled documents (at most TRAIN_CHARS
characters each), chosen by hash of doc_id, none of them held out.

Defined results: null text is as empty text and gets the score of a text
without toxic words; null doc_id counts as not held out; repeated rows keep
their rows; null labels are ignored; with no toxic or no clean training row
every score is 0; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, strings, table
from .quality import training_rows

BITS, WINDOW = 17, 32
TRAIN_ROWS, TRAIN_CHARS = 5000, 20000
HELD_OUT = 2
PREDICT_FROM = 0.3
MEMO = 1_000_000
_EDGE = re.compile(r"^\W+|\W+$")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def word_features(word: str) -> list[int]:
    """Hashed features of a word: the bare word and its prefixes of 3 to 8 letters."""
    w = word.lower()
    if not (w[0].isalnum() and w[-1].isalnum()):
        w = _EDGE.sub("", w)
    crc, shift = zlib.crc32, 32 - BITS
    b = w.encode("utf-8", "surrogatepass")
    out = [crc(b, 1) >> shift]
    if len(b) == len(w):
        out += [crc(b[:n], n) >> shift for n in range(3, min(len(w), 9))]
    else:
        out += [crc(w[:n].encode("utf-8", "surrogatepass"), n) >> shift for n in range(3, min(len(w), 9))]
    return out


def summary(marginals: list[float]) -> list[float]:
    """What the document score reads: summed squares (so that many faint words
    of a long text don't add up to an offence), their density, the maximum, 1."""
    mass = sum([p * p for p in marginals if p > 0.02])
    return [float(np.log1p(mass)), float(np.log1p(100 * mass / (len(marginals) + 20))), max(marginals, default=0.0), 1.0]


class Field:
    """Feature weights of state 1 against state 0, log transition table, calibration of the document score."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, scale: tuple[float, ...]):
        self.weights, self.bias, self.trans, self.scale = weights, bias, trans, scale
        self.memo: dict[str, float] = {}
        self.table = weights.tolist()

    def odds(self, word: str) -> float:
        z = self.bias
        for f in word_features(word):
            z += self.table[f]
        return math.exp(min(30.0, max(-30.0, z)))

    def marginals(self, words: list[str]) -> list[float]:
        """Probability of state 1 for each word, by ratio forms of the forward and backward passes."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        odds = self.odds
        for w in set(words).difference(memo):
            memo[w] = odds(w)
        o = [memo[w] for w in words]
        if not o:
            return []
        (t00, t01), (t10, t11) = np.exp(self.trans).tolist()
        r = o[0]
        forward = [r] + [r := x * (t01 + t11 * r) / (t00 + t10 * r) for x in o[1:]]
        b, out = 1.0, []
        for x, f in zip(reversed(o), reversed(forward)):
            q = f * b
            out.append(q / (1 + q))
            y = x * b
            b = (t10 + t11 * y) / (t00 + t01 * y)
        out.reverse()
        return out

    def score(self, marginals: list[float]) -> float:
        z = float(np.dot(self.scale, summary(marginals)))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def token_labels(docs: list[list[list[int]]], toxic: np.ndarray, cover: int = 4) -> list[np.ndarray]:
    """Per document and word: 1 if the word has a feature that marks toxic documents.

    Marks are chosen greedily: of the features that clean documents hardly
    ever have, that which occurs in most toxic documents with fewer than
    ``cover`` marks so far, until one more would gain under one in a hundred.
    So chance words of a few copies aren't taken for toxic ones.
    """
    has = [np.array(sorted({f for fs in feats for f in fs}), dtype=np.int64) for feats in docs]
    clean = np.zeros(1 << BITS)
    for fs, y in zip(has, toxic):
        if not y:
            clean[fs] += 1
    bad = [fs for fs, y in zip(has, toxic) if y]
    n_bad, n_clean = max(len(bad), 1), max(len(docs) - len(bad), 1)
    everywhere = np.zeros(1 << BITS)
    for fs in bad:
        everywhere[fs] += 1
    usable = clean / n_clean <= 0.08 * everywhere / n_bad
    left = np.full(len(bad), cover)
    marks: set[int] = set()
    gain = everywhere * usable
    while True:
        f = int(np.argmax(gain))
        if gain[f] < max(3, 0.01 * n_bad):
            break
        marks.add(f)
        usable[f], gain[f] = False, 0
        for i, fs in enumerate(bad):
            if left[i] and fs[min(np.searchsorted(fs, f), len(fs) - 1)] == f:
                left[i] -= 1
                if not left[i]:
                    gain[fs] -= usable[fs]
    return [np.array([bool(y) and not marks.isdisjoint(fs) for fs in feats], dtype=np.int8) for feats, y in zip(docs, toxic)]


def fit(texts: list[str], toxic: list[int], steps: int = 40) -> Field | None:
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return None
    memo: dict[str, list[int]] = {}
    pool: dict[str, str] = {}  # one object for each distinct word keeps the driver small
    words = [[pool.setdefault(w, w) for w in t.split()] for t in texts]
    feats = [[memo.get(w) or memo.setdefault(w, word_features(w)) for w in ws] for ws in words]
    labels = token_labels(feats, y)
    # Windows: all that hold a toxic word, and one in four of the others.
    X, L = [], []
    for d, (fs, ls) in enumerate(zip(feats, labels)):
        for k, i in enumerate(range(0, len(fs), WINDOW)):
            if ls[i : i + WINDOW].any() or (d + k) % 4 == 0:
                X.append(fs[i : i + WINDOW])
                L.append(ls[i : i + WINDOW])
    if not X:
        return None
    n, most = len(X), 8
    idx = np.full((n, WINDOW, most), 1 << BITS, dtype=np.int32)
    lab, mask = np.zeros((n, WINDOW), np.int8), np.zeros((n, WINDOW), bool)
    for i, (fs, ls) in enumerate(zip(X, L)):
        mask[i, : len(fs)], lab[i, : len(fs)] = True, ls
        for j, f in enumerate(fs):
            idx[i, j, : len(f)] = f
    w, bias, trans = np.zeros((1 << BITS) + 1), -4.0, np.zeros((2, 2))
    g2, b2, t2 = np.full_like(w, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    pair = np.zeros((2, 2))
    both = mask[:, 1:] & mask[:, :-1]
    for a in (0, 1):
        for b in (0, 1):
            pair[a, b] = ((lab[:, :-1] == a) & (lab[:, 1:] == b) & both).sum()
    for _ in range(steps):
        e = w[idx].sum(axis=2) + bias
        psi = np.stack([np.zeros_like(e), np.clip(e, -30, 30)], axis=2)
        T = np.exp(trans)
        fw, bw = np.empty_like(psi), np.ones_like(psi)
        p = np.exp(psi)
        fw[:, 0] = p[:, 0] / p[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, WINDOW):
            x = (fw[:, t - 1] @ T) * p[:, t]
            fw[:, t] = np.where(mask[:, t, None], x / x.sum(axis=1, keepdims=True), fw[:, t - 1])
        for t in range(WINDOW - 2, -1, -1):
            x = (bw[:, t + 1] * p[:, t + 1]) @ T.T
            bw[:, t] = np.where(mask[:, t + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
        m = fw * bw
        m /= m.sum(axis=2, keepdims=True)
        err = (m[:, :, 1] - lab) * mask
        g = np.bincount(idx.ravel(), weights=np.repeat(err.ravel(), most), minlength=len(w)) + 0.02 * w
        g[-1] = 0
        j = fw[:, :-1, :, None] * T[None, None] * (p[:, 1:] * bw[:, 1:])[:, :, None, :]
        j /= j.sum(axis=(2, 3), keepdims=True)
        expect = (j * both[:, :, None, None]).sum(axis=(0, 1))
        gt = expect - pair + 0.02 * trans
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        b2 += err.sum() ** 2
        bias -= 0.3 * err.sum() / np.sqrt(b2)
        t2 += gt * gt
        trans -= 0.2 * gt / np.sqrt(t2)
    field = Field(w[:-1].astype(np.float32), float(bias), trans, (1.0, 0.0, 1.0, 0.0))
    F2 = np.array([summary(field.marginals(ws)) for ws in words])
    coef = np.zeros(4)
    for _ in range(60):  # Newton steps of the document calibration
        q = 1 / (1 + np.exp(-np.clip(F2 @ coef, -30, 30)))
        h = (F2 * (q * (1 - q))[:, None]).T @ F2 + np.eye(4) * 0.05
        coef -= np.clip(np.linalg.solve(h, F2.T @ (q - y) + 0.05 * coef), -2, 2)
    field.scale = tuple(coef.tolist())
    field.memo = {}
    return field


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    rows = training_rows(docs, labels.where(~held_out("doc_id")), "toxic", TRAIN_ROWS, TRAIN_CHARS)
    return fit([r.text for r in rows], [r.y for r in rows])


def spans(text: str, marginals: list[float]) -> list[dict]:
    """Code point offsets of runs of words that are likelier toxic than not."""
    if not any(p > 0.5 for p in marginals):
        return []
    out, last = [], -2
    # The same words as str.split gives: str.split and \s agree but for the ASCII separators \x1c-\x1f, which both split at.
    at = 0
    for i, (w, p) in enumerate(zip(text.split(), marginals)):
        at = text.index(w, at)
        if p > 0.5:
            if last == i - 1 and out:
                out[-1]["stop"] = at + len(w)
            else:
                out.append({"start": at, "stop": at + len(w)})
            last = i
        at += len(w)
    return out


def _score(batches, field):
    field = field.value
    for b in batches:
        scores, found = [], []
        for t in strings(b.column(2)):
            m = field.marginals(t.split()) if field else []
            scores.append(field.score(m) if field else 0.0)
            found.append(spans(t, m))
        s = pa.array(scores, pa.float64())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), s, pa.array([int(x >= PREDICT_FROM) for x in scores], pa.int32()), pa.array(found, kind)], ["doc_id", "held_out", "score", "predicted", "spans"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the toxic spans of every row."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    slim = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), "text")
    return arrow_map(slim, partial(_score, field=field), "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: long, stop: long>>")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
