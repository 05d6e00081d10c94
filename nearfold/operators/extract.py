"""Feature extraction from image rows, a batch at a time."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from nearfold.config import LOG_FLOOR, MAX_FEATURES, MIN_SIZE_INDEX, MIN_SIZE_QUERY

LONGEST, SHORTEST, THUMB = 250, 80, 100
WIDTH = 8.0


def projections(seed: int = 42, bits: int = 128, dims: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and offsets of the sketch bits, rounded so that they can be written down."""
    rng = np.random.default_rng(seed)
    return np.round(rng.standard_normal((bits, dims)), 3), np.round(rng.random(bits) * WIDTH, 3)


def sketch(desc: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """16 bytes: the low bit of each floored projection of the log-scaled descriptor."""
    v = np.maximum(desc, LOG_FLOOR)
    v = np.minimum(np.log(v / LOG_FLOOR) / -np.log(LOG_FLOOR), 1)
    return np.packbits(np.floor((a @ v + b) / WIDTH).astype(np.int64) & 1, bitorder="little").tobytes()


def png(raster: np.ndarray) -> bytes:
    """PNG file of a gray (h, w) or colour (h, w, 3) raster of bytes."""
    h, w = raster.shape[:2]
    kind = {2: 0, 3: 2}[raster.ndim]
    rows = b"".join(b"\0" + raster[y].tobytes() for y in range(h))
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def fit(img: np.ndarray, longest: int | None = None, shortest: int | None = None) -> tuple[np.ndarray, float]:
    """Scaled so that no side is above ``longest`` and none below ``shortest``; and the scale."""
    from nearfold.functions import sift

    h, w = img.shape[:2]
    if longest and max(w, h) > longest:
        nw, nh = (longest, max(h * longest // w, 1)) if w >= h else (max(w * longest // h, 1), longest)
    elif shortest and min(w, h) < shortest:
        nw, nh = (shortest, h * shortest // w) if w <= h else (w * shortest // h, shortest)
    else:
        return img, 1.0
    return sift.resize(img, nw, nh), nw / w


def record(raster: np.ndarray, body: bytes, query: bool, a: np.ndarray, b: np.ndarray) -> dict | None:
    """The record of an image; None where it is too small."""
    from nearfold.functions import sift

    h, w = raster.shape[:2]
    if min(w, h) < (MIN_SIZE_QUERY if query else MIN_SIZE_INDEX):
        return None
    img, scale = fit(sift.gray(raster), longest=LONGEST)
    if query:
        img, more = fit(img, shortest=SHORTEST)
        scale *= more
    found = sift.extract(img)
    if len(found) >= MAX_FEATURES:
        found = sorted(found, key=lambda f: -f[2])[:MAX_FEATURES]
    thumb, _ = fit(raster, longest=THUMB)
    regions = [{"x": x / scale, "y": y / scale, "r": r / scale, "t": t} for x, y, r, t, _ in found]
    return {"checksum": hashlib.sha1(body).digest(), "width": w, "height": h, "size": len(body), "thumbnail": png(thumb if thumb.ndim == 2 else thumb[:, :, :3].copy()), "regions": regions, "features": [sketch(d, a, b) for *_, d in found]}


SCHEMA = "url string, checksum binary, width long, height long, size long, thumbnail binary, regions array<struct<x: float, y: float, r: float, t: float>>, features array<binary>"


def extract(images: DataFrame, query: bool = False, seed: int = 42) -> DataFrame:
    """Records of rows of Spark's image source (column image); undecodable and too small ones give none."""
    a, b = projections(seed=seed)

    def rows(batches):
        for pdf in batches:
            out = []
            for im in pdf["image"]:
                if im["height"] <= 0 or im["nChannels"] not in (1, 3, 4):
                    continue
                raster = np.frombuffer(im["data"], np.uint8).reshape(im["height"], im["width"], im["nChannels"])
                raster = raster[:, :, 2::-1] if im["nChannels"] >= 3 else raster[:, :, 0]  # the source keeps blue first
                made = record(raster, bytes(im["data"]), query, a, b)
                if made:
                    out.append({"url": im["origin"], **made})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ("url", "checksum", "width", "height", "size", "thumbnail", "regions", "features")])

    return images.select("image").mapInPandas(rows, SCHEMA)


def read_images(spark, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", True).load(path)
