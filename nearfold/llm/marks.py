"""Bit maps of hashed keys: which keys occur, or occur more than once, among the rows of a table.

Keys are dealt to slices of the map by their first bits, packed 32 bits each, so
that no row is made for each key, and each slice is marked for itself.  A key
that is due is always marked.  Some others are too, the more the fuller the map,
whose size is bounded: what reads a map must let more keys pass without harm.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Workspace, arrow_map

#: Most bits of a map (64 MB), as a power of two.
MOST = 29


def mixed(keys: np.ndarray) -> np.ndarray:
    """Keys spread over all 64 bits."""
    x = keys.view(np.uint64)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _deal(batches, cut: int, times: int):
    """keys (a long or an array of them) -> slice, body: 32 bits of each key after those of its slice, equal ones ``times`` at most."""
    for b in batches:
        keys = b.column(0)
        keys = keys.flatten() if pa.types.is_list(keys.type) else keys
        h = np.sort(mixed(keys.to_numpy(zero_copy_only=False)) >> np.uint64(32 - cut))
        h = h[np.concatenate([np.ones(min(times, len(h)), bool), h[times:] != h[:-times]])]
        at = np.flatnonzero(np.diff(h >> np.uint64(32), prepend=np.uint64(1 << 63))) if len(h) else np.zeros(0, int)
        bodies = [x.astype("<u4").tobytes() for x in np.split(h & np.uint64(0xFFFFFFFF), at[1:])] if len(h) else []
        yield pa.RecordBatch.from_arrays([pa.array((h[at] >> np.uint64(32)).astype(np.int32)), pa.array(bodies, pa.binary())], ["slice", "body"])


def _mark(batches, bits: int, times: int):
    """slice, body -> slice, body: the slice's bits, of 2 ** ``bits``, set for keys found ``times`` at least."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(k, []).append(body)
    for k, bodies in held.items():
        tags = np.sort(np.frombuffer(b"".join(bodies), "<u4"))
        tags = tags[times - 1 :][tags[times - 1 :] == tags[: len(tags) - times + 1]]
        told = np.zeros(1 << bits, bool)
        told[tags >> np.uint32(32 - bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(told, bitorder="little").tobytes()], pa.binary())], ["slice", "body"])


def marks(ws: Workspace, keys: DataFrame, n: int, per_key: int, times: int = 1):
    """Broadcast (map, its bits as a power of two) of the keys in the one column of ``keys``, a long or an array of
    longs, that occur ``times`` at least; ``n`` keys about, ``per_key`` bits for each."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = min(16, (2 * parts - 1).bit_length())
    bits = max(cut + 3, min(MOST, max(1, n * per_key - 1).bit_length()))
    dealt = arrow_map(keys, partial(_deal, cut=cut, times=times), "slice int, body binary").repartition(parts, "slice")
    told = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << bits - cut - 3
    slices = ws.write(arrow_map(dealt, partial(_mark, bits=bits - cut, times=times), "slice int, body binary"), "marks")
    for r in slices.collect():
        told[r.slice * size : (r.slice + 1) * size] = np.frombuffer(r.body, np.uint8)
    ws.drop(slices)
    return spark.sparkContext.broadcast((told, bits))


def marked(keys: np.ndarray, told) -> np.ndarray:
    """Which of the keys the map (the broadcast's value) has marked."""
    body, bits = told
    at = mixed(keys) >> np.uint64(64 - bits)
    return (body[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _shared(batches, told):
    for b in batches:
        keys = b.column(b.num_columns - 1)
        n = np.diff(keys.offsets.to_numpy())
        values = keys.flatten().to_numpy(zero_copy_only=False)
        ok = marked(values, told.value)
        left = np.bincount(np.repeat(np.arange(len(n)), n)[ok], minlength=len(n))
        ends = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
        out = pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(values[ok]))], b.schema.names)
        yield out.filter(pa.array(left > 0))


def shared_keys(ws: Workspace, rows: DataFrame, n: int) -> DataFrame:
    """``rows`` without the members of its array column ``keys`` (of longs, ``n`` about in all) that no other row has;
    rows that keep none go. Some keys of one row may stay."""
    rows = rows.select(*[c for c in rows.columns if c != "keys"], "keys")
    told = marks(ws, rows.select("keys"), n, 2, times=2)
    return ws.write(arrow_map(rows, partial(_shared, told=told), rows.schema), "shared")
