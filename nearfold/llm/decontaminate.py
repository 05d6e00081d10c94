"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Items and texts are folded to words (lower case, ASCII punctuation apart).
Every SEED consecutive words of an item are a seed (items of fewer words: the
whole item).  One pass over the texts gives the places of their n-grams that
may be seeds, told by a bitmap of seed hashes of at most 2 ** BITS bits; these
are joined with the table of seeds.  Seeds that are common in the corpus beside
their item's other seeds are put aside.  A second pass aligns the texts that
hold a rare seed with the item around it, word by word, and a document is a
leak of an item when the alignment reaches LEAK_FROM of the item's full score;
so copies with words changed, left out or put in are found.

The number of passes does not depend on the size of the benchmark, which stays
a table; only the bitmap goes to the workers.  Hashes that agree by chance
lead to an alignment that fails, never to a leak.

Defined results: null and empty texts or items leak nothing; benchmark rows
that repeat an item_id with other texts are all searched and the best alignment
is that item's; rows without item_id are searched and give null item_ids, one
for each of their texts; of several alignments of a document and item the best
is given, the first of equals; null or repeated doc_ids keep their rows; an
empty table gives an empty table; other columns are carried where documents
are kept, whatever their names, else ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, fold_words, positional, row_key, strings, table

SEED = 4
MATCH, MISMATCH, GAP = 2, -1, -1
LEAK_FROM = 0.6
#: Bits of a seed's hash that the bitmap tells apart: at most 16 MB go to a worker.
BITS = 27
#: Texts whose n-grams are hashed at once.
SLICE = 512


def folded(text: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in _fold(text)]


def _fold(text: str) -> list[bytes]:
    return fold_words(text.lower().encode("utf-8", "replace"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def grams(texts: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of all runs of ``size`` words."""
    n = np.array([len(t) for t in texts], np.int64)
    words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    h = hashes[words.indices.to_numpy(zero_copy_only=False)]
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(place + size <= n[owner])
    out = np.full(len(at), size, np.uint64)
    for j in range(size):
        out = _mix(out + h[at + j])
    return owner[at], place[at], out.view(np.int64)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word-number arrays and where it ends in b (exclusive)."""
    steps = np.arange(len(b) + 1) * -GAP
    row, best, end = np.zeros(len(b) + 1, dtype=np.int64), 0, 0
    for x in a:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def leak_of(target: list[str], words: list[str], starts: list[int]) -> tuple[float, int, int]:
    """(share of the full score, first word, last word + 1) of the best alignment around the places where the item would start."""
    pad, windows = len(target) // 2 + 4, []
    for d in sorted(starts):
        a, b = max(0, d - pad), min(len(words), d + len(target) + pad)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], b)
        else:
            windows.append([a, b])
    number: dict[str, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in target])
    best = (0, 0, 0)
    for a, b in windows:
        y = np.array([number.get(w, -1) for w in words[a:b]])
        score, end = align(x, y)
        if score > best[0]:
            # The same alignment from its end backwards gives its start.
            back = align(x[::-1], y[:end][::-1])[1]
            best = (score, a + end - back, a + end)
    return best[0] / (MATCH * len(target)), best[1], best[2]


def leaks_of(text: str, items: list[dict]) -> list[tuple[int, float, int, int]]:
    """(item_id, share, first word, last word + 1) for each leaked item among those whose seeds the text holds."""
    words, best = folded(text), {}
    for item in items or ():
        found = leak_of(folded(item["text"]), words, item["starts"])
        name = (item["item_id"], None if item["item_id"] is not None else item["text"])
        if found[0] >= LEAK_FROM and (name not in best or (-found[0], *found[1:]) < (-best[name][0], *best[name][1:])):
            best[name] = found
    return sorted(((name[0], *found) for name, found in best.items()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def _seeds(batches):
    """item, text -> item, seed, place."""
    for b in batches:
        texts = [_fold(t) for t in strings(b.column(1))]
        for size in range(1, SEED + 1):
            some = [i for i, t in enumerate(texts) if min(len(t), SEED) == size]
            owner, place, seed = grams([texts[i] for i in some], size)
            item = b.column(0).take(pa.array(np.array(some, np.int64)[owner]))
            yield pa.RecordBatch.from_arrays([item, pa.array(seed), pa.array(place), pa.array(np.full(len(seed), size, np.int32))], ["item", "seed", "place", "size"])


def _hits(batches, maps):
    """row, text -> row, seed, place of n-grams that may be seeds, and whether it is the text's first of that seed."""
    parts, sizes = maps.value
    bits = np.zeros(1 << BITS - 3, np.uint8)
    for bucket, body in parts.items():
        bits[bucket << 12 : bucket + 1 << 12] = np.frombuffer(body, np.uint8)
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            part = b.slice(i, SLICE)
            texts = [_fold(t) for t in strings(part.column(1))]
            for size in sizes:
                owner, place, seed = grams(texts, size)
                at = seed.view(np.uint64) >> np.uint64(64 - BITS)
                ok = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                owner, place, seed = owner[ok], place[ok], seed[ok]
                first = np.zeros(len(seed), bool)
                order = np.lexsort((place, seed, owner))
                first[order] = np.concatenate([[True], (owner[order][1:] != owner[order][:-1]) | (seed[order][1:] != seed[order][:-1])])[: len(order)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(seed), pa.array(place), pa.array(first)], ["row", "seed", "place", "first"])


def candidates(keyed: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, items: the items (item_id, text, starts) whose rare seeds a text holds, and where each would start.

    ``keyed``: row, text.
    """
    spark, ws = keyed.sparkSession, Workspace(keyed.sparkSession, "leaks")
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0).distinct()
    items = ws.write(own.withColumn("item", F.xxhash64("item_id", "text")), "items")
    seeds = ws.write(arrow_map(items.select("item", "text"), _seeds, "item long, seed long, place long, size int"), "seeds")
    place = F.shiftrightunsigned("seed", 64 - BITS)
    # Bit i of the bitmap is in bucket i >> 15, whose body has 4096 bytes.
    maps = seeds.groupBy((F.shiftright(place, 15)).alias("bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("body")).collect()
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())
    told = spark.sparkContext.broadcast(({r.bucket: bytes(r.body) for r in maps}, sizes))
    row = keyed.schema["row"].dataType.simpleString()
    hits = ws.write(arrow_map(keyed.select("row", "text"), partial(_hits, maps=told), f"row {row}, seed long, place long, first boolean"), "hits")
    counts = ws.write(hits.where("first").groupBy("seed").agg(F.count("*").alias("n")), "counts")
    each = seeds.join(counts, "seed", "left").select("item", "seed", F.col("place").alias("own"), F.coalesce("n", F.lit(0)).alias("n"))
    # Seeds ten times as frequent as the item's median seed are put aside.
    usual = each.groupBy("item").agg(F.percentile("n", 0.5).alias("middle"))
    rare = ws.write(each.join(usual, "item").where("n > 0 AND n <= 10 * middle + 10").select("item", "seed", "own"), "rare")
    starts = hits.join(rare, "seed").groupBy("row", "item").agg(F.collect_set(F.col("place") - F.col("own")).alias("starts"))
    told_items = starts.join(items, "item").select("row", F.struct("item_id", "text", "starts").alias("one"))
    return ws.write(told_items.groupBy("row").agg(F.collect_list("one").alias("items")), "candidates")


def _find(batches):
    """doc_id, text, items -> the leaks."""
    kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]
    for b in batches:
        rows = [(d, *leak) for d, t, items in zip(b.column(0).to_pylist(), strings(b.column(1)), b.column(2).to_pylist()) for leak in leaks_of(t, items)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def _clean(batches, at: int):
    """..., items -> the rows without a leak."""
    for b in batches:
        ok = [not items or not leaks_of(t, items) for t, items in zip(strings(b.column(at)), b.column(b.num_columns - 1).to_pylist())]
        yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(ok, pa.bool_()))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, start, stop (words) of every leak."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row_key("doc_id", "text"))
    found = keyed.join(candidates(keyed.select("row", "text"), benchmark), "row").select("doc_id", "text", "items")
    return arrow_map(found, _find, "doc_id long, item_id long, score double, start long, stop long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns."""
    from pyspark.sql.types import StructType

    base = positional(docs)
    doc_id, at = docs.columns.index("doc_id"), docs.columns.index("text")
    keyed = base.withColumn("row", row_key(f"c{doc_id}", f"c{at}"))
    found = candidates(keyed.select("row", F.col(f"c{at}").alias("text")), benchmark)
    joined = keyed.join(found, "row", "left").select(*base.columns, "items")
    return arrow_map(joined, partial(_clean, at=at), StructType(base.schema.fields)).toDF(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
