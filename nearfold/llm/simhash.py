"""SimHash near-duplicate detection with the generalised pigeonhole principle.

Documents get a 64-bit SimHash of their word shingles; fingerprints within
``radius`` bits are linked and connected components formed.  Candidate search
follows the generalised pigeonhole: correlated bits are put in one part, the
parts get unequal thresholds by dynamic programming over estimated candidate
counts, and every fingerprint is probed under the masks that the thresholds
give.  Links are verified on the whole fingerprints.

Where ``exact`` is asked for with a similarity, a second candidate path finds
the pairs that the radius misses, but for about one in a thousand: texts of Jaccard similarity s share one of
the n - ceil(s n) + 1 least shingle hashes of each (prefix filter), so all
pairs of distinct shingle sets that share one, are of like size, differ in at
most APART bits and aren't connected yet are verified on the whole sets.

Defined results: null text is as empty text; texts without words have
fingerprint zero and are linked like any other; equal fingerprints are one
class; repeated rows stay, in one class; an empty table gives an empty table;
rows with null doc_id keep a row, and count towards a component id only where
no other member has one; further columns are ignored.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, positional, row_key, signed, utf8
from .components import components
from .hamming import forest_links, labelled_links, settle
from .marks import shared_keys

SEED = 42
#: Cost of a row dealt to a group against that of a pair compared in memory.
ROW_COST, PAIR_COST = 200.0, 3.0
#: Greatest threshold of a part: a part has a mask for every choice of so many of its bits.
MOST_OUT = 2
#: Bits within which texts that share shingles are compared: at a Jaccard similarity of 0.8 fingerprints
#: differ in 9.7 bits with a deviation of 2.9, so about one pair in a thousand at that bound is passed over, fewer above it.
APART = 18


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64."""
    parts = text.lower().split()
    if not parts:
        return 0
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return h(b" ".join(parts), SEED)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = (np.concatenate([[0], ends[:-1]])[: len(parts) - words + 1]).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches, words: int):
    """The last column's texts become fp, the 64 bits as a signed long."""
    for b in batches:
        fp = [signed(fingerprint(t, words)) for t in utf8(b.column(b.num_columns - 1))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64())], [*b.schema.names[:-1], "fp"])


# --- generalised pigeonhole plan -------------------------------------------


def _cooccur(batches):
    """Counts of bit pairs that are both 1; row 4096 is the number of fingerprints."""
    total, n = np.zeros((64, 64), dtype=np.int64), 0
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype("<u8", copy=False) if b.num_rows else np.zeros(0, "<u8")
        for i in range(0, len(fp), 65536):
            bits = np.unpackbits(fp[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
        n += len(fp)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097), pa.int64()), pa.array(np.append(total.ravel(), n), pa.int64())], ["i", "n"])


def bit_statistics(fps: DataFrame) -> tuple[np.ndarray, int]:
    """64 x 64 joint one-counts over all fingerprints (a fixed-size result), and their number."""
    rows = arrow_map(fps.select("fp"), _cooccur, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097, dtype=np.int64)
    for i, n in rows:
        flat[i] = n
    return flat[:4096].reshape(64, 64), int(flat[4096])


def group_bits(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Parts of nearly equal size; each grows by the bit most correlated with it."""
    p = np.diag(joint) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev)
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts, 0, -1):
        size = len(left) // k
        part = [left.pop(int(np.argmax(corr[np.ix_(left, left)].max(axis=1))))]
        while len(part) < size:
            part.append(left.pop(int(np.argmax(corr[np.ix_(left, part)].mean(axis=1)))))
        out.append(part)
    return out


def collision(joint: np.ndarray, n: int, part: list[int], threshold: int) -> float:
    """Estimated chance that two fingerprints differ in at most ``threshold`` bits of the part.

    The bits are taken as a chain in which each depends on the one before.
    """
    if threshold < 0:
        return 0.0
    n = max(n, 1)
    p = np.diag(joint) / n
    same = p * p + (1 - p) ** 2
    chance = [max(same[part[0]], 0.5)]
    for a, b in zip(part, part[1:]):
        both = joint[a, b] / n
        cells = np.array([both, p[a] - both, p[b] - both, 1 - p[a] - p[b] + both])
        chance.append(float(min(1.0, max((cells**2).sum() / max(same[a], 1e-9), 0.5))))
    dist = np.zeros(threshold + 1)
    dist[0] = 1
    for c in chance:
        dist[1:] = dist[1:] * c + dist[:-1] * (1 - c)
        dist[0] *= c
    return float(dist.sum())


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]] | None:
    """Thresholds t_i >= -1 of the given sum with the least summed cost; cost[i][t + 1]. None if there are none."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, len(row) - 1):
                cand = (c + row[t + 1], [*ts, t])
                if used + t not in new or cand < new[used + t]:
                    new[used + t] = cand
        best = new
    return best.get(total)


def masks_of(part: list[int], threshold: int) -> list[int]:
    """Masks over the part with every choice of ``threshold`` bits left out."""
    whole = sum(1 << b for b in part)
    return [] if threshold < 0 else [whole ^ sum(1 << b for b in out) for out in combinations(part, threshold)]


def plan_masks(joint: np.ndarray, n: int, radius: int, max_parts: int = 4) -> list[int]:
    """The cheapest allocation over all numbers of parts; the thresholds' sum is radius - parts + 1."""
    found, size = [], max(n, 2)
    for parts in range(2, max(max_parts, radius + 1) + 1):
        bits, cost = group_bits(joint, n, parts), []
        for part in bits:
            pairs = [size * size / 2 * collision(joint, n, part, t) for t in range(-1, MOST_OUT + 1)]
            cost.append([comb(len(part), max(t, 0)) * (t >= 0) * size * ROW_COST + p * PAIR_COST for t, p in enumerate(pairs, -1)])
        if best := allocate(cost, radius - parts + 1):
            found.append((best[0], parts, best[1], bits))
    _, _, thresholds, bits = min(found)
    return [m for part, t in zip(bits, thresholds) for m in masks_of(part, t)]


# --- operator ----------------------------------------------------------------


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of the distinct word shingles, in order."""
    parts = text.lower().split()
    n = max(len(parts) - words + 1, 1 if parts else 0)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), SEED) for i in range(n)), dtype=np.uint64, count=n))


def _sets(batches, words: int):
    """..., text -> ..., set (its shingles' hashes)."""
    for b in batches:
        sets = [shingles(t, words).view(np.int64) for t in utf8(b.column(b.num_columns - 1))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.list_(pa.int64()))], [*b.schema.names[:-1], "set"])


def alike(x: list, y: list, similarity: float) -> list[bool]:
    """Whether the pairs of shingle sets have that Jaccard similarity."""
    ok = []
    for a, b in zip(x, y):
        both = len(np.intersect1d(a, b, assume_unique=True))
        ok.append(both >= similarity * (len(a) + len(b) - both))
    return ok


def _alike(batches, similarity: float):
    for b in batches:
        ok = alike(*([v.values.to_numpy(zero_copy_only=False) for v in b.column(i)] for i in (2, 3)), similarity)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _set_table(ws: Workspace, docs: DataFrame, classes: DataFrame, links: DataFrame, words: int) -> DataFrame:
    """fp, set: the shingle sets of the ends' first documents."""
    ends = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = classes.join(ends, "fp", "left_semi").select("fp", "best.row")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    found = keyed.join(wanted.hint("shuffle_hash"), "row").select("fp", "text")
    return ws.write(arrow_map(found, partial(_sets, words=words), "fp long, set array<long>").dropDuplicates(["fp"]), "sets")


def _checked(ws: Workspace, docs: DataFrame, classes: DataFrame, links: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b, ok for links between fingerprints: their first documents' shingle sets have that Jaccard similarity."""
    sets = _set_table(ws, docs, classes, links, words)
    one = lambda end, name: sets.select(F.col("fp").alias(end), F.col("set").alias(name))
    pairs = links.join(one("a", "x"), "a").join(one("b", "y"), "b").select("a", "b", "x", "y")
    return ws.write(arrow_map(pairs, partial(_alike, similarity=similarity), "a long, b long, ok boolean"), "checked")


def _verified(ws: Workspace, docs: DataFrame, classes: DataFrame, nodes: DataFrame, masks: list[int], radius: int, words: int, similarity: float) -> DataFrame:
    """Links whose components are those of all pairs within the radius and of the similarity.

    As in line dedup: a spanning forest first, and where a link of it fails,
    pairs of its groups that are not connected yet.
    """
    links = ws.write(forest_links(ws, nodes, masks, radius), "links")
    sets = _set_table(ws, docs, classes, links, words).toDF("id", "body")
    roots = settle(ws, links, nodes, radius, 0.0, sets, partial(alike, similarity=similarity))
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _prefixes(batches, words: int, similarity: float):
    """row, text -> row, id (hash of the whole shingle set), size and keys, the set's least hashes."""
    for b in batches:
        ids, sizes, keys = [], [], []
        for t in utf8(b.column(1)):
            s = shingles(t, words)
            ids.append(signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)))
            sizes.append(len(s))
            keys.append(s[: len(s) - ceil(similarity * len(s) - 1e-9) + 1].view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "id", "size", "keys"])


def _missed(ws: Workspace, docs: DataFrame, fps: DataFrame, links: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links between fingerprints of all texts of the similarity that ``links`` leaves unconnected."""
    labels = ws.write(components(ws, links), "near")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    found = ws.write(arrow_map(rows, partial(_prefixes, words=words, similarity=similarity), "row long, id long, size long, keys array<long>"), "prefixes")
    owners = ws.write(found.select("row", "id").join(fps.select("row", "fp").distinct(), "row").groupBy("id", "fp").agg(F.min("row").alias("row")), "owners")
    first = ws.write(owners.groupBy("id").agg(F.min(F.struct("fp", "row")).alias("own")).select("id", "own.*"), "sets")
    labelled = first.join(labels, F.col("fp") == F.col("node"), "left").select("row", "fp", F.coalesce("root", "fp").alias("label"))
    nodes = found.dropDuplicates(["row"]).join(labelled, "row").select("id", "fp", "size", "label", "keys")
    keyed = ws.write(nodes, "keyed")
    ws.drop(found)
    n = keyed.agg(F.sum((1 - similarity) * F.col("size") + 1)).first()[0]
    # Most shingles are of one text: only those of two are dealt out.
    some = shared_keys(ws, keyed, int(n or 0))
    ws.drop(keyed)
    pairs = ws.write(labelled_links(ws, some, None, APART, similarity), "shared")
    ws.drop(some)
    ends = first.select(F.col("id").alias("fp"), F.struct("row").alias("best"))
    alike = _checked(ws, docs, ends, pairs, words, similarity).where("ok")
    end = lambda name, to: first.select(F.col("id").alias(name), F.col("fp").alias(to))
    same = owners.join(end("id", "a"), "id").where("a <> fp").select("a", F.col("fp").alias("b"))
    return alike.join(end("a", "x"), "a").join(end("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same)


def _classify(docs: DataFrame, words: int, radius: int, similarity: float | None = None, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of doc_id, row (a key of the whole row), fp; and fp, best: the first row of its component."""
    ws = Workspace(docs.sparkSession, "simhash")
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), "text")
    fps = ws.write(arrow_map(source, partial(_fingerprints, words=words), "doc_id long, row long, fp long"), "fingerprints")
    first = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row")
    classes = ws.write(fps.groupBy("fp").agg(F.min(first).alias("best")), "classes")
    joint, n = bit_statistics(classes)
    nodes, masks = classes.select(F.col("fp").alias("id"), "fp"), plan_masks(joint, n, radius)
    if similarity is None:
        links = forest_links(ws, nodes, masks, radius).select("a", "b")
    else:
        links = _verified(ws, docs, classes, nodes, masks, radius, words, similarity)
        if exact:
            links = links.unionByName(_missed(ws, docs, fps, links, words, similarity))
    roots = ws.write(components(ws, links), "roots")
    linked = ws.write(classes.join(roots, classes.fp == roots.node).select("fp", "best", "root"), "linked")
    tops = ws.write(linked.groupBy("root").agg(F.min("best").alias("top")), "tops")
    # Each side of the joins below is a written table, so that skew handling can split a hot class.
    moved = ws.write(linked.join(tops, "root").select("fp", "top"), "moved")
    final = ws.write(classes.join(moved, "fp", "left").select("fp", F.coalesce("top", "best").alias("best")), "final")
    return fps, final


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, similarity: float | None = None, exact: bool = False) -> DataFrame:
    """doc_id, fp long, component_id (the least doc_id reachable) for every row of ``docs``.

    Links are pairs of fingerprints within the radius and, where a similarity
    is given, of that Jaccard similarity of shingle sets; with ``exact`` all
    pairs of that similarity whose fingerprints differ in at most APART bits.
    """
    fps, final = _classify(docs, words, radius, similarity, exact)
    return fps.join(final, "fp").select("doc_id", "fp", F.col("best.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, radius: int = 8, similarity: float | None = 0.8, exact: bool = False) -> DataFrame:
    """One document of each component with all its columns: that of the least
    doc_id (null last). Of fully repeated rows one stays."""
    _, final = _classify(docs, words, radius, similarity, exact)
    base = positional(docs)
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    keyed = base.withColumn("row", F.xxhash64(doc_id, text)).withColumn("key", row_key(doc_id, text))
    keep = final.select(F.col("best.doc_id").alias("doc"), F.col("best.row").alias("kept"))
    same = (F.col("row") == F.col("kept")) & F.col(doc_id).cast("long").eqNullSafe(F.col("doc"))
    return keyed.join(keep, same, "left_semi").dropDuplicates(["key"]).select(*base.columns).toDF(*docs.columns)


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
