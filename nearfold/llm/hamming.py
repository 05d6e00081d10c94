"""Hamming-radius linking of 64-bit fingerprints through shared masked values.

A plan is a list of masks such that any two fingerprints within the radius
agree under at least one mask.  Rows are dealt out by a hash of (mask, value &
mask) and sorted by it, and each run of equal keys is one group; inside a
group a spanning forest of the links is enough, because only connectivity is
asked for.  Groups of many members are dealt over pairs of chunks, so that no
link is lost; chunks grow with the square root of the group, so that a group of
n makes under n * sqrt(n / CHUNK) rows and a task holds 2 * sqrt(n * CHUNK).

Two rows are linked when they share a group, differ in at most k bits and,
where a ratio is given, the lesser size is at least that of the greater.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, signed
from .components import components

#: Members up to which a group stays whole, and the share of fingerprints (one in so many, by hash) from which large groups are told.
CHUNK, SAMPLE = 4096, 16
#: Rows of a run up to which all its pairs are compared at once.
SHORT = 12
#: Pairs of a row that are checked at once in the second look, and members up to which a group stays whole there, where a pair costs far more.
LOOK, WHOLE = 16, 512
#: Pairs of different rows that are held until they are checked at once.
HELD = 512


def masked(fps: DataFrame, masks: list[int]) -> DataFrame:
    """One row for each fingerprint and mask: columns of ``fps`` and g, the group's key.

    Should two groups share a key, their pairs are verified like any others.
    """
    each = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(x)))) for i, x in enumerate(masks)])
    return fps.select("*", F.explode(each).alias("g"))


def by_keys(fps: DataFrame) -> DataFrame:
    """One row for each fingerprint and member of its array ``keys``: the other columns and g, the group's key."""
    return fps.select(*[c for c in fps.columns if c != "keys"], F.explode("keys").alias("g")).withColumn("g", F.col("g").cast("long"))


def grouped(fps: DataFrame, masks: list[int] | None) -> DataFrame:
    """Rows of ``fps`` by the groups of the masks or, where there are none, of their own keys."""
    return by_keys(fps) if masks is None else masked(fps, masks)


def hot_groups(ws: Workspace, fps: DataFrame, masks: list[int] | None) -> DataFrame:
    """g, chunks: the groups of many members and the chunks that each is dealt out in.

    Which groups count as large is told from a hash sample; that decides only
    how a group is dealt out, never which pairs meet.
    """
    sample = grouped(fps.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(SAMPLE)) == 0), masks)
    hot = sample.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > CHUNK)
    return ws.write(hot.select("g", F.ceil(F.sqrt(F.col("n") * SAMPLE / CHUNK)).cast("int").alias("chunks")), "hot")


def _chunk():
    return F.pmod(F.xxhash64("id", F.lit(2)), F.col("chunks")).cast("int")


def _others(c):
    """The chunks that chunk ``c`` of two at least is paired with."""
    return F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != c)


def dealt(fps: DataFrame, masks: list[int] | None, hot: DataFrame) -> DataFrame:
    """``fps`` and key: rows of a group meet under a key, large groups under one for each pair of chunks."""
    rows = grouped(fps, masks).join(hot, "g", "left")
    c = _chunk()
    pairs = F.transform(_others(c), lambda j: F.xxhash64("g", F.least(c, j), F.greatest(c, j)))
    keys = F.when(F.isnull("chunks"), F.array("g")).otherwise(pairs)
    return rows.select(*[c for c in fps.columns if c != "keys"], F.explode(keys).alias("key"))


def in_runs(rows: DataFrame) -> DataFrame:
    """Rows of equal key in one partition, next to each other."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key")


def runs(batches):
    """(columns by name, offsets of whole runs of equal key) from sorted batches."""
    held = None
    for b in batches:
        new = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns)}
        new["fp"] = new["fp"].view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
        held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in new}
        cut = np.flatnonzero(np.diff(held["key"])) + 1
        if len(cut):
            yield {n: c[: cut[-1]] for n, c in held.items()}, np.concatenate([[0], cut])
            held = {n: c[cut[-1] :] for n, c in held.items()}
    if held and len(held["key"]):
        yield held, np.array([0, len(held["key"])])


def _near(fps, sizes, x, y, k, ratio):
    ok = np.bitwise_count(fps[x] ^ fps[y]) <= k
    return ok & (np.minimum(sizes[x], sizes[y]) >= ratio * np.maximum(sizes[x], sizes[y])) if ratio else ok


def spanning(fps: np.ndarray, sizes: np.ndarray | None, k: int, ratio: float = 0.0) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the linked pairs."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _near(fps, sizes, x, left, k, ratio)
            if near.any():
                found = left[near]
                edges += [(x, y) for y in found]
                queue += list(found)
                left = left[~near]
    return edges


def _pairs(a, b):
    a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _short(off):
    """(x, y): all pairs of positions in runs of at most SHORT rows, by distance in the run."""
    n = np.diff(off)
    left = np.repeat(off[1:], n) - np.arange(off[-1])
    left[np.repeat(n > SHORT, n)] = 0
    for lag in range(1, int(left.max(initial=1))):
        x = np.flatnonzero(left > lag)
        yield x, x + lag


def _kruskal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs (x < y), taken in order, join what is not joined yet."""
    root: dict[int, int] = {}
    used = []
    for a, b in zip(x.tolist(), y.tolist()):
        while (up := root.get(a, a)) != a:
            root[a] = a = root.get(up, up)
        while (up := root.get(b, b)) != b:
            root[b] = b = root.get(up, up)
        used.append(a != b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array(used, bool)


def _forest(batches, k: int, ratio: float):
    for cols, off in runs(batches):
        ids, fps, sizes, n = cols["id"], cols["fp"], cols.get("size"), np.diff(off)
        # Short runs: every pair at once. Pairs of the least id come first, so that the forests of different groups are alike.
        x, y = (np.concatenate([np.zeros(0, np.int64), *part]) for part in (list(zip(*((x[ok], y[ok]) for x, y in _short(off) for ok in [_near(fps, sizes, x, y, k, ratio)]))) or ([], [])))
        run = np.searchsorted(off, x, side="right") - 1
        x, y = np.where(ids[x] <= ids[y], x, y), np.where(ids[x] <= ids[y], y, x)
        order = np.lexsort((ids[y], ids[x], run))
        x, y, run = x[order], y[order], run[order]
        used = _kruskal(x, y)
        left = np.bincount(run[~used], minlength=len(n))[run] > 0
        a, b, keys, whole = [ids[x[used]]], [ids[y[used]]], [cols["key"][off[run[used]]]], [~left[used]]
        # Long runs: a spanning forest each.
        for i in np.flatnonzero(n > SHORT):
            s = slice(off[i], off[i + 1])
            at = off[i] + np.argsort(ids[s], kind="stable")
            if edges := spanning(fps[at], sizes[at] if ratio else None, k, ratio):
                e = at[np.array(edges)]
                a.append(ids[e[:, 0]])
                b.append(ids[e[:, 1]])
                keys.append(np.full(len(e), cols["key"][off[i]]))
                whole.append(np.zeros(len(e), bool))
        yield pa.RecordBatch.from_arrays([*_pairs(a, b).columns, pa.array(np.concatenate(keys), mask=np.concatenate(whole))], ["a", "b", "key"])


def forest_links(ws: Workspace, fps: DataFrame, masks: list[int] | None, k: int, ratio: float = 0.0) -> DataFrame:
    """Links (a < b, ids) whose connected components are those of all linked pairs; key: the
    group that a link stands for others in, null where all linked pairs of the group are given.

    ``fps``: id long (unique), fp long and, with a ratio, size long; without
    masks also keys, an array of integers: rows that share one form a group.
    """
    rows = dealt(fps, masks, hot_groups(ws, fps, masks))
    return arrow_map(in_runs(rows), partial(_forest, k=k, ratio=ratio), "a long, b long, key long").where("a <> b").distinct()


def failed_groups(links: DataFrame, checked: DataFrame) -> DataFrame:
    """key, id: the members of the groups of ``links`` for which a link that stands for others failed its
    check (a, b, ok). A member near any other of its group is in a link of the group's forest."""
    forest = links.where("key is not null")
    keys = forest.join(checked.where("not ok").select("a", "b"), ["a", "b"], "left_semi").select("key").distinct()
    return forest.join(keys, "key", "left_semi").select("key", F.explode(F.array("a", "b")).alias("id")).distinct()


def _cross(batches, k: int, ratio: float):
    for cols, off in runs(batches):
        ids, fps, sizes, label = (cols.get(n) for n in ("id", "fp", "size", "label"))
        a, b = [], []
        for x, y in _short(off):
            ok = (label[y] != label[x]) & _near(fps, sizes, x, y, k, ratio)
            a.append(ids[x[ok]])
            b.append(ids[y[ok]])
        yield _pairs(a, b)
        for i in np.flatnonzero(np.diff(off) > SHORT):
            a, b = [], []
            for x in range(off[i], off[i + 1] - 1):
                y = np.arange(x + 1, off[i + 1])
                y = y[(label[y] != label[x]) & _near(fps, sizes, x, y, k, ratio)]
                a.append(np.full(len(y), ids[x]))
                b.append(ids[y])
            yield _pairs(a, b)


def labelled_links(ws: Workspace, fps: DataFrame, masks: list[int] | None, k: int, ratio: float = 0.0) -> DataFrame:
    """All linked pairs of different labels; ``fps`` with a column label."""
    rows = dealt(fps, masks, hot_groups(ws, fps, masks))
    return arrow_map(in_runs(rows), partial(_cross, k=k, ratio=ratio), "a long, b long").where("a <> b").distinct()


def _first_look(batches, check):
    for b in batches:
        ok = check(b.column(2).to_pylist(), b.column(3).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _second_look(batches, k: int, ratio: float, check):
    """Links that pass the check and connect what isn't yet. A pair is looked at in the first of the groups that hold both,
    a pair of one chunk just where the chunk is at home. The pairs of many rows are checked at once; a row of more than
    LOOK pairs goes on when its nearest are known, with twice as many at once where none of them was linked."""
    for cols, off in runs(batches):
        ids, fps, sizes, keys, body = (cols.get(n) for n in ("id", "fp", "size", "keys", "body"))
        labels = cols["label"].copy()
        a, b, held = [], [], []

        def settled():
            open_ = [(s, x, j) for s, x, j in held if labels[x] != labels[j]]
            held.clear()
            for (s, x, j), ok in zip(open_, check([body[x] for _, x, _ in open_], [body[j] for _, _, j in open_]) if open_ else ()):
                if ok and labels[x] != labels[j]:
                    a.append(ids[x])
                    b.append(ids[j])
                    label = labels[s]
                    label[label == labels[j]] = labels[x]

        for i in np.flatnonzero(np.diff(off) > 1):
            s = slice(off[i], off[i + 1])
            at = np.arange(off[i], off[i + 1])
            label, key, chunk, home = labels[s], cols["group"][off[i]], cols["chunk"][s], cols["home"][s]
            if (label == label[0]).all():
                continue
            others = [frozenset(x[x < key].tolist()) for x in keys[s]]
            for x in range(len(at) - 1):
                meet = (label[x + 1 :] != label[x]) & (home[x] | (chunk[x + 1 :] != chunk[x]))
                y = x + 1 + np.flatnonzero(meet & _near(fps, sizes, at[x], at[x + 1 :], k, ratio))
                y = y[[others[x].isdisjoint(others[j]) for j in y.tolist()]] if len(y) else y
                y = y[np.argsort(np.bitwise_count(fps[at[y]] ^ fps[at[x]]), kind="stable")]
                look = LOOK
                while len(y):
                    some, y = y[:look], y[look:]
                    held += [(s, int(at[x]), int(at[j])) for j in some.tolist()]
                    if len(y) or len(held) >= HELD:
                        found = len(a)
                        settled()
                        look = LOOK if len(a) > found else min(2 * look, HELD)
                        y = y[label[y] != label[x]]
        settled()
        yield _pairs([np.array(a, np.int64)], [np.array(b, np.int64)])


def _dealt_failed(failed: DataFrame, some: DataFrame) -> DataFrame:
    """``some`` (key, id, ...) for the second look: large groups over pairs of chunks, with group (the key before), chunk and home."""
    large = failed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE)
    rows = some.join(large.select("key", (F.ceil(F.sqrt(F.col("n") / WHOLE)) + 1).cast("int").alias("chunks")), "key", "left")
    c = _chunk()
    deal = lambda key, chunk, home: F.struct(key.alias("key"), chunk.alias("chunk"), home.alias("home"))
    pairs = F.transform(_others(c), lambda j: deal(F.xxhash64("key", F.least(c, j), F.greatest(c, j)), c, j == F.pmod(c + 1, F.col("chunks"))))
    deals = F.when(F.isnull("chunks"), F.array(deal(F.col("key"), F.lit(0), F.lit(True)))).otherwise(pairs)
    rows = rows.select(F.col("key").alias("group"), *[x for x in some.columns if x != "key"], F.explode(deals).alias("deal"))
    return rows.select("*", "deal.*").drop("deal")


def merged(ws: Workspace, roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) with the components joined that ``links`` (a, b) connect; only the components' roots take part."""
    root_of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    tops = ws.write(components(ws, ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))).toDF("old", "top"), "tops")
    moved = roots.join(tops, roots.root == tops.old, "left").select("node", F.coalesce("top", "root").alias("root"))
    new = tops.join(roots, roots.node == tops.old, "left_anti").select("old", "top")
    return ws.write(moved.unionByName(new.toDF("node", "root")), "roots")


def settle(ws: Workspace, links: DataFrame, fps: DataFrame, k: int, ratio: float, bodies: DataFrame, check) -> DataFrame:
    """(node, root) of the components of all linked pairs of ``fps`` that pass ``check``.

    ``links`` are those of ``forest_links``; ``bodies`` (id, body) has what the
    check compares for all their ends; ``check`` takes two lists of bodies and
    gives a list of truths.  The forests' links are checked first.  Where one
    fails that stands for others, the near pairs of its group that aren't
    connected yet are checked inside the group, nearest first, and just the
    links that connect come out; so no linked pair goes unchecked whose ends
    aren't connected anyhow, and no row is made for each pair.
    """
    one = lambda id_, body: bodies.select(F.col("id").alias(id_), F.col("body").alias(body))
    pairs = links.select("a", "b").distinct().join(one("a", "x"), "a").join(one("b", "y"), "b").select("a", "b", "x", "y")
    seen = ws.write(arrow_map(pairs, partial(_first_look, check=check), "a long, b long, ok boolean"), "checked")
    roots = ws.write(components(ws, seen.where("ok").select("a", "b")), "roots")
    failed = ws.write(failed_groups(links, seen), "failed")
    if not failed.limit(1).count():
        return roots
    # A member is in as many groups as it has keys, at most.
    groups = failed.groupBy("id").agg(F.collect_list("key").alias("keys"))
    some = failed.join(groups, "id").join(fps.drop("keys"), "id").join(bodies, "id").join(roots, F.col("id") == F.col("node"), "left")
    some = some.withColumn("label", F.coalesce("root", "id")).drop("node", "root")
    more = ws.write(arrow_map(in_runs(_dealt_failed(failed, some)), partial(_second_look, k=k, ratio=ratio, check=check), "a long, b long").distinct(), "more")
    return merged(ws, roots, more) if more.limit(1).count() else roots


def block_masks(k: int, bits: int = 64) -> list[int]:
    """Pigeonhole blocks: within k differing bits at least one of k + 1 blocks is equal; a mask for each block."""
    edges = [bits * i // (k + 1) for i in range(k + 2)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
