"""Invariants and small hand-made cases of the core operators."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold import config
from nearfold.functions import bits
from nearfold.operators import graph, kernels, links, records
from nearfold.sources import files

SK = "id long, w0 long, w1 long, w2 long, w3 long"


def test_constants():
    config.check()


def _sketches(n=120, seed=1):
    rng = random.Random(seed)
    rows = [[i, *[rng.getrandbits(32) for _ in range(4)]] for i in range(n)]
    for i in range(n, 2 * n):
        row = list(rows[rng.randrange(n)])
        row[0] = i
        for _ in range(rng.randrange(6)):
            row[1 + rng.randrange(4)] ^= 1 << rng.randrange(32)
        rows.append(row)
    return rows


def _distance(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a[1:], b[1:]))


def test_block_pairs_equal_brute_force(spark):
    rows = _sketches()
    got = {tuple(r) for r in links.block_pairs(spark.createDataFrame(rows, SK)).collect()}
    assert got == {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if _distance(a, b) < 3}


def test_large_blocks_give_pairs(spark):
    """Over 20,000 rows in a block, with copies and a pair that only this block joins."""
    rng = random.Random(3)
    rows = [(i, 5, rng.getrandbits(32), rng.getrandbits(32), rng.getrandbits(21) << 11) for i in range(20010)]
    _, w0, w1, w2, w3 = rows[7]
    rows += [(30000, w0, w1 ^ 1, w2 ^ 1, w3), (30001, w0, w1 ^ 1, w2 ^ 1, w3)]
    got = {tuple(r) for r in links.block_pairs(spark.createDataFrame(rows, SK)).collect()}
    assert got == {(7, 30000), (7, 30001), (30000, 30001)}


def test_plans_lie_between_radii(spark):
    rows = _sketches()
    sk = spark.createDataFrame(rows, SK)
    q = sk.where("id % 3 = 0").withColumnRenamed("id", "qid")
    exact = lambda d: {(a[0], b[0]) for a in rows if a[0] % 3 == 0 for b in rows if _distance(a, b) < d}
    words = {(r.qid, r.id) for r in links.probe(q, sk, links.WORD_KEYS).collect()}
    assert words == exact(4) == {(r.qid, r.id) for r in links.linear(q, sk).collect()}
    smart = {(r.qid, r.id) for r in links.smart(q, sk).collect()}
    assert exact(3) <= smart <= exact(4)
    assert exact(3) <= {(r.qid, r.id) for r in links.probe(q, sk, links.PAIR_KEYS).collect()} <= exact(4)


@pytest.mark.parametrize("n,kept", [(20, 20), (21, 0)])
def test_bucket_cap(spark, n, kept):
    rows = spark.range(n).select("id", *[F.lit(0).cast("long").alias(w) for w in links.WORDS])
    assert links.cap_buckets(links.block_rows(rows), 20).select("id").distinct().count() == kept


def test_bits_of_bytes(spark):
    raw = bytes(range(1, 17))
    words = [int.from_bytes(raw[4 * k : 4 * k + 4], "little") for k in range(4)]
    row = spark.createDataFrame([[0, *words]], SK).select(bits.sketch_hex().alias("h"), bits.bit_window(bits.sketch_hex(), 120, 16).alias("w"), bits.rotate(bits.sketch_hex(), 40).alias("r"), *[c.alias(f"k{i}") for i, c in enumerate(bits.sketch_split())]).first()
    assert row.h == raw.hex()
    assert row.w == (raw[15] << 8 | raw[0])
    assert row.r == (raw[5:] + raw[:5]).hex()
    w0, w1, w2, w3 = words
    assert (row.k0, row.k1, row.k2) == ((((w3 & 0x7FF) << 32) + w0) << 2, ((((w3 >> 11) & 0x7FF) << 32) + w1) << 2 | 1, (((w3 >> 22) << 32) + w2) << 2 | 2)
    with pytest.raises(ValueError):
        bits.rotate(F.lit(""), 4)


def test_unhex(spark):
    rows = spark.createDataFrame([("0aFF",), ("abc",), ("zz",), ("",)], "h string").select(bits.safe_unhex(F.col("h")).alias("b")).collect()
    assert [None if r.b is None else bytes(r.b) for r in rows] == [b"\x0a\xff", None, None, b""]


def test_merge_and_dense_ids(spark):
    rec = spark.createDataFrame([(i, f"{i % 7:040x}", 60, 60, i, f"u{i}", "p") for i in range(30)], "key long, checksum string, width long, height long, size long, url string, parent_url string")
    merged = {r.checksum: r for r in records.merge_by_checksum(rec, cap=3).collect()}
    assert len(merged) == 7 and merged[f"{2:040x}"].key == 2 and merged[f"{2:040x}"].urls == ["u2", "u9", "u16"]
    ids = records.dense_ids(rec).collect()
    assert sorted(r.image_id for r in ids) == list(range(30))
    with pytest.raises(Exception):
        img = records.dense_ids(rec).select("image_id", "checksum")
        records.map_ids(img, spark.createDataFrame([(0, 1)], "old_id long, new_id long")).collect()


def _push_by_hand(adj, seeds, alpha=0.5, eps=1e-5, steps=1000):
    import numpy as np

    f = np.float32
    p, r = {v: f(0) for v in seeds}, {v: f(1) / f(len(seeds)) for v in seeds}
    for _ in range(steps):
        big = [v for v in r if r[v] / f(len(adj[v])) >= f(eps)]
        if not big:
            break
        u = min(big)
        p[u] = p.get(u, f(0)) + f(alpha) * r[u]
        r[u] *= f((1 - alpha) / 2)
        t = r[u] / f(len(adj[u]))
        for v in adj[u]:
            r[v] = r.get(v, f(0)) + t
            p.setdefault(v, f(0))
    return p


@pytest.mark.parametrize("steps", [5, 1000])
def test_rank_order(steps):
    adj = {0: [1, 2], 1: [0, 2], 2: [0, 1, 3], 3: [2, 4, 5], 4: [3, 5], 5: [3, 4]}
    got, want = graph.push_rank(adj, [1, 4], steps=steps), _push_by_hand(adj, [1, 4], steps=steps)
    assert got.keys() == want.keys()
    assert all(abs(got[v] - float(want[v])) < 1e-6 for v in got)


def test_nibble_and_clusters(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3), (8, 9)]
    edge = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    seeds = spark.createDataFrame([(1, 0), (2, 77)], "qid long, id long")
    got = graph.nibble(seeds, edge).orderBy("qid", "rank").collect()
    assert [r.id for r in got if r.qid == 2] == [77]
    assert {0, 1, 2} <= {r.id for r in got if r.qid == 1}
    members = graph.clusters(edge)
    assert {r.id for r in members.collect()} == {0, 1, 2, 3, 4, 5, 8, 9}
    packed = graph.pack_ids(members, 12, capacity=8).collect()
    assert sorted(r.old_id for r in packed) == sorted(r.new_id for r in packed) == list(range(12))
    assert graph.asymmetric(edge).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing(seed):
    """Every cluster in one container, none over its capacity, and the largest that fits always taken."""
    rng, capacity = random.Random(seed), 16
    counts = {n: rng.randrange(0, 30) for n in range(2, capacity + 1)}
    boxes, ranks = {}, {n: [] for n in counts}
    for n, first, many, box, each, start in graph.packing(counts, capacity):
        for k in range(many):
            boxes.setdefault(box + k // each, []).append((start + k % each * n, n))
            ranks[n].append(first + k)
    assert all(ranks[n] == list(range(k)) for n, k in counts.items())
    assert sorted(boxes) == list(range(len(boxes)))
    left = dict(counts)
    for box in sorted(boxes):
        at, top = 0, max(n for n, k in left.items() if k)
        for start, n in sorted(boxes[box]):
            assert start == at and n == max(m for m, k in left.items() if k and m <= min(top, capacity - at))
            left[n] -= 1
            at += n
        assert at <= capacity
    assert graph.packing({}) == []


def test_binary_formats(spark):
    assert files.unframe(files.frame([(b"k", b"value"), (b"", b"x")])) == [(b"k", b"value"), (b"", b"x")]
    adj = spark.createDataFrame([(5, [9, 7])], "id long, nbrs array<long>")
    assert files.parse_graph(bytes(files.graph_bytes(adj).first().body)) == [(5, [7, 9])]


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.bin http://u/a\n{tmp_path}/gone http://u/b\n\n")
    blobs = files.read_blobs(spark, str(tmp_path), "*.bin")
    got = {r.url: bytes(r.content) for r in files.read_list(spark, str(tmp_path / "list.txt"), blobs).collect()}
    assert got == {"http://u/a": b"abc", "http://u/b": b""}
    n = files.merge_download(blobs, "content", str(tmp_path / "out"))
    assert n == 1 and (tmp_path / "out").read_bytes() == b"abc"
    assert files.segments(["x", "y/"], lambda p: p.startswith("y")) == ["y/content"]
    lines = spark.createDataFrame([('{"k": 3}',), ("",), ('{"k": 9}',)], "value string")
    assert [r.kk for r in files.json_lines(lines, "k int", "k > 4", ["k * 2 AS kk"]).collect()] == [18]


def test_session_stream(spark, tmp_path):
    from nearfold.streaming import sessions

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:30"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:00:00")], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = sessions.sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("s").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in sessions.sessions(rows).collect()) == [1, 1, 2]


def test_service(spark):
    from nearfold.plans.api import Engine

    rows = _sketches(40)
    sk = spark.createDataFrame(rows, SK)
    image = sk.select(F.col("id").alias("image_id"))
    engine = Engine(sk, image, links.edges(sk))
    q = sk.where("id < 4").select(F.lit(1).cast("long").alias("qid"), F.col("id").alias("ord"), *links.WORDS)
    found = engine.search(q)
    first = found.orderBy("rank").first()
    assert first.id == 0 and found.count() == len({b[0] for a in rows[:4] for b in rows if _distance(a, b) < 4})
    assert engine.page(found, 1, 2).count() == min(2, found.count() - 1)
    assert '"done":true' in engine.response(q, found).first().body
    assert engine.search_local(spark.createDataFrame([(999,)], "id long")).collect()[0].id == 999


def _pushed(adj, seeds, alpha=0.5, eps=1e-5, steps=1000):
    """One vertex and one neighbour at a time, in single precision."""
    f, p, r, pending = np.float32, {}, {}, set()

    def wake(v):
        if r[v] / f(len(adj[v])) >= f(eps):
            pending.add(v)

    for v in seeds:
        p[v], r[v] = f(0), f(1) / f(len(seeds))
        wake(v)
    for _ in range(steps):
        if not pending:
            break
        u = min(pending)
        p[u] += f(alpha) * r[u]
        r[u] *= f((1 - alpha) / 2)
        share = r[u] / f(len(adj[u]))
        if share < f(eps):
            pending.discard(u)
        for v in adj[u]:
            p.setdefault(v, f(0))
            r[v] = r.get(v, f(0)) + share
            wake(v)
    return {v: float(x) for v, x in p.items()}


def test_ranks_and_clusters_equal_single_pushes(spark):
    rng = random.Random(4)
    links_ = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(420)} | set(itertools.combinations(range(300, 340), 2))
    adj = {}
    for a, b in links_:
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, []).append(a)
    for seeds in ([min(adj)], [310], sorted(adj)[5:9]):
        assert graph.push_rank(adj, seeds) == _pushed({v: sorted(n) for v, n in adj.items()}, seeds)
    live, want = {v: set(n) for v, n in adj.items()}, []
    for seed in sorted(adj):
        if live.get(seed):
            p = _pushed({v: sorted(n) for v, n in live.items()}, [seed])
            want.append(sorted(p) if len(p) < 16 else sorted(p, key=lambda v: (-p[v] / len(live[v]), v))[:16])
            for v in want[-1]:
                for n in live.pop(v):
                    live.get(n, set()).discard(v)
    assert graph.cluster_component(adj, 16) == want
    edge = spark.createDataFrame([(a, b) for a in adj for b in adj[a]], "src long, dst long")
    asked = {1: [min(adj)], 2: [310], 3: [min(adj), 310, 320], 4: [311]}
    seeds = spark.createDataFrame([(q, v) for q, vs in asked.items() for v in vs], "qid long, id long")
    got = {}
    for r in graph.expand(seeds, edge).collect():
        got.setdefault(r.qid, {})[r.id] = r.p
    assert got == {q: _pushed({v: sorted(n) for v, n in adj.items()}, sorted(vs)) for q, vs in asked.items()}


def test_graph_of_classes_equals_graph_of_links(spark):
    """Clusters, ranks and sweeps of copies held by class are those of all their links one by one."""
    rng = random.Random(11)
    held, at = {}, list(range(400))
    rng.shuffle(at)
    while at:
        ids = [at.pop() for _ in range(min(len(at), rng.choice([1, 1, 1, 2, 3, 20])))]
        held[min(ids)] = ids
    near = {tuple(sorted(rng.sample(sorted(held), 2))) for _ in range(len(held) // 2)}
    pairs = [p for ids in held.values() for p in itertools.permutations(ids, 2)]
    pairs += [p for a, b in near for v in held[a] for w in held[b] for p in ((v, w), (w, v))]
    edge = spark.createDataFrame(pairs, "src long, dst long")
    by_class = {"edge": spark.createDataFrame([p for a, b in near for p in ((a, b), (b, a))], "src long, dst long"), "copies": spark.createDataFrame([(c, v) for c, ids in held.items() for v in ids], "class long, id long")}
    seeds = spark.createDataFrame([(v, v) for v in range(0, 500, 7)] + [(1000, v) for v in (3, 90, 91, 401, 450)] + [(1001, v) for v in range(1001)], "qid long, id long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    ranks = graph.expand(seeds, edge)
    assert rows(graph.expand(seeds, **by_class)) == rows(ranks) != []
    assert rows(graph.clusters(size=16, **by_class)) == rows(graph.clusters(edge, 16))
    swept = {(r.qid, r.id, r.pos + 2 * (r.qid == 1000)) for r in graph.sweep(ranks, edge).where("kept").collect()}
    linked = {v for p in pairs for v in p}
    lone = [(q, v) for q, v in rows(seeds) if v not in linked]
    want = swept | {(q, v, 1 + sum(x < (q, v) and x[0] == q for x in lone)) for q, v in lone}
    assert rows(graph.nibble(seeds, **by_class)) == rows(graph.nibble(seeds, edge)) == sorted(want)


@pytest.mark.parametrize("name", ["gr_cluster", "gr_pack_ids", "gr_nibble", "gr_rank"])
def test_copies_are_not_linked_one_by_one(spark, tmp_path, name):
    """2000 copies of a text have four million links; no table of them is written, and no row is lost."""
    from pathlib import Path

    from nearfold.queries import QUERIES

    texts = ["one text that many pages share word by word"] * 2000 + [f"{i} {i * i} {i * 7} words {i % 13} of its own {i ** 3}" for i in range(100)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    graph.shared_checkpoints(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before, got = size(), QUERIES[name](spark, str(tmp_path))
    if name == "gr_cluster":
        groups = {}
        for r in got.collect():
            groups.setdefault(r.cluster_id, []).append(r.id)
        assert sorted(v for g in groups.values() for v in g) == list(range(2000))
        assert all(c == min(g) and len(g) <= 256 for c, g in groups.items()) and len(groups) == 8
    elif name == "gr_pack_ids":
        ids = [tuple(r) for r in got.collect()]
        assert sorted(a for a, _ in ids) == sorted(b for _, b in ids) == list(range(2100))
    else:
        counts = {r.qid: r["count"] for r in got.groupBy("qid").count().collect()}
        assert counts == {q: 2000 if q < 2000 else 1 for q in range(0, 2000 if name == "gr_rank" else 2100, 10)}
    assert size() - before < 500_000


def test_many_queries_and_clusters_of_a_dense_graph_take_seconds():
    adj = {v: [w for w in range(1500) if w != v] for v in range(1500)}
    began = time.time()
    ranker = graph.Ranker(adj)
    for v in range(20):
        ranker.rank([v], 0.5, 1e-5, 1000)
    assert time.time() - began < 6


def test_l2_histogram_equals_pairs_one_by_one(spark):
    from nearfold.functions import vectors

    rng = random.Random(2)
    rows = [(i // 3, [rng.randrange(-20, 20) for _ in range(3 + (i % 5 == 0))]) for i in range(900)] + [(7, None), (20, [1, None, 3])]
    feat = spark.createDataFrame(rows, "image_id long, desc array<long>")
    pairs = kernels.image_pairs(feat, "image_id % 20 = 0", "true")
    want = kernels.histogram(pairs, F.floor(vectors.l2sqr(F.col("q_desc"), F.col("i_desc")) / 100), 9)
    got = kernels.l2_histogram(feat, "image_id % 20 = 0", "true", lambda d: np.floor(d / 100), 9)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_linear_scan_in_blocks(spark, monkeypatch):
    """Blocks of any size, ids of any kind and words without a value: every pair within the distance, once; and far more pairs a second than row by row."""
    rows = _sketches(150, 21)
    exact = {(a[0], b[0], _distance(a, b)) for a in rows for b in rows if a[0] % 10 == 0 and _distance(a, b) < 5}
    sk = spark.createDataFrame([*rows, [999, None, 0, 0, 0]], SK)
    q = sk.where("id % 10 = 0 or id = 999").select(F.struct("id").alias("qid"), *bits.WORDS)
    for block, tile in ((7, 2), (4096, 32)):
        monkeypatch.setattr(links, "BLOCK", block)
        monkeypatch.setattr(links, "TILE", tile)
        got = [(r.qid.id, r.id, r.d) for r in links.linear(q, sk, 5).collect()]
        assert len(got) == len(set(got)) and set(got) == exact
    assert links.linear(q.limit(0), sk).count() == links.linear(q, sk.limit(0)).count() == 0
    words = [F.xxhash64("id", F.lit(i)).bitwiseAND((1 << 32) - 1).alias(w) for i, w in enumerate(bits.WORDS)]
    many = spark.range(60000).select("id", *words)
    began = time.time()
    assert links.linear(many.where("id < 20000").withColumnRenamed("id", "qid"), many).count() == 20000
    assert time.time() - began < 25
