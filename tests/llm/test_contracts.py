"""Contract queries against brute force, on the small tables and on hand-made rows."""

import itertools
import random
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearfold.llm import common, components, decontaminate, hamming, html_extract, license_scan, line_dedup, marks, quality, sentencepiece_fst, sharding, simhash, token_binary, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, row string"
SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["the", "of", "And", "rönt", "idiot", "x" * 40, "a,b", "1.5", "日本", "🎉"]
    out = [(None, None), (0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (4, "Two words"), (5, "same same same same"), (6, "tab\tand\r\nbreak \x0b\x0c end"), (None, "lost key"), (-9, "negative id"), (7, " lead"), (8, "trail ")]
    for i in range(20, 60):
        out.append((i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5)))))
    out.append((100, " ".join(rng.choice(words) for _ in range(60000))))
    out.append((101, out[-1][1]))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # The last two columns clash with names that the operators use inside.
    return spark.createDataFrame([(i, t, "en", None, None, 3, "r") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(20, 60)] + [(None, 1, 1), (21, None, None)], "doc_id long, quality int, toxic int")


def _docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# --- op2 ---


def _ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_binary.default_tokenizer())
    return [np.array([*e.ids, 0], "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_tokens_round_trip(spark, docs, rows):
    segments, dictionary = token_binary.write_tokens(docs, common.Workspace(spark, "t"))
    got = token_binary.read_tokens(segments, dictionary).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    want = Counter((i, len(x) // 4, zlib.crc32(x)) for (i, _), x in zip(rows, _ids([t for _, t in rows])))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    body = bytes(segments.first().body)
    k = 3
    index, _ = token_binary.open_segment(body, dictionary)
    assert len(token_binary.read_document(body, dictionary, k)) == index["ids"][k]
    with pytest.raises(ValueError):
        token_binary.open_segment(body, dictionary + b"x")


def test_tokens_equal_library():
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b\nc d", "<|endoftext", "plain text, twice.\nplain text", None]
    assert [token_binary.with_end(x) for x in token_binary.encoder(token_binary.default_tokenizer()).encode(texts)] == _ids(texts)


def test_tokens_of_table(spark, data):
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_binary.op2_token_binary(spark, data).collect()}
    table = _docs(spark, data).collect()
    assert got == {r.doc_id: (len(x) // 4, zlib.crc32(x)) for r, x in zip(table, _ids([r.text for r in table]))}


def test_tokens_empty(spark, empty):
    segments, dictionary = token_binary.write_tokens(empty, common.Workspace(spark, "t"))
    assert token_binary.read_tokens(segments, dictionary).count() == 0


# --- op3 ---


def test_pieces_equal_library():
    import sentencepiece

    path = sentencepiece_fst.default_model()
    fst, sp = sentencepiece_fst.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "日", "🎉", "\t", "00", "...", "=", "xxx", "▁", "\x00"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(15)))
        ids = sp.encode(text)
        assert np.frombuffer(fst.encode(text), "<u4").tolist() == ids, text
        assert fst.decode(ids) == sp.decode(ids)
    for n in range(40):
        assert np.frombuffer(fst.encode(" " * n + "x"), "<u4").tolist() == sp.encode(" " * n + "x")


def test_long_runs_and_words():
    import sentencepiece

    path = sentencepiece_fst.default_model()
    fst, sp = sentencepiece_fst.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for n in [*range(40, 200), 5000]:
        for text in (" " * n, "a" + " " * n + "b\n" + " " * n):
            assert np.frombuffer(fst.encode(text), "<u4").tolist() == sp.encode(text)
    start = time.process_time()
    for text in (" " * 1_000_000, "ab" * 500_000):
        assert fst.decode(np.frombuffer(fst.encode(text), "<u4").tolist()) == text
    assert time.process_time() - start < 20


def test_shortest_path_of_unigram_scores():
    """Least sum over all ways to cut a text into pieces, characters without a piece as bytes."""
    rng = random.Random(8)
    mark = sentencepiece_fst.MARK
    for _ in range(30):
        known = {*"abc", mark, *("".join(rng.choice("abc" + mark) for _ in range(rng.randrange(2, 5))) for _ in range(15))}
        pieces = [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(p, -rng.random() * len(p) - 0.1, 1) for p in sorted(known)]
        fst = sentencepiece_fst.Transducer.__new__(sentencepiece_fst.Transducer)
        fst.compile(pieces, True, sentencepiece_fst.UNIGRAM)
        cost = {p: -s for p, s, t in pieces if t == 1}
        for _ in range(20):
            text = "".join(rng.choice("abc é") for _ in range(rng.randrange(1, 12)))
            norm = mark + text.replace(" ", mark)
            best = [0.0] + [np.inf] * len(norm)
            for j in range(1, len(norm) + 1):
                best[j] = min(best[i] + (cost[norm[i:j]] if norm[i:j] in cost else fst.unknown if norm[i:j] == "é" else np.inf) for i in range(j))
            ids = np.frombuffer(fst.encode(text), "<u4").tolist()
            assert abs(sum(cost.get(fst.text[i], 0.0) for i in ids) + text.count("é") * fst.unknown - best[-1]) < 1e-6
            assert fst.decode(ids) == text


def test_pieces_of_rows(spark, docs, rows, empty):
    got = sentencepiece_fst.round_trip(docs).collect()
    assert len(got) == len(rows) and all(r.same for r in got)
    texts = Counter((r.doc_id, r.text) for r in sentencepiece_fst.decode(sentencepiece_fst.encode(docs)).collect())
    assert texts == Counter((i, t or "") for i, t in rows)
    assert sentencepiece_fst.round_trip(empty).count() == 0


# --- op4 ---


def test_marginals_equal_enumeration():
    from itertools import product

    field = toxicity.Field(np.zeros(1 << toxicity.BITS, np.float32), -0.5, np.array([[0.3, -0.8], [0.1, 0.9]]), (1, 1, 1, 1))
    field.memo = {"a": 0.3, "b": 2.5, "c": 0.9}
    words = list("abcba")
    total, on = 0.0, np.zeros(5)
    for ys in product((0, 1), repeat=5):
        w = np.prod([field.memo[x] if y else 1 for x, y in zip(words, ys)]) * np.exp(sum(field.trans[a, b] for a, b in zip(ys, ys[1:])))
        total += w
        on += w * np.array(ys)
    assert np.allclose(field.marginals(words), on / total)
    assert field.marginals([]) == []


def test_toxic_held_out(spark):
    rng = random.Random(1)
    made = []
    for i in range(900):
        ws = ["".join(rng.choice(["the", "er", "on", "ing", "sh"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                ws[rng.randrange(60)] = rng.choice(["moron", "Scum!", "zonkish", "zonkery"])
        made.append((i, " ".join(ws), int(i % 4 == 0)))
    df = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    out = {r.doc_id: r for r in toxicity.score(df, df.select("doc_id", "toxic")).collect()}
    for i, text, y in made:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert out[i].predicted == int(out[i].score >= 0.3)
    held = [(out[i].predicted, y) for i, _, y in made if out[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    hit = out[0]
    assert hit.spans and all(any(x in made[0][1][s.start : s.stop].lower() for x in ("moron", "scum", "zonk")) for s in hit.spans)


def test_toxic_edges(spark, docs, rows, empty, labels):
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.score(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score(empty, labels).count() == 0


# --- op5 ---


def _fingerprint(text):
    words = [w for w in _lower(text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _classes(fps, radius=2):
    """Least id of each id's component, by comparing all."""
    left, out = dict(fps), {}
    while left:
        group, todo = set(), [next(iter(left))]
        while todo:
            i = todo.pop()
            if i in left:
                f = left.pop(i)
                group.add(i)
                todo += [j for j, g in left.items() if (f ^ g).bit_count() <= radius]
        out |= {i: min(group) for i in group}
    return out


def test_simhash_of_table(spark, data):
    table = _docs(spark, data).collect()
    fps = {r.doc_id: _fingerprint(r.text) for r in table}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash_near_dedup(spark, data).collect()}
    want = _classes(fps)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}


def test_simhash_edges(spark, docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {0}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs, words=3, radius=2, similarity=None)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.component_id for r in got} - {None} if all(r.component_id is not None for r in got) else {r.component_id for r in got})


def test_near_copies_by_similarity(spark):
    """All pairs within 8 bits and of Jaccard similarity 0.8 on 5-word shingles, by comparing all."""
    rng = random.Random(11)
    vocab = ["w%03d" % i for i in range(500)]
    made = []
    for i in range(150):
        if i % 3 and made:
            ws = rng.choice(made[-3:])[1].split()
            for _ in range(rng.randrange(4)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
        else:
            ws = [rng.choice(vocab) for _ in range(rng.randrange(60, 200))]
        made.append((i, " ".join(ws)))
    sets = {i: set(simhash.shingles(t.encode(), 5).tolist()) for i, t in made}
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in made}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if fps[a] == fps[b] or (fps[a] ^ fps[b]).bit_count() <= 8 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 8, 0.8).collect()}
    assert got == {i: find(i) for i in sets}
    assert len(set(got.values())) < 150
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == set(got.values())


def test_near_copies_beyond_the_radius(spark):
    """All pairs of Jaccard similarity 0.8, by comparing all; many differ in more than 8 bits."""
    rng = random.Random(12)
    vocab = ["w%03d" % i for i in range(500)]
    made = [(500, None), (501, ""), (502, "one two"), (503, "One  two")]
    for i in range(160):
        ws = made[-1][1].split() if i % 2 else [rng.choice(vocab) for _ in range(rng.randrange(60, 200))]
        for _ in range(len(ws) // 70 + 1 if i % 2 else 0):
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
        made.append((i, " ".join(ws)))
    sets = {i: set(simhash.shingles((t or "").encode(), 5).tolist()) for i, t in made}
    fps = {i: simhash.fingerprint((t or "").encode(), 5) for i, t in made}
    pairs = [(a, b) for a in sets for b in sets if a < b and (fps[a] == fps[b] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    assert sum((fps[a] ^ fps[b]).bit_count() > 8 for a, b in pairs) > 5
    root = {i: i for i in sets}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 8, 0.8, exact=True).collect()} == root
    assert {r.doc_id for r in simhash.drop_near_duplicates(df, exact=True).collect()} == set(root.values())


@pytest.mark.parametrize("seed,radius", [(0, 2), (1, 2), (2, 3)])
def test_generalised_pigeonhole_misses_nothing(spark, seed, radius, monkeypatch):
    """Near copies by the hundred, so that groups are dealt over chunks too."""
    monkeypatch.setattr(hamming, "CHUNK", 16)
    monkeypatch.setattr(hamming, "SAMPLE", 1)
    rng = random.Random(seed)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < 300:
        f = base
        for _ in range(rng.randrange(5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f if rng.random() < 0.7 else rng.getrandbits(64))
    ids = {common.signed(f): f for f in fps}
    df = spark.createDataFrame([(i, i, 0) for i in ids], "id long, fp long, size long")
    joint, n = simhash.bit_statistics(df)
    masks = simhash.plan_masks(joint, n, radius)
    ws = common.Workspace(spark, "t")
    roots = {r.node: r.root for r in components.components(ws, hamming.forest_links(ws, df, masks, radius)).collect()}
    want = _classes(ids, radius)
    assert {i: roots.get(i, i) for i in ids} == want


@pytest.mark.parametrize("n", [256, 1024])
def test_rows_of_a_large_group_grow_by_less_than_its_square(spark, n, monkeypatch):
    monkeypatch.setattr(hamming, "CHUNK", 16)
    monkeypatch.setattr(hamming, "SAMPLE", 1)
    ws = common.Workspace(spark, "t")
    df = spark.createDataFrame([(i, i, [7]) for i in range(n)], "id long, fp long, keys array<long>")
    rows = hamming.dealt(df, None, hamming.hot_groups(ws, df, None)).collect()
    assert len(rows) <= n * (n / 16) ** 0.5
    keys = {}
    for r in rows:
        keys.setdefault(r.id, set()).add(r.key)
    assert all(keys[a] & keys[b] for a in keys for b in keys) and len(keys) == n


@pytest.mark.parametrize("whole", [8, 512])
def test_failed_groups_are_settled_over_chunks(spark, whole, monkeypatch):
    """One group of 120 near fingerprints, of which few pairs pass the check: all that connect are found, in n * sqrt(n / WHOLE) rows."""
    monkeypatch.setattr(hamming, "WHOLE", whole)
    rng, n = random.Random(5), 120
    bodies = {i: str(rng.randrange(40)) + "x" * rng.randrange(2) for i in range(n)}
    check = lambda x, y: [abs(int(a.strip("x")) - int(b.strip("x"))) <= ("x" in a and "x" in b) for a, b in zip(x, y)]
    ws = common.Workspace(spark, "t")
    df = spark.createDataFrame([(i, 1 << i % 60, 9, [7, i % 3]) for i in range(n)], "id long, fp long, size int, keys array<long>")
    texts = spark.createDataFrame(list(bodies.items()), "id long, body string")
    links = ws.write(hamming.forest_links(ws, df, None, 2), "links")
    roots = {r.node: r.root for r in hamming.settle(ws, links, df, 2, 0.5, texts, check).collect()}
    want = {i: i for i in bodies}
    for _ in bodies:
        for a, b in itertools.combinations(bodies, 2):
            if check([bodies[a]], [bodies[b]])[0]:
                want[a] = want[b] = min(want[a], want[b])
    assert {i: roots.get(i, i) for i in bodies} == want
    failed = spark.createDataFrame([(7, i) for i in range(n)], "key long, id long")
    assert hamming._dealt_failed(failed, failed).count() <= n * -(-((n / whole) ** 0.5) // 1)


def test_thresholds_cover_the_radius():
    for parts in (2, 3, 4):
        cost, ts = simhash.allocate([[0, 5, 50, 500]] * parts, 2 - parts + 1)
        assert sum(ts) == 2 - parts + 1 and all(t >= -1 for t in ts)


# --- op6 ---


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == _lev(a, b)
        a, b = (" ".join(rng.choice(["ab", "abc", "x", "yz"]) for _ in range(rng.randrange(1, 9))) for _ in range(2))
        assert line_dedup.similar(a, b, 0.7) == (_lev(a, b) <= 0.3 * max(len(a), len(b)) + 1e-9)
        assert line_dedup.edits_by_word(a.split(" "), b.split(" "), 1e9) >= _lev(a, b)
        assert not (line_dedup.far_apart([a], [b], 0.7)[0] and line_dedup.similar(a, b, 0.7))


def test_pairs_side_by_side():
    """The check of many pairs at once says what that of each pair says, and ends early where pairs are unlike."""
    rng = random.Random(12)
    x, y = [], []
    for _ in range(900):
        letters = rng.choice(["abc", "ab ", "a\u00e9\u2713"])
        a = [rng.choice(letters) for _ in range(rng.randrange(70))]
        b = list(a)
        for _ in range(rng.randrange(20)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        x.append("".join(a))
        y.append("".join(b))
    for s in (0.8, 0.5):
        assert line_dedup.all_similar(x, y, s) == [line_dedup.similar(a, b, s) for a, b in zip(x, y)]
    assert line_dedup.all_similar([], []) == []
    room = np.array([max(abs(len(a) - len(b)), 5) for a, b in zip(x, y)])
    assert line_dedup.within(x, y, room).tolist() == [line_dedup.edit_distance(a, b) <= r for a, b, r in zip(x, y, room)]


def test_distances_of_many_pairs():
    """Pairs that share one long number have the distances that each has alone, empty and wide texts too."""
    rng = random.Random(13)
    for letters in ("ab", "abc d", "a\u00e9\u2713\U0001f600x"):
        x, y = (["".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice([2, 20, 90])))) for _ in range(70)] for _ in range(2))
        assert line_dedup.distances(x, y).tolist() == [line_dedup.edit_distance(a, b) for a, b in zip(x, y)]


def test_lines_of_many_texts():
    rng = random.Random(14)
    parts = [b" ", b"\n", b"a", b"B", b".", b"-", b"\t", b"\r", b"\x0b", b"\x85", "\u00e9".encode(), b"7", b"\x00"]
    for _ in range(3000):
        texts = [b"".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(4))]
        got, n = line_dedup.batch_lines(texts)
        want = [line_dedup.normal_lines(t) for t in texts]
        assert n.tolist() == [len(x) for x in want] and got == [x for own in want for x in own]


def test_line_simhash_blocks_part_unlike_lines(spark):
    """Fingerprints within the sure bits share a block; of 20,000 unlike ones hardly any two do."""
    rng = random.Random(15)
    fps = [rng.getrandbits(64) for _ in range(20000)]
    near = [f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in fps[:500]]
    table = lambda xs: spark.createDataFrame([(i, common.signed(x)) for i, x in enumerate(xs)], "id long, fp long").select("id", F.explode(line_dedup.simhash_blocks()).alias("key"))
    groups = table(fps).groupBy("key").count()
    assert groups.selectExpr("sum(count * (count - 1) / 2)").first()[0] < 20
    assert table(fps[:500]).join(table(near), ["id", "key"]).select("id").distinct().count() == 500


def test_marks_find_all_shared_keys(spark):
    """Keys of two rows are never left out, whatever the map's size; most of one row are, and so are not dealt out."""
    rng = random.Random(13)
    rows = [(i, [rng.getrandbits(63) for _ in range(9)] + [rng.randrange(1500)] + [-5] * (i % 400 == 0)) for i in range(3000)]
    rows.append((3000, []))
    df = spark.createDataFrame(rows, "id long, keys array<long>")
    seen = Counter(k for _, keys in rows for k in set(keys))
    ws = common.Workspace(spark, "test")
    for n in (30000, 10):
        got = {r.id: r["keys"] for r in marks.shared_keys(ws, df, n).collect()}
        for i, keys in rows:
            assert {k for k in keys if seen[k] > 1} <= set(got.get(i, ())) <= set(keys)
    got = marks.shared_keys(ws, df, 30000)
    due = sum(seen[k] > 1 for _, keys in rows for k in keys)
    assert got.agg({"id": "count"}).first()[0] <= 3000
    assert sum(len(r["keys"]) for r in got.collect()) <= due + 0.1 * 30000
    told = marks.marks(ws, df.select("id"), 3001, 16).value
    assert marks.marked(np.arange(3001), told).all() and marks.marked(np.arange(10**6, 10**6 + 10000), told).mean() < 0.15
    assert not marks.marked(np.arange(100), marks.marks(ws, df.select("id").limit(0), 0, 16).value).any()


def test_line_dedup_deals_out_shared_blocks_only(spark, data, monkeypatch):
    """Lines without any block of another line make no rows in the join, and texts are dealt out once, not twice."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    dealt = []
    monkeypatch.setattr(line_dedup, "forest_links", lambda ws, nodes, *more: dealt.append(nodes.selectExpr("sum(size(keys))").first()[0]) or hamming.forest_links(ws, nodes, *more))
    line_dedup.dedup_lines(docs).collect()
    lines = {x for r in docs.collect() for x in line_dedup.normal_lines((r.text or "").encode()) if x}
    assert 0 < dealt[0] < 4 * len(lines)


def _near_lines(texts):
    """All pairs (a > b) of different lines of edit similarity 0.8 or more; compared one by one."""
    texts = [x.decode() for x in texts]
    bags = np.array([np.bincount(np.array([ord(c) for c in x]) % 256, minlength=256) for x in texts], np.int32)
    sizes = np.array([len(x) for x in texts])
    for a in range(1, len(texts)):
        # An edit takes one character away and puts one in, at most.
        more = bags[:a] - bags[a]
        least = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
        for b in np.flatnonzero(least <= 0.2 * np.maximum(sizes[:a], sizes[a]) + 1e-9):
            x, y = texts[a], texts[b]
            if line_dedup.edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                yield a, int(b)


def _groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_line_dedup_against_all_pairs(spark):
    """Every pair of lines compared by edit similarity alone: nothing else is dropped, and nearly all of it is."""
    rng = random.Random(5)
    vocab = ["w%03d" % i for i in range(300)]
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 40))) for _ in range(120)]
    made = []
    for i in range(80):
        own = []
        for _ in range(4):
            ws = rng.choice(lines).split()
            if rng.random() < 0.6:
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            own.append(" ".join(ws).capitalize() + ".")
        made.append((i, "\n".join([*own, "", "--"])))
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    seen = {}
    for i, t in made:
        for j, x in enumerate(line_dedup.normal_lines(t.encode())):
            if x:
                seen.setdefault(x, (i, j))
    texts, first = list(seen), {}
    root = _groups(len(texts), _near_lines(texts))
    for k, x in enumerate(texts):
        first[root[k]] = min(first.get(root[k], (1 << 60, 0)), seen[x])
    keep = set(first.values())
    due = found = 0
    for i, t in made:
        real = [(j, x) for j, x in enumerate(line_dedup.normal_lines(t.encode()))]
        wanted = [y for (j, x), y in zip(real, t.split("\n")) if not x or (i, j) in keep]
        due += sum(bool(x) and (i, j) not in keep for j, x in real)
        found += got[i].n_dropped
        if got[i].text:
            assert set(wanted) <= set(got[i].text.split("\n"))
    assert found <= due and found >= 0.98 * due, (found, due)


def test_line_dedup_recall_on_table(spark, data):
    """Lines of the given table: at least 0.95 of the pairs of edit similarity 0.8 are in one group."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = sorted({x for r in docs.collect() for x in line_dedup.normal_lines((r.text or "").encode()) if x})
    singles = spark.createDataFrame([(i, x.decode()) for i, x in enumerate(texts)], "doc_id long, text string")
    pairs = list(_near_lines(texts))
    kept = {r.doc_id for r in line_dedup.dedup_lines(singles).where("n_dropped = 0").collect()}
    root = _groups(len(texts), pairs)
    due = len(texts) - len(set(root))
    assert due > 20 and len(texts) - len(kept) >= 0.95 * due, (due, len(texts) - len(kept))
    # Of a group of similar lines one stays at least.
    assert {root[i] for i in kept} == set(root)


def test_line_blocks_reach_edit_similarity():
    """Of lines with words changed, left out or put in that stay similar, nearly all meet and are near enough to be compared."""
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    made = []
    while len(made) < 2000:
        a = [rng.choice(vocab) for _ in range(rng.randrange(5, 60))]
        b = list(a)
        for _ in range(rng.randrange(1, 2 + len(a) // 6)):
            i, kind = rng.randrange(len(b)), rng.random()
            b[i : i + 1] = [rng.choice(vocab)] if kind < 0.8 else [] if kind < 0.9 else [b[i], rng.choice(vocab)]
        if len(b) > 2 and line_dedup.similar(" ".join(a), " ".join(b)):
            made += [" ".join(a).encode(), " ".join(b).encode()]
    fps, blocks = line_dedup.fingerprints(made)
    fps, blocks = fps.view(np.uint64), blocks.to_pylist()
    masks = [np.uint64(m) for m in hamming.block_masks(line_dedup.SURE)]
    keys = [{*own, *((i, f & m) for i, m in enumerate(masks))} for own, f in zip(blocks, fps)]
    met = [bool(keys[i] & keys[i + 1]) for i in range(0, len(made), 2)]
    near = [int(fps[i] ^ fps[i + 1]) for i in range(0, len(made), 2)]
    found = [m and x.bit_count() <= line_dedup.RADIUS for m, x in zip(met, near)]
    assert sum(found) >= 0.99 * len(found), (sum(met), sum(found), len(found))


def test_line_dedup_edges(spark, docs, rows, empty):
    got = line_dedup.dedup_lines(docs)
    assert got.count() == len(rows)
    by = Counter((r.doc_id, r.text) for r in got.collect())
    assert by[(0, None)] == 1 and by[(3, "one")] == 2 and by[(101, "")] == 1
    assert line_dedup.dedup_lines(empty).count() == 0


# --- op7 ---

LONG = "Long enough words, with commas, to be a paragraph of its own in this article."
PAGES = [
    ("<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One,\n two&nbsp;three.<p>Four<br>five &copy 2</article><footer>F</footer>", "T & U\nOne, two three.\nFour five © 2"),
    ("<body><div id=content><p>Text, with commas, and more of it here.</p><ul><li>one<li>two</ul></div><div class='comments'><p>Nice, really, nice, post, friend</p></div>", "Text, with commas, and more of it here.\none\ntwo"),
    ("<article><p>a<script>var x='</p>';</script>b<!-- c --> d</p><form>no</form><p hidden>no</p><div role=alert>no</div></article>", "ab d"),
    ("<article><p>cut off <b", "cut off"),
    ("<article><p>1 < 2 &lt; 3", "1 < 2 < 3"),
    ("<div class=sidebar>s</div>", ""),
    ("", ""),
    (None, ""),
    ("plain, text only", "plain, text only"),
    ("<article>" + "<div>" * 3000 + "<p>deep, text" + "</div>" * 3000, "deep, text"),
    ('<article><p title="a>b" class=x>quoted</p></article>', "quoted"),
    (f'<div class="page with-sidebar"><article><h1>T</h1><p>{LONG}</p></article><div class="sidebar">s</div></div>', f"T\n{LONG}"),
    (f'<div class="content-wrapper sidebar"><article><h1>T</h1><p>{LONG}</p></article></div>', f"T\n{LONG}"),
    (f'<article><div class="entry-header"><h1>T</h1></div><p>{LONG}</p></article>', f"T\n{LONG}"),
    (f'<article><div class="header"><h1>T</h1></div><p>{LONG}</p></article>', f"T\n{LONG}"),
    (f'<article><h1>T</h1><div id="related-work"><p>a {LONG}</p></div><p class="share-price">b {LONG}</p></article>', f"T\na {LONG}\nb {LONG}"),
    (f"<form id=f><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p><input></div></form>", f"T\n{LONG}\n{LONG}"),
    (f"<body><article><h1>T</h1><p>{LONG}</p></article><section><h2>Said</h2><article><p>{LONG * 4}</p></article></section>", f"T\n{LONG}"),
    (f"<main><article><h1>T</h1><p>{LONG}</p></article><section><article><p>{LONG * 4}</p></article></section></main>", f"T\n{LONG}"),
    (f'<div class="comments"><article><p>{LONG * 2}</p></article></div><div><h1>T</h1><p>{LONG}</p></div>', f"T\n{LONG}"),
]


def test_deep_pages():
    """Time is in proportion to the page, whatever its depth."""
    for page in ("<div>x" * 60000, "<p>" + "<span>x" * 60000 + "</b>" * 60000, "<article>" * 30000 + "x" + "<ul><li>" * 30000):
        start = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - start < 10


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert html_extract.main_text(html or "") == text


def test_pages_table(spark, data):
    import html as lib
    import re

    for r in html_extract.op7_html_extraction(spark, data).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        inner = re.sub(r"</?(?:p|h1)>", "\0", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(lib.unescape(y).split()) for y in re.sub(r"<[a-z/]*\Z", "", inner).split("\0")) if x)
        assert r.text == want and r.n_chars == len(want)


# --- op8 ---


def test_alignment():
    a = np.array([1, 2, 3, 4, 5])
    assert decontaminate.align(a, np.array([9, 1, 2, 3, 4, 5, 9])) == (10, 6)
    assert decontaminate.align(a, np.array([1, 2, 7, 4, 5]))[0] == 7
    assert decontaminate.align(a, np.array([1, 2, 4, 5]))[0] == 7
    assert decontaminate.align(a, np.array([8, 9]))[0] == 0


def test_leaks(spark, empty, docs):
    rng = random.Random(9)
    vocab = ["v%d" % i for i in range(400)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12, 60)))) for k in range(12)] + [(50, None), (51, ""), (None, "a b c d e f")]
    noise = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    made, want = [], set()
    for i in range(60):
        k = i % 12
        ws = items[k][1].split()
        if i % 3 == 1:
            for _ in range(len(ws) // 10):
                ws[rng.randrange(len(ws))] = "new"
        if i % 3 == 2:
            del ws[rng.randrange(len(ws))]
        clean = i % 5 == 0
        made.append((i, f"{noise(50)} {noise(20) if clean else ' '.join(ws).title()}. {noise(50)}"))
        if not clean:
            want.add((i, k))
    df = spark.createDataFrame(made, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()} == {i for i, _ in made} - {i for i, _ in want}
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.drop_leaks(docs, bench).count() == docs.count()


def test_leaks_of_every_benchmark_row(spark):
    """Texts that share an item_id, and those that have none, are all searched."""
    texts = [" ".join(f"{p}{i}" for i in range(20)) for p in "abcd"]
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, "one word less")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x y z {t} u v w") for i, t in enumerate(texts)] + [(9, texts[2]), (9, texts[2]), (None, f"{texts[0]} {texts[1]}"), (5, "say one, word less!"), (6, "one word more")], "doc_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.start, r.stop) for r in decontaminate.leaks(docs, bench).collect())
    assert got == Counter([(0, 1, 3, 23), (1, 1, 3, 23), (2, None, 3, 23), (3, None, 3, 23), (9, None, 0, 20), (9, None, 0, 20), (None, 1, 0, 20), (5, 2, 1, 4)])


def test_leaks_equal_all_pairs(spark, data):
    """Every document aligned with every item."""
    docs = [(r.doc_id, decontaminate.folded(r.text or "")) for r in _docs(spark, data).collect()]
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    items = [(r.item_id, decontaminate.folded(r.text or "")) for r in bench.collect()]
    want = set()
    for item, target in items:
        number = {w: i for i, w in enumerate(dict.fromkeys(target))}
        x = np.array([number[w] for w in target])
        for doc, words in docs:
            y = np.array([number.get(w, -1) for w in words])
            # Words in common bound the score.
            if 2 * sum((Counter(target) & Counter(words)).values()) >= decontaminate.LEAK_FROM * 2 * len(x) and decontaminate.align(x, y)[0] >= decontaminate.LEAK_FROM * 2 * len(x):
                want.add((doc, item))
    assert want and {(r.doc_id, r.item_id) for r in decontaminate.leaks(_docs(spark, data), bench).collect()} == want


# --- op9 ---


def _base(text):
    words, at = [], ""
    for c in text or "":
        if c in SPACE:
            words += [at] if at else []
            at = ""
        else:
            at += c
    words += [at] if at else []
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_quality_counts(spark, docs, rows, labels, empty):
    got = quality.assess(docs, labels).collect()
    want = Counter()
    for i, t in rows:
        n = _base(t)
        want[(i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.assess(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_quality_held_out(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["er", "on", "the", "st"]) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word().upper() + "!!" if i % 3 == 0 else word() for _ in range(80)) for i in range(400)]
    model = quality.fit([t.encode() for t in texts[:300]], [int(i % 3 != 0) for i in range(300)])
    found = [quality.judge(t.encode(), model)[-1] for t in texts[300:]]
    assert found == [(300 + i) % 3 != 0 for i in range(100)]


# --- op10 ---


def _place(doc_id, node):
    import math

    while node.shard is None:
        best = None
        for c in node.children:
            seed = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
            u = ((xxhash.xxh64_intdigest(c.path.encode(), seed) >> 11) + 1) / (1 << 53)
            best = min(best, (-math.log(u) / c.total, c.path, c)) if best else (-math.log(u) / c.total, c.path, c)
        node = best[2]
    return node.shard


def test_shards_of_table(spark, data):
    got = {r.doc_id: r for r in sharding.op10_sharding(spark, data).collect()}
    for r in _docs(spark, data).collect():
        g, raw = got[r.doc_id], r.text.encode()
        assert (g.size, g.text_crc32, g.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert g.shard == _place(r.doc_id, sharding.tree(16)) and g.grown_shard == _place(r.doc_id, sharding.tree(17))
        assert g.grown_shard in (g.shard, 16)


def test_shards_edges(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    got = sharding.assign(docs).collect()
    assert len(got) == len(rows)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.assign(empty).count() == 0


def test_weights_move_only_their_subtree(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    old = sharding.tree(16)
    region = old.children[0]
    rack = region.children[0]
    heavier = sharding.Node(rack.path, children=(sharding.Node(rack.children[0].path, 2.0, shard=rack.children[0].shard), *rack.children[1:]))
    new = sharding.Node("", children=(sharding.Node(region.path, children=(heavier, *region.children[1:])), *old.children[1:]))
    moved = sharding.place(sharding.place(ids, old, "doc_id", "a"), new, "doc_id", "b").where("a <> b").collect()
    assert moved and {r.b for r in moved} <= {leaf.shard for k in region.children for leaf in k.children}


# --- op1 ---


def test_licenses(spark, docs, empty):
    cases = [
        (1, "Some text.\nReleased under the MIT License.\nMore.", {"MIT"}),
        (2, "Licensed under the Apache License, Version 2.0.", {"Apache-2.0"}),
        (3, "x\nLicensed under CC BY-NC 4.0.\ny\nAll rights reserved.", {"CC-BY-NC-4.0", "Proprietary"}),
        (4, "This work is licenced under the GNU General Public License, version 3.", {"GPL-3.0"}),
        (5, "We discuss a license in general terms here.", set()),
        (6, None, set()),
        (7, "", set()),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t, _ in cases], "doc_id long, text string, license int")
    got = {i: set() for i, _, _ in cases}
    for r in license_scan.scan(df).collect():
        got[r.doc_id].add(r.license)
        assert r.n_different == 0 and r.differences == [] or r.doc_id == 4
    assert got == {i: want for i, _, want in cases}
    assert license_scan.scan(empty).count() == 0
    assert license_scan.scan(docs).count() == 0


def test_notices_of_any_rank():
    """Exact notices that other templates outrank in compression."""
    scanner = license_scan.Scanner()
    gpl = "This work is available under the GNU Free Documentation License, version 1.3. All rights reserved."
    assert {r["license"] for r in scanner.scan(gpl)} == {"Proprietary"}
    noise = " ".join("w%d" % (i * i % 7919) for i in range(5000))
    for i, (name, t) in enumerate(license_scan.TEMPLATES):
        got = scanner.scan(f"{noise} {t} {noise}")
        assert any(r["license"] == name and r["n_different"] == 0 for r in got), (i, got)


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_wrapped_notices(prefix):
    scanner = license_scan.Scanner()
    for width in range(60, 81, 4):
        for i, (name, t) in enumerate(license_scan.TEMPLATES):
            lines = textwrap.wrap(f"Copyright 2020 A. U. Thor and others. {t} And so on for the rest of it.", width)
            text = "\n".join(["import os", "", *(prefix + x for x in lines), "", "def f(): pass"])
            found = scanner.scan(text)
            assert any(r["license"] == name and r["n_different"] == 0 for r in found), (width, i, found)


def test_licenses_of_table(spark, data):
    got = Counter((r.doc_id, r.license) for r in license_scan.op1_license_scan(spark, data).where("n_different = 0").collect())
    folded = {i: [b" ".join(common.fold_words(t.lower().encode()))] for i, (_, t) in enumerate(license_scan.TEMPLATES)}
    for r in _docs(spark, data).collect():
        lines = [b" ".join(common.fold_words(x.lower().encode())) for x in r.text.split("\n")]
        for i, (name, _) in enumerate(license_scan.TEMPLATES):
            if folded[i][0] in lines:
                assert got[r.doc_id, name], (r.doc_id, name)
