"""Fuzzy line dedup over the corpus.

Lines are normalised (ASCII lower case, words alone) and exact repeats fall
together first.  Distinct lines get a 64-bit SimHash of their distinct words, weighted by size, and
meet where they share a pigeonhole block: two of the SimHash's SURE + 2 parts (always
within SURE bits) or one of the line's own, a run of two words (one in the shortest
lines) at the same place, counted from the start in the first half and from the
end in the second, so that a word put in or left out shifts nothing beyond it.
A line takes part with its BLOCKS blocks of most bytes, which are the rarest,
but for blocks of under LONG bytes where it has ALWAYS longer ones.  Lines with
one of these blocks unchanged always meet; tests and README give the recall.
Lines that meet and differ in at most RADIUS bits are verified by edit
similarity of the normalised lines, and one occurrence stays of each connected
group: the first by (doc_id, line).  Lines with small changes in nearly every
word share no block and can be missed, as can lines written without spaces.

Inside a block group only a spanning forest of the near pairs is verified at
first, as connectivity is all that counts.  Where a forest link fails the
edit check, all near pairs of its groups that are not connected yet are
verified too, so no link between groups is lost.

Defined results: null text has no lines and stays; lines without a word never
count as repeats and stay while the document keeps any other line; a document
that loses every line with a word is left with empty text; documents that had
none keep their text; rows that repeat (doc_id, text) fully are treated as one
row and get the same result; null doc_ids come last when occurrences are
ordered; an empty table gives an empty table; other columns are carried,
whatever their names, but those named as the two counts, which the counts
replace.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Workspace, arrow_map, pieces, positional, row_key, signed, table, utf8
from .hamming import block_masks, forest_links, settle
from .marks import marked, marks, shared_keys

#: Most bits that lines of a link differ in: 997 of 1000 pairs of edit similarity 0.8 or more do.
RADIUS = 20
#: Bits within which lines share a SimHash block, whatever their words.
SURE = 2
#: Blocks of words that a line is found by.
BLOCKS = 11
#: Bytes of a block to take part, where a line has this many longer ones.
LONG, ALWAYS = 10, 3
#: A word weighs 1 in the SimHash, and 1 more from each of these sizes in bytes.
WEIGHTS = np.array([0, 4, 7, 10])
#: Bytes of text whose lines are worked on at once: the tables made of them take about ten times as much.
AT_ONCE = 4 << 20
WHITE = SPACES.decode()
SIMILARITY = 0.8
#: Lines of the similarity have a ratio of lengths in characters of at least that, but for rounding.
LENGTHS = SIMILARITY - 1e-9


def normal_lines(text: bytes) -> list[bytes]:
    """Each line's words in lower case without ASCII punctuation; the words as they are where that leaves none."""
    raw = text.split(b"\n")
    folded = [b" ".join(x.split()) for x in text.lower().translate(_FOLD).split(b"\n")]
    return [f or b" ".join(x.split()) for f, x in zip(folded, raw)]


def batch_lines(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """``normal_lines`` of all texts in a row, and the number of lines of each text."""
    if not texts:
        return [], np.zeros(0, np.int64)
    whole = b"\n".join(texts)
    n = np.array([x.count(b"\n") + 1 for x in texts])
    chars = np.frombuffer(whole.lower().translate(_FOLD) + b"\n", np.uint8)
    # Only the first space of a run stays, and none at the start or end of a line.
    gap, white = chars == 32, chars <= 32
    chars = chars[~(gap & np.concatenate([[True], white[:-1]]))]
    gap, white = chars == 32, chars == 10
    chars = chars[~(gap & np.concatenate([white[1:], [True]]))]
    out = chars.tobytes().split(b"\n")[:-1]
    if b"" in out:
        raw = whole.split(b"\n")
        out = [f or b" ".join(x.split()) for f, x in zip(out, raw)]
    return out, n


_FOLD = bytes(32 if b < 128 and b != 10 and not chr(b).isalnum() else b for b in range(256))


def fingerprints(lines: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """64-bit SimHash of the distinct words of each line (none empty) and the line's block keys, as signed 64-bit integers.

    A word counts once a line, by its size: frequent words are short, and would make unlike lines near.
    """
    if not lines:
        return np.zeros(0, np.int64), pa.array([], pa.list_(pa.int64()))
    words = pc.split_pattern(pa.array(lines, pa.binary()), b" ")
    coded, ends = words.flatten().dictionary_encode(), words.offsets.to_numpy()
    _, cuts, data = coded.dictionary.buffers()
    cuts, data = np.frombuffer(cuts, np.int32, len(coded.dictionary) + 1, 4 * coded.dictionary.offset), data.to_pybytes()
    known = [data[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    hashes, sizes = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known)), np.diff(cuts)
    weights = np.searchsorted(WEIGHTS, sizes, side="right")
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)] * weights.astype(np.uint64)[:, None]
    every = coded.indices.to_numpy(zero_copy_only=False)
    out, keys, step = [], [], 4096
    for i in range(0, len(lines), step):
        n = np.diff(ends[i : i + step + 1])
        codes = every[ends[i] : ends[min(i + step, len(lines))]]
        keys.append(word_blocks(hashes[codes], sizes[codes], n))
        own = np.sort(np.repeat(np.arange(len(n)), n) * len(known) + codes)
        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        line = own // len(known)
        own -= line * len(known)
        n = np.bincount(line, minlength=len(n))
        first = np.cumsum(n) - n
        half = np.add.reduceat(weights[own], first)[:, None] >> 1
        # Eight bits' sums fit the bytes of one number, in parts of a line that weigh less than 256.
        parts = -(-n // PART)
        start = np.cumsum(parts) - parts
        at = np.repeat(first - PART * start, parts) + PART * np.arange(parts.sum())
        ones = np.add.reduceat(np.take(lanes, own, axis=0), at, axis=0).view(np.uint8)
        bits = ones[start] > half
        if len(long := np.flatnonzero(parts > 1)):
            heads = np.cumsum(parts[long]) - parts[long]
            bits[long] = np.add.reduceat(ones[np.repeat(parts > 1, parts)], heads, axis=0, dtype=np.int64) > half[long]
        out.append(np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel())
    return np.concatenate(out), pa.chunked_array(keys, pa.list_(pa.int64())).combine_chunks()


def simhashes(lines: list[bytes]) -> np.ndarray:
    return fingerprints(lines)[0]


#: Words that are summed at once: they weigh less than 256.
PART = 255 // len(WEIGHTS)
#: Each byte's bits spread to the eight bytes of a number.
_LANES = np.array([sum((v >> b & 1) << 8 * b for b in range(8)) for v in range(256)], dtype="<u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def word_blocks(hashes: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> pa.Array:
    """Each line's keys: hashes of its blocks of words with their places.

    Word hashes and sizes of all lines in a row, and the number of words of each line.
    """
    first, found = np.cumsum(n) - n, []
    for size, lines in ((1, np.flatnonzero(n <= 4)), (2, np.flatnonzero(n >= 4))):
        blocks = n[lines] // size
        line = np.repeat(lines, blocks)
        at = np.arange(len(line)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        half = (n[line] // size + 1) // 2
        place = np.where(at < half, at, half - 1 - at)  # from the end: -1, -2, ...
        start = first[line] + np.where(place >= 0, size * place, n[line] + size * place)
        block, length = np.zeros(len(line), np.uint64), np.zeros(len(line), np.int64)
        for j in range(size):
            block = _mix(block + hashes[start + j])
            length += sizes[start + j]
        found.append((line, length, block, place, at))
    line, length, block, place, nth = (np.concatenate(x) for x in zip(*found))
    # The longest first, by hash among equals; of a block that occurs twice in a line, by place.
    rank = line.astype(np.uint64) << np.uint64(48) | np.uint64(255) - np.minimum(length, 255).astype(np.uint64) << np.uint64(40)
    order = np.argsort(rank | block >> np.uint64(32) << np.uint64(8) | np.minimum(nth, 255).astype(np.uint64))
    line, block, place, length = line[order], block[order], place[order], length[order]
    every = np.bincount(line, minlength=len(n))
    at = np.arange(len(line)) - np.repeat(np.cumsum(every) - every, every)
    best = (at < BLOCKS) & ((at < ALWAYS) | (length >= LONG))
    keys = _mix(block[best] + place[best].astype(np.uint64)).view(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(line[best], minlength=len(n)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))


def pair_masks(k: int) -> list[int]:
    """Masks of two of k + 2 blocks: within k differing bits at least two blocks are equal."""
    blocks = block_masks(k + 1)
    return [x | y for i, x in enumerate(blocks) for y in blocks[:i]]


MASKS = pair_masks(SURE)


def simhash_blocks():
    """The fingerprint's block hashes, as a column."""
    return F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(x)))) for i, x in enumerate(MASKS)])


def _ranks(doc_id: pa.Array, row: pa.Array) -> np.ndarray:
    """The place of each text in the order of occurrences, null doc_ids last."""
    table = pa.table([doc_id.is_null(), doc_id, *(row.flatten() if pa.types.is_struct(row.type) else [row])], names=[str(i) for i in range(2 + max(1, row.type.num_fields))])
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names]).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _lines(batches):
    """doc_id, row, text -> doc_id, row, line number, hash, SimHash, length in characters and block keys of each distinct line with a word, where it is first."""
    digest = xxhash.xxh64_intdigest
    for b in (p for whole in batches for p in pieces(whole, 2, AT_ONCE)):
        norms, n = batch_lines(utf8(b.column(2)))
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(x, len(known)) for x in norms), np.int64, len(norms))
        own = list(known)
        # Each line's occurrence of least rank; lines without a word go.
        ranks = _ranks(b.column(0), b.column(1))
        place = np.repeat(ranks, n) << 32 | np.arange(len(norms)) - np.repeat(np.cumsum(n) - n, n)
        best = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(best, which, place)
        if (blank := known.get(b"")) is not None:
            best = np.delete(best, blank)
            del own[blank]
        at = pa.array(np.argsort(ranks)[best >> 32])
        hs = np.fromiter((digest(x, 7) for x in own), dtype=np.uint64, count=len(own)).view(np.int64)
        fps, keys = fingerprints(own)
        size = pa.array([len(x) if x.isascii() else len(x.decode("utf-8", "replace")) for x in own], pa.int32())
        cols = [b.column(0).take(at), b.column(1).take(at), pa.array((best & 0xFFFFFFFF).astype(np.int32)), pa.array(hs), pa.array(fps), size, keys]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "line", "id", "fp", "size", "keys"])


def _pick(batches, told):
    """text -> id, norm of the lines whose id is marked, each once a batch."""
    digest = xxhash.xxh64_intdigest
    for b in (p for whole in batches for p in pieces(whole, 0, AT_ONCE)):
        own = list({*batch_lines(utf8(b.column(0)))[0]} - {b""})
        ids = np.fromiter((digest(x, 7) for x in own), dtype=np.uint64, count=len(own)).view(np.int64)
        at = np.flatnonzero(marked(ids, told.value))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([own[i] for i in at.tolist()], pa.binary()).cast(pa.string())], ["id", "norm"])


def _texts(ws: Workspace, keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """id, norm of the given ids, and of a few others that their map takes in."""
    told = marks(ws, ids, ids.count(), 16)
    # Reading the texts again spares a shuffle of them: just the lines asked for are dealt out.
    return ws.write(arrow_map(keyed.select("text"), partial(_pick, told=told), "id long, norm string").dropDuplicates(["id"]), "norms")


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns (Myers; Hyyro's form), after equal ends are cut."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for k, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << k
    full, top, dist = (1 << len(b)) - 1, 1 << (len(b) - 1), len(b)
    up, down = full, 0  # rows where the column rises, falls
    for c in a:
        eq = where.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(across | up)), up & across
        if rise & top:
            dist += 1
        elif fall & top:
            dist -= 1
        rise, fall, along = (rise << 1 | 1) & full, fall << 1 & full, eq | down
        up, down = fall | (full & ~(along | rise)), rise & along
    return dist


def edits_by_word(x: list[str], y: list[str], room: float) -> float:
    """Characters that one alignment of the words changes: a bound of the edit distance from above.

    Where words differ, the nearest place within REACH words at which two equal
    words follow is taken for the next match.
    """
    cost = i = j = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _STEPS:
            u, v = i + p, j + q
            if u < n and v < m and x[u] == y[v] and (u + 1 == n or v + 1 == m or x[u + 1] == y[v + 1]):
                break
        else:
            p = q = 1
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q) - (p > 0 and q > 0)
        if cost > room:
            return cost
        i, j = i + p, j + q
    return cost + sum(map(len, x[i:])) + n - i + sum(map(len, y[j:])) + m - j


REACH = 4
#: Words of either line to skip, the fewest first.
_STEPS = sorted(((p, q) for p in range(REACH + 1) for q in range(REACH + 1) if p + q), key=lambda s: (max(s), abs(s[0] - s[1])))


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether the edit distance is at most (1 - similarity) of the longer line.

    The difference of lengths bounds the distance from below, an alignment of
    the words from above; where either decides, the distance isn't needed.
    """
    room = (1 - similarity) * max(len(a), len(b)) + 1e-9
    if abs(len(a) - len(b)) > room:
        return False
    return edits_by_word(a.split(" "), b.split(" "), room) <= room or edit_distance(a, b) <= room


def _pair_counts(texts: list[str]) -> np.ndarray:
    """How often each text holds pairs of neighbouring characters, by a hash of 8 bits."""
    sizes = np.array([len(t) for t in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[:-1] == owner[1:]
    code = (chars[:-1] * 37 + chars[1:])[inside] & 255
    return np.bincount((owner[:-1][inside] << 8) + code, minlength=len(texts) << 8).reshape(-1, 256)


def far_apart(x: list[str], y: list[str], similarity: float = SIMILARITY) -> np.ndarray:
    """Pairs whose edit distance is above the bound for certain: an edit takes away two pairs of neighbours at most."""
    if not x:
        return np.zeros(0, bool)
    more = _pair_counts(x) - _pair_counts(y)
    gone = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
    room = (1 - similarity) * np.maximum([len(t) for t in x], [len(t) for t in y]) + 1e-9
    return gone > 2 * room


def _codes(texts: list[str]) -> tuple[np.ndarray, int]:
    """The characters of all texts in a row, numbered from 1 as they occur in them, and the number of different ones."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if chars.max(initial=0) < 1024:
        number = np.cumsum(np.bincount(chars, minlength=1) > 0)
        return number[chars], int(number[-1])
    known, codes = np.unique(chars, return_inverse=True)
    return codes + 1, len(known)


def distances(x: list[str], y: list[str]) -> np.ndarray:
    """Levenshtein distance of each pair, by the bit-parallel columns of ``edit_distance`` for all pairs at once: each pair has
    its bits of one long number.  Pairs get equal ends put on, so that all end at the same column."""
    a, b = [list(t) for t in zip(*((p, q) if len(p) >= len(q) else (q, p) for p, q in zip(x, y)))]
    n, m, pairs = np.array([len(t) for t in a]), np.array([len(t) for t in b]), np.arange(len(a))
    rows = int(n.max())
    deep = m + rows - n
    width = (int(deep.max()) + 8) // 8 * 8  # one bit more at least, for the carry
    codes, kinds = _codes(a + b)
    if 1 < len(a) and len(a) * max((kinds + 1) * width, rows * width // 8) > LANES_MOST:
        half = len(a) // 2
        return np.concatenate([distances(a[:half], b[:half]), distances(a[half:], b[half:])])
    col = np.zeros((rows, len(a)), np.intp)  # 0 is the end put on
    owner, start = np.repeat(pairs, n), np.cumsum(n) - n
    col[np.arange(len(owner)) - start[owner], owner] = codes[: len(owner)]
    where = np.zeros((len(a), kinds + 1, width), bool)
    where[:, 0] = (np.arange(width) >= m[:, None]) & (np.arange(width) < deep[:, None])
    own, start = np.repeat(pairs, m), np.cumsum(m) - m
    where[own, codes[len(owner) :], np.arange(len(own)) - start[own]] = True
    where = np.packbits(where, axis=2, bitorder="little").reshape(-1, width // 8)
    number = lambda bits: int.from_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes(), "little")
    full = number(np.arange(width) < deep[:, None])
    ones = number((np.arange(width) == 0) & (deep > 0)[:, None])
    up, down = full, 0
    size = len(a) * width // 8
    every = np.take(where, pairs * (kinds + 1) + col, axis=0).tobytes()
    for i in range(0, rows * size, size):
        eq = int.from_bytes(every[i : i + size], "little")
        across = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full ^ (full & (across | up))), up & across
        rise, fall, along = (rise << 1 | ones) & full, fall << 1 & full, eq | down
        up, down = fall | (full ^ (full & (along | rise))), rise & along
    count = lambda v: np.bitwise_count(np.frombuffer(v.to_bytes(size, "little"), np.uint8)).reshape(len(a), -1).sum(axis=1, dtype=np.int64)
    return rows + count(up) - count(down)


def within(x: list[str], y: list[str], room: np.ndarray) -> np.ndarray:
    """Pairs whose edit distance is at most ``room``."""
    return distances(x, y) <= room


#: Most and fewest pairs that are compared side by side, and characters up to which lines are: of fewer or longer ones each pair alone is faster. Most bytes of their tables.
SIDE, SIDE_LEAST, SIDE_CHARS, LANES_MOST = 64, 4, 2000, 16 << 20


def all_similar(x: list[str], y: list[str], similarity: float = SIMILARITY) -> list[bool]:
    """``similar`` of each pair."""
    size = np.array([max(len(a), len(b)) for a, b in zip(x, y)], np.int64)
    room = (1 - similarity) * size + 1e-9
    ok, left = np.zeros(len(x), bool), []
    for i in range(0, len(x), 1024):
        far = far_apart(x[i : i + 1024], y[i : i + 1024], similarity).tolist()
        for j, (f, a, b) in enumerate(zip(far, x[i : i + 1024], y[i : i + 1024]), i):
            if f or abs(len(a) - len(b)) > room[j]:
                continue
            if edits_by_word(a.split(" "), b.split(" "), room[j]) <= room[j]:
                ok[j] = True
            elif size[j] > SIDE_CHARS:
                ok[j] = edit_distance(a, b) <= room[j]
            else:
                left.append(j)
    # Lines of like size side by side.
    left = np.array(left, np.int64)
    left = left[np.argsort(size[left], kind="stable")]
    for i in range(0, len(left), SIDE):
        some = left[i : i + SIDE]
        if len(some) < SIDE_LEAST:
            ok[some] = [edit_distance(x[j], y[j]) <= room[j] for j in some.tolist()]
            continue
        ok[some] = within([x[j] for j in some.tolist()], [y[j] for j in some.tolist()], room[some].astype(np.int64))
    return ok.tolist()


def keepers(keyed: DataFrame) -> DataFrame:
    """(row, keep): the numbers of the lines to keep, for rows that keep any. ``keyed``: doc_id, row, text."""
    ws = Workspace(keyed.sparkSession, "lines")
    found = arrow_map(keyed, _lines, f"doc_id long, row {keyed.schema['row'].dataType.simpleString()}, line int, id long, fp long, size int, keys array<long>")
    first = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row", "line")
    # Lines of one hash but different fingerprints are different lines.
    # Repeats within a batch are gone: dealt out first, rows are sorted once.
    lines = ws.write(found.repartition("id").groupBy("id", "fp").agg(F.min(first).alias("best"), F.first("size").alias("size"), F.first("keys").alias("keys")), "distinct")
    nodes = lines.select("id", "fp", "size", F.concat("keys", simhash_blocks()).alias("keys"))
    # Most blocks are of one line: only those of two are dealt out.
    nodes = shared_keys(ws, nodes, (BLOCKS + len(MASKS)) * lines.count())
    links = ws.write(forest_links(ws, nodes, None, RADIUS, LENGTHS), "links")
    ids = ws.write(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    norms = _texts(ws, keyed, ids)
    # Lines of a group that are near any other have a link of its forest, so all texts to be compared are at hand.
    roots = settle(ws, links, nodes, RADIUS, LENGTHS, norms.toDF("id", "body"), all_similar)
    ws.drop(norms, links, nodes, ids)
    grouped = lines.join(roots, lines.id == roots.node, "left").select("best", "root")
    alone = grouped.where("root is null").select("best")
    tops = grouped.where("root is not null").groupBy("root").agg(F.min("best").alias("best")).select("best")
    kept = ws.write(alone.unionByName(tops).groupBy("best.row").agg(F.collect_list("best.line").alias("keep")), "kept")
    ws.drop(lines, roots)
    return kept


def _rebuild(batches, at: int):
    """..., keep -> ... with the text (column ``at``) rebuilt, n_lines, n_dropped."""
    for b in batches:
        out, total, gone = [], [], []
        for text, keep in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            lines, keep = text.split("\n") if text else [], keep or ()
            real = [bool(x.strip(WHITE)) for x in lines]  # just those that normal_lines leaves words
            dropped = sum(real) - len(keep)  # only such lines are kept
            if dropped:
                keep = set(keep)
                text = "\n".join([x for i, x in enumerate(lines) if i in keep or not real[i]]) if keep else ""
            out.append(text)
            total.append(len(lines))
            gone.append(dropped)
        cols = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*b.schema.names[:-1], "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with repeated lines gone from text, and two columns of counts: its lines and those dropped."""
    from pyspark.sql.types import LongType, StructType

    docs = docs.drop(lines, dropped)
    doc_id, at = docs.columns.index("doc_id"), docs.columns.index("text")
    base = positional(docs)
    key = row_key(f"c{doc_id}", f"c{at}")
    kept = keepers(base.select(F.col(f"c{doc_id}").cast("long").alias("doc_id"), key.alias("row"), F.col(f"c{at}").alias("text")))
    joined = base.withColumn("row", key).join(kept.hint("shuffle_hash"), "row", "left").select(*base.columns, "keep")
    fields = StructType(base.schema.fields).add("n_lines", LongType()).add("n_dropped", LongType())
    return arrow_map(joined, partial(_rebuild, at=at), fields).toDF(*docs.columns, lines, dropped)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")
