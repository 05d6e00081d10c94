"""Sketch joins: block-hash self-join, prefix probes, pair-block tables, linear scan."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfold.config import GRAPH_DISTANCE, MAX_HASH, SEARCH_DISTANCE
from nearfold.functions import bits
from nearfold.functions.bits import WORDS, hamming


def block_rows(sk: DataFrame) -> DataFrame:
    """One row for each sketch and block key k."""
    return sk.select("id", *WORDS, F.explode(F.array(*bits.sketch_split())).alias("k"))


def cap_buckets(rows: DataFrame, cap: int | None = MAX_HASH) -> DataFrame:
    """Rows of blocks of at most ``cap`` rows; larger blocks give no pairs.

    The sizes are counted with partial aggregation and only the keys above
    the cap, which are few, take part in the anti join.
    """
    if cap is None:
        return rows
    large = rows.groupBy("k").count().where(F.col("count") > cap).select("k")
    return rows.join(large, "k", "left_anti")


def classes(sk: DataFrame, distance: int = GRAPH_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(class, id): sketches by their least equal; (src, dst): classes with src < dst and fewer than ``distance`` differing bits."""
    least = sk.groupBy(*WORDS).agg(F.min("id").alias("class"))
    members = sk.join(least, [*WORDS]).select("class", "id")
    return members, _near_rows(block_rows(least.withColumnRenamed("class", "id")), distance)


def block_pairs(sk: DataFrame, distance: int = GRAPH_DISTANCE, cap: int | None = None) -> DataFrame:
    """(src, dst) with src < dst and fewer than ``distance`` differing bits; exact for distances up to 3.

    Equal sketches are one class: classes are joined by blocks, then their
    members paired.  A ``cap`` leaves out larger blocks, as the reference does.
    """
    if cap is None:
        members, near = classes(sk, distance)
        a, b = members.toDF("src", "a"), members.toDF("dst", "b")
        apart = near.join(a, "src").join(b, "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        same = members.toDF("class", "src").join(members.toDF("class", "dst"), "class").where((F.col("src") < F.col("dst")) & F.lit(distance > 0))
        return apart.unionByName(same.select("src", "dst"))
    return _near_rows(cap_buckets(block_rows(sk), cap), distance)


def _near_rows(rows: DataFrame, distance: int) -> DataFrame:
    a, b = rows.alias("a"), rows.alias("b")
    near = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id"))).where(hamming() < distance)
    return near.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()


def symmetrize(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def edges(sk: DataFrame, distance: int = GRAPH_DISTANCE, cap: int | None = None) -> DataFrame:
    return symmetrize(block_pairs(sk, distance, cap))


def probe(q: DataFrame, sk: DataFrame, keys: list[tuple[Column, Column] | list[str]], distance: int = SEARCH_DISTANCE) -> DataFrame:
    """(qid, id, d): sketches that agree with a query on any of the key lists, verified by distance.

    One explode on each side and one join, whatever the number of keys.
    """
    def side(df: DataFrame, id_: str) -> DataFrame:
        tagged = [F.struct(F.lit(i).alias("t"), F.xxhash64(*[F.col(c) for c in k]).alias("h")) for i, k in enumerate(keys)]
        return df.select(id_, *sorted({*WORDS, *(c for k in keys for c in k)}), F.explode(F.array(*tagged)).alias("key"))

    a, b = side(q, "qid").alias("a"), side(sk, "id").alias("b")
    hits = a.join(b, F.col("a.key") == F.col("b.key")).withColumn("d", hamming()).where(F.col("d") < distance)
    return hits.select("qid", "id", "d").distinct()


def _blocks(df: DataFrame, id_: str) -> DataFrame:
    """Sketches in blocks of BLOCK at most: a row of an array of ids and one of each word."""

    def pack(batches):
        for b in batches:
            ends = pa.array([*range(0, b.num_rows, BLOCK), b.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in b.columns], b.schema.names)

    kinds = dict(df.dtypes)
    return df.select(id_, *WORDS).mapInArrow(pack, ", ".join(f"{c} array<{kinds[c]}>" for c in [id_, *WORDS]))


#: Sketches of a block, and queries that meet one at once: the tile fits a core's cache.
BLOCK, TILE = 4096, 32


def linear(q: DataFrame, sk: DataFrame, distance: int = SEARCH_DISTANCE) -> DataFrame:
    """The full scan that the other plans are measured against; queries are a small stated set.

    Every query meets every sketch, block by block: the first halves of the sketches tell most pairs apart.
    """
    parts = int(sk.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = lambda df: df.where(reduce(Column.__and__, [F.col(w).isNotNull() for w in WORDS]))
    # Dealt out by number, as the sketches are few bytes but each meets every query.
    blocks = _blocks(whole(sk).repartition(parts, "id"), "id").toDF("id", *[f"b_{w}" for w in WORDS])
    pairs = blocks.crossJoin(F.broadcast(_blocks(whole(q), "qid").toDF("qid", *[f"a_{w}" for w in WORDS])))

    def halves(b, row, first):
        """Each sketch as two numbers of 64 bits."""
        w = [c.slice(row, 1).flatten().to_numpy(zero_copy_only=False).astype(np.uint64) for c in b.columns[first : first + 4]]
        return [low & np.uint64(0xFFFFFFFF) | high << np.uint64(32) for low, high in (w[:2], w[2:])]

    def scan(batches):
        for b in batches:
            for row in range(b.num_rows):
                ids, qids = (b.column(i).slice(row, 1).flatten() for i in (0, 5))
                (y0, y1), (x0, x1) = halves(b, row, 1), halves(b, row, 6)
                for i in range(0, len(x0), TILE):
                    at, to = np.nonzero(np.bitwise_count(x0[i : i + TILE, None] ^ y0) < distance)
                    at += i
                    d = np.bitwise_count(x0[at] ^ y0[to]).astype(np.int64) + np.bitwise_count(x1[at] ^ y1[to])
                    ok = d < distance
                    if ok.any():
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(at[ok])), ids.take(pa.array(to[ok])), pa.array(d[ok])], ["qid", "id", "d"])

    return pairs.mapInArrow(scan, f"qid {dict(q.dtypes)['qid']}, id {dict(sk.dtypes)['id']}, d long")


WORD_KEYS = [[w] for w in WORDS]
PAIR_KEYS = [[a, b] for i, a in enumerate(WORDS) for b in WORDS[i + 1 :]]


def equal_plan_keys(sk: DataFrame, blocks: int) -> tuple[DataFrame, list[list[str]]]:
    """Equal blocks over the 128 bits, the first 128 % blocks one bit larger."""
    hexed = sk.withColumn("sk", bits.sketch_hex())
    at, keys = 0, []
    for k in range(blocks):
        size = 128 // blocks + (k < 128 % blocks)
        parts = []
        for j, start in enumerate(range(at, at + size, 32)):
            hexed = hexed.withColumn(f"e{k}_{j}", bits.bit_window(F.col("sk"), start, min(32, at + size - start)))
            parts.append(f"e{k}_{j}")
        keys.append(parts)
        at += size
    return hexed, keys


def two_level(df: DataFrame) -> tuple[DataFrame, list[list[str]]]:
    """Second scheme: a word, and one of four 24-bit parts of the others."""
    keys = []
    for k, w in enumerate(WORDS):
        for j, c in enumerate(bits.second_level(k)):
            df = df.withColumn(f"m{k}_{j}", c)
            keys.append([w, f"m{k}_{j}"])
    return df, keys


def smart_choice(q: DataFrame, sk: DataFrame) -> DataFrame:
    """(qid, omit, cost): the boundary between words to leave out, by least number of candidate rows.

    Leaving out boundary r makes one block of words r and r + 1 and keeps the other two words as blocks.
    """
    singles = [sk.groupBy(w).agg(F.count("*").alias(f"n{i}")) for i, w in enumerate(WORDS)]
    out = q
    for i, (w, counts) in enumerate(zip(WORDS, singles)):
        out = out.join(counts, w, "left").withColumn(f"n{i}", F.coalesce(f"n{i}", F.lit(0)))
    for r in range(4):
        pair = [WORDS[r], WORDS[(r + 1) % 4]]
        out = out.join(sk.groupBy(*pair).agg(F.count("*").alias(f"p{r}")), pair, "left").withColumn(f"p{r}", F.coalesce(f"p{r}", F.lit(0)))
    costs = [F.struct((F.col(f"p{r}") + sum(F.col(f"n{i}") for i in range(4) if i not in (r, (r + 1) % 4))).alias("cost"), F.lit(r).alias("omit")) for r in range(4)]
    return out.withColumn("best", F.least(*costs)).select("qid", *WORDS, "best.omit", "best.cost")


def smart(q: DataFrame, sk: DataFrame, distance: int = SEARCH_DISTANCE) -> DataFrame:
    chosen = smart_choice(q, sk).select("qid", *WORDS, "omit")
    parts = []
    for r in range(4):
        pair = [WORDS[r], WORDS[(r + 1) % 4]]
        keys = [pair, *[[w] for w in WORDS if w not in pair]]
        parts.append(probe(chosen.where(F.col("omit") == r), sk, keys, distance))
    return reduce(DataFrame.unionByName, parts)


def first_hits(hits: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` hits for each query, the least ids first."""
    w = Window.partitionBy("qid").orderBy("id")
    return hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")
