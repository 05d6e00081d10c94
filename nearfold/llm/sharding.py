"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard levels.  At each node every child
draws -ln(u)/weight, u being a hash of the document's key and the child's
path; the least draw wins, so each child gets rows in proportion to its
weight.  A change of weights moves rows only into children whose weight grew
or out of children whose weight shrank; all below other children stay.
Growth adds a region of its own, hence the one new shard takes rows only into
itself.

Defined results: null text has size 1 and the crc32 of no bytes; rows with
null doc_id all go to one shard; rows that repeat a doc_id share a shard and
get slots of their own; an empty table gives an empty table; the columns
shard, slot and so on of the output never clash with input columns, which are
not carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one task numbers at most, on average.
SLOT_ROWS = 200_000


@dataclass(frozen=True)
class Node:
    """A subtree: its path (stable name), weight, and children or shard number."""

    path: str
    weight: float = 0.0
    children: tuple["Node", ...] = field(default=())
    shard: int | None = None

    @property
    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total for c in self.children)


def tree(shards: int, base: int = 16, regions: int = 2, racks: int = 2) -> Node:
    """Topology of ``shards`` equal shards: the first ``base`` in regions and
    racks, each further one in a region of its own."""
    first, number, tops = min(shards, base), 0, []
    for r in range(min(regions, first)):
        in_region = first * (r + 1) // min(regions, first) - first * r // min(regions, first)
        n, kids = min(racks, in_region), []
        for k in range(n):
            size = in_region * (k + 1) // n - in_region * k // n
            kids.append(Node(f"{r}.{k}", children=tuple(Node(f"{r}.{k}.{i}", 1.0, shard=number + i) for i in range(size))))
            number += size
        tops.append(Node(f"{r}", children=tuple(kids)))
    for s in range(first, shards):
        rack = Node(f"g{s}.0", children=(Node(f"g{s}.0.0", 1.0, shard=s),))
        tops.append(Node(f"g{s}", children=(rack,)))
    return Node("", children=tuple(tops))


def draw(key: Column, child: Node) -> Column:
    """-ln(u)/weight with u in (0, 1] from 53 bits of a hash of key and path."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.path)), 11) + 1) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(child.total)


def place(docs: DataFrame, root: Node, key: str, out: str) -> DataFrame:
    """Adds the shard of each row; one level of the tree for each added expression."""
    at, level, df = f"__{out}_at", [root], docs.withColumn(f"__{out}_at", F.lit(0))
    leaves = {}
    while any(n.shard is None for n in level):
        below, picks = [], []
        for i, node in enumerate(level):
            kids = [c for c in (node.children if node.shard is None else (node,)) if c.total > 0]
            base = len(below)
            below += kids
            best = F.lit(base) if len(kids) == 1 else F.array_min(F.array(*[F.struct(draw(F.col(key), c).alias("d"), F.lit(base + j).alias("i")) for j, c in enumerate(kids)]))["i"]
            picks.append((i, best))
        step = picks[-1][1] if len(picks) == 1 else reduce(lambda rest, p: F.when(F.col(at) == p[0], p[1]).otherwise(rest), reversed(picks[:-1]), picks[-1][1])
        df, level = df.withColumn(at, step), below
    leaves = [n.shard for n in level]
    return df.withColumn(out, F.element_at(F.array(*[F.lit(s) for s in leaves]), F.col(at) + 1)).drop(at)


def number_slots(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard, without gaps.

    Each shard is numbered in chunks by a hash of doc_id; a chunk starts where
    the counts of the chunks before it end.
    """
    chunks = max(1, -(-rows // SLOT_ROWS))
    df = df.withColumn("__chunk", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(chunks)))
    counts = df.groupBy("shard", "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__chunk").orderBy(*order)
    df = df.withColumn("__at", F.row_number().over(inside)).join(counts, ["shard", "__chunk"])
    return df.withColumn("slot", F.col("__start") + F.col("__at") - 1).drop("__chunk", "__start", "__at")


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    base = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = place(place(base, tree(shards), "doc_id", "shard"), tree(shards + 1), "doc_id", "grown_shard")
    return number_slots(placed, ["doc_id", "text_crc32", "size"], docs.count()).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return assign(table(spark, sf_dir, "documents"))
