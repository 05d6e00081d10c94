"""Connected components by alternating large-star and small-star rounds.

Links stay distributed; each half round is written to the shared folder, so
that lineage stays short and a hub's rows can be split by skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

MAX_ROUNDS = 50


def _star(ws: Workspace, pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): neighbours v of u; each neighbour that is larger (or, in
    the small star, any) goes to the least of u's neighbourhood."""
    least = ws.write(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    told = pairs.join(least, "u")
    if large:
        moved = told.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = told.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = ws.write(moved.where("a <> b").distinct(), "star")
    ws.drop(least)
    return out


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component; only nodes with links have a row.

    ``links``: a long, b long; self links and repeats may occur. Empty links give no rows.
    """
    edges = ws.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        wide = _star(ws, both, True)
        # After the large star every link points from the larger to the smaller node.
        near = _star(ws, wide.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        ws.drop(edges, wide)
        edges, last, mark = near, mark, _mark(near)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
