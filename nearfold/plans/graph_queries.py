"""Graph queries over the near-duplicate graph of document sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfold import bindings as b
from nearfold.operators import graph, links
from nearfold.registry import query

DEG = "deg AS (SELECT src AS id, count(DISTINCT dst)::BIGINT AS degree FROM edge GROUP BY src)"


def _edges(spark, sf):
    return graph.stored(links.edges(graph.stored(b.sketches(spark, sf))))


def _classes(spark, sf):
    """edge and copies, as in ``graph.components``: the graph of ``_edges``, without the links of equal sketches one by one."""
    members, near = links.classes(graph.stored(b.sketches(spark, sf)))
    return {"edge": links.symmetrize(graph.stored(near)), "copies": members}


@query(f"WITH {b.EDGES} SELECT src, dst FROM edge WHERE src < dst")
def join_block_hash_self(spark, sf):
    return links.block_pairs(b.sketches(spark, sf))


@query(f"WITH {b.EDGES} SELECT src AS id, list_sort(list(DISTINCT dst)) AS nbrs FROM edge GROUP BY src")
def gr_build(spark, sf):
    return graph.adjacency(_edges(spark, sf))


@query(f"WITH {b.EDGES} SELECT src AS id, array_to_string(list_sort(list(DISTINCT dst)), ',') AS nbrs FROM edge GROUP BY src")
def agg_adjacency(spark, sf):
    return graph.adjacency(_edges(spark, sf)).select("id", F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs"))


@query(f"WITH {b.EDGES} SELECT src, dst FROM edge")
def set_symmetrize(spark, sf):
    return links.symmetrize(links.block_pairs(b.sketches(spark, sf)))


@query(f"WITH {b.EDGES} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edge")
def set_distinct(spark, sf):
    return _edges(spark, sf).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


@query(f"WITH {b.EDGES}, {DEG} SELECT id, degree, (SELECT count(*) FROM deg)::BIGINT AS n_vertices FROM deg")
def agg_graph_degree(spark, sf):
    deg = graph.degrees(_edges(spark, sf))
    return deg.crossJoin(deg.agg(F.count("*").alias("n_vertices")))


@query(f"WITH {b.EDGES}, {DEG} SELECT src, dst FROM edge WHERE src NOT IN (SELECT id FROM deg WHERE degree > 5) AND dst NOT IN (SELECT id FROM deg WHERE degree > 5)", "gr_prune")
def gr_prune(spark, sf):
    return graph.prune(_edges(spark, sf), 5)


@query(f"WITH {b.EDGES}, {DEG} SELECT id, degree FROM deg WHERE degree <= 5")
def flt_degree(spark, sf):
    return graph.degrees(_edges(spark, sf)).where("degree <= 5")


@query(f"WITH {b.EDGES} SELECT src, dst FROM edge e WHERE src % 7 <> 0 AND dst % 7 <> 0")
def set_remove_vertices(spark, sf):
    edge = _edges(spark, sf)
    return graph.remove(edge, edge.where("src % 7 = 0").select(F.col("src").alias("id")).distinct())


@query(f"WITH {b.EDGES} SELECT count(*)::BIGINT AS n_asymmetric FROM edge e WHERE NOT EXISTS (SELECT 1 FROM edge r WHERE r.src = e.dst AND r.dst = e.src)")
def gr_verify(spark, sf):
    return graph.asymmetric(_edges(spark, sf)).agg(F.count("*").alias("n_asymmetric"))


@query(f"WITH {b.EDGES} SELECT src * 2 + 1 AS src, dst * 2 + 1 AS dst FROM edge")
def gr_remap(spark, sf):
    mapping = b.read(spark, sf, "documents").select(F.col("doc_id").alias("old_id"), (F.col("doc_id") * 2 + 1).alias("new_id"))
    return graph.remap(_edges(spark, sf), mapping)


@query(f"WITH {b.EDGES} SELECT (src + 100000) AS src, (dst + 100000) AS dst FROM edge")
def join_graph_remap(spark, sf):
    mapping = b.read(spark, sf, "documents").select(F.col("doc_id").alias("old_id"), (F.col("doc_id") + 100000).alias("new_id"))
    return graph.remap(_edges(spark, sf), mapping)


@query(f"WITH {b.EDGES} SELECT doc_id AS id, array_to_string(list_concat([doc_id], coalesce((SELECT list_sort(list(DISTINCT dst)) FROM edge WHERE src = doc_id), [])), ',') AS nbrs FROM documents WHERE doc_id % 3 = 0")
def gr_neighbors(spark, sf):
    ids = b.read(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    return graph.neighbors(_edges(spark, sf), ids).select("id", F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs"))


@query(f"WITH {b.EDGES} SELECT doc_id AS id, coalesce((SELECT count(DISTINCT dst) FROM edge WHERE src = doc_id), 0)::BIGINT AS n FROM documents")
def join_neighbors(spark, sf):
    ids = b.read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return graph.neighbors(_edges(spark, sf), ids).select("id", (F.size("nbrs") - 1).cast("long").alias("n"))


@query(f"""WITH {b.EDGES}, {DEG}, ord AS (SELECT src % 4 AS qid, id, degree, row_number() OVER (PARTITION BY id % 4 ORDER BY degree DESC, id) AS pos FROM deg JOIN (SELECT DISTINCT src FROM edge) ON src = id),
d AS (SELECT a.qid, a.id, a.pos, a.degree, sum(CASE WHEN x.pos < a.pos THEN -1 ELSE 1 END) AS delta FROM ord a JOIN edge e ON e.src = a.id LEFT JOIN ord x ON x.qid = a.qid AND x.id = e.dst GROUP BY ALL)
SELECT qid, id, pos, (sum(delta) OVER w)::BIGINT AS cut, (sum(degree) OVER w)::BIGINT AS volume FROM d WINDOW w AS (PARTITION BY qid ORDER BY pos)""")
def agg_conductance(spark, sf):
    edge = _edges(spark, sf)
    rank = graph.degrees(edge).select((F.col("id") % 4).alias("qid"), "id", (F.col("degree") * F.col("degree")).cast("double").alias("p"))
    return graph.sweep(rank, edge).select("qid", "id", F.col("pos").cast("long"), "cut", "volume")


def _seeds(spark, sf):
    return b.read(spark, sf, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("id"))


@query()
def gr_rank(spark, sf):
    return graph.expand(_seeds(spark, sf), **_classes(spark, sf)).select("qid", "id", F.round("p", 6).alias("p"))


@query()
def gr_nibble(spark, sf):
    return graph.nibble(_seeds(spark, sf), **_classes(spark, sf))


@query("SELECT qid, count(*)::BIGINT AS n FROM (SELECT doc_id % 3 AS qid FROM documents) GROUP BY qid HAVING count(*) BETWEEN 1 AND 1000")
def gr_expand_guard(spark, sf):
    return b.read(spark, sf, "documents").groupBy((F.col("doc_id") % 3).alias("qid")).agg(F.count("*").alias("n")).where("n between 1 and 1000")


@query()
def gr_cluster(spark, sf):
    return graph.clusters(**_classes(spark, sf))


@query()
def gr_pack_ids(spark, sf):
    return graph.pack_ids(graph.clusters(**_classes(spark, sf)), b.read(spark, sf, "documents").count())


@query("SELECT container, (sum(bytes) OVER (ORDER BY container) - bytes)::BIGINT AS start, bytes FROM (SELECT doc_id >> 8 AS container, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1)")
def gr_group_index(spark, sf):
    from nearfold.operators import records

    return records.container_index(b.records(spark, sf).withColumnRenamed("key", "image_id"))


@query(f"WITH {b.EDGES}, {DEG}, f AS (SELECT id, row_number() OVER (PARTITION BY id % 3 ORDER BY degree DESC, id) AS rn FROM deg) SELECT id % 3 AS grp, id FROM f WHERE rn <= 256")
def top_container_fill(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.col("id") % 3).orderBy(F.desc("degree"), "id")
    return graph.degrees(_edges(spark, sf)).withColumn("rn", F.row_number().over(w)).where("rn <= 256").select((F.col("id") % 3).alias("grp"), "id")
