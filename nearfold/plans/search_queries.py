"""Queries of sketch search: plans, unions, ordering and paging."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfold import bindings as b
from nearfold.config import MAX_HASH
from nearfold.functions import bits
from nearfold.functions.bits import WORDS
from nearfold.operators import links
from nearfold.registry import query

Q = f"WITH {b.SKETCHES}, {b.QUERY_SKETCHES}"
ALL = " OR ".join(f"a.{w} = b.{w}" for w in WORDS)
HITS = f"hits AS MATERIALIZED (SELECT DISTINCT a.qid, b.id, ({b.HAMMING})::BIGINT AS d FROM q a JOIN sk b ON ({b.HAMMING}) < 4 WHERE {ALL})"


def _pair(spark, sf):
    sk = b.sketches(spark, sf)
    return b.queries_of(sk), sk


def _hits(spark, sf):
    q, sk = _pair(spark, sf)
    return links.probe(q, sk, links.WORD_KEYS)


def _union_sql(keys, source="sk", queries="q"):
    """Union of one equi-join for each key list, verified."""
    one = [f"SELECT a.qid, b.id, ({b.HAMMING})::BIGINT AS d FROM {queries} a JOIN {source} b ON {' AND '.join(f'a.{k} = b.{k}' for k in ks)} WHERE ({b.HAMMING}) < 4" for ks in keys]
    return " UNION ".join(one)


@query(f"{Q} {_union_sql(links.WORD_KEYS)}")
def join_prefix_probe(spark, sf):
    return _hits(spark, sf)


@query(f"{Q} SELECT a.qid, b.id, ({b.HAMMING})::BIGINT AS d FROM q a, sk b WHERE ({b.HAMMING}) < 4")
def join_linear(spark, sf):
    return links.linear(*_pair(spark, sf))


@query(f"{Q} {_union_sql(links.WORD_KEYS)}")
def join_all_plan(spark, sf):
    return links.probe(*_pair(spark, sf), links.WORD_KEYS)


_EQ = [f"e{k} AS (SELECT 1)" for k in range(0)]


def _bits_sql(start, size):
    """Bits from a hex sketch ``s``, most significant first, as a string of hex digits and masks."""
    first, last = start // 4, (start + size - 1) // 4
    return f"((('0x' || substr(s, {first + 1}, {last - first + 1}))::BIGINT >> {4 * (last + 1) - start - size}) & {(1 << size) - 1})"


_E3 = f"{Q}, hs AS MATERIALIZED (SELECT *, {b.SKETCH_HEX} AS s FROM sk), hq AS MATERIALIZED (SELECT *, {b.SKETCH_HEX} AS s FROM q), es AS (SELECT *, {_bits_sql(0, 43)} AS e0, {_bits_sql(43, 43)} AS e1, {_bits_sql(86, 42)} AS e2 FROM hs), eq AS (SELECT *, {_bits_sql(0, 43)} AS e0, {_bits_sql(43, 43)} AS e1, {_bits_sql(86, 42)} AS e2 FROM hq)"


@query(f"{_E3} {_union_sql([['e0'], ['e1'], ['e2']], 'es', 'eq')}")
def join_equal_plan(spark, sf):
    q, sk = _pair(spark, sf)
    eq, keys = links.equal_plan_keys(q, 3)
    es, _ = links.equal_plan_keys(sk, 3)
    return links.probe(eq, es, keys)


_N = ", ".join(f"c{i} AS (SELECT {w}, count(*) AS n FROM sk GROUP BY {w})" for i, w in enumerate(WORDS))
_P = ", ".join(f"p{r} AS (SELECT {WORDS[r]}, {WORDS[(r + 1) % 4]}, count(*) AS n FROM sk GROUP BY ALL)" for r in range(4))
_COST = ", ".join("coalesce((SELECT n FROM p{r} WHERE p{r}.{a} = q.{a} AND p{r}.{c} = q.{c}), 0) + {rest} AS k{r}".format(r=r, a=WORDS[r], c=WORDS[(r + 1) % 4], rest=" + ".join(f"coalesce((SELECT n FROM c{i} WHERE c{i}.{WORDS[i]} = q.{WORDS[i]}), 0)" for i in range(4) if i not in (r, (r + 1) % 4))) for r in range(4))
_SMART = f"{Q}, {_N}, {_P}, cost AS (SELECT q.*, {_COST} FROM q), pick AS MATERIALIZED (SELECT *, least(k0, k1, k2, k3) AS cost, CASE WHEN k0 = least(k0, k1, k2, k3) THEN 0 WHEN k1 = least(k0, k1, k2, k3) THEN 1 WHEN k2 = least(k0, k1, k2, k3) THEN 2 ELSE 3 END AS omit FROM cost)"
_SMART_ON = " OR ".join(f"(omit = {r} AND ((a.{WORDS[r]} = b.{WORDS[r]} AND a.{WORDS[(r + 1) % 4]} = b.{WORDS[(r + 1) % 4]}) OR {' OR '.join(f'a.{WORDS[i]} = b.{WORDS[i]}' for i in range(4) if i not in (r, (r + 1) % 4))}))" for r in range(4))


@query(f"{_SMART} SELECT a.qid, b.id, ({b.HAMMING})::BIGINT AS d FROM pick a JOIN sk b ON ({b.HAMMING}) < 4 WHERE {_SMART_ON}")
def join_smart_plan(spark, sf):
    return links.smart(*_pair(spark, sf))


@query(f"{_SMART} SELECT qid, omit::BIGINT AS omit, cost::BIGINT AS cost FROM pick")
def plan_cost(spark, sf):
    return links.smart_choice(*_pair(spark, sf)).select("qid", F.col("omit").cast("long"), F.col("cost").cast("long"))


@query(f"{Q}, {HITS} SELECT qid, count(*)::BIGINT AS n, min(d) AS nearest FROM hits GROUP BY qid")
def join_batch_probe(spark, sf):
    return _hits(spark, sf).groupBy("qid").agg(F.count("*").alias("n"), F.min("d").alias("nearest"))


@query(f"{Q} {_union_sql(links.PAIR_KEYS)}")
def join_manku_pairs(spark, sf):
    return links.probe(*_pair(spark, sf), links.PAIR_KEYS)


def _m_sql(k):
    a, c, d = (w for i, w in enumerate(WORDS) if i != k)
    return [f"{a} & 16777215", f"({a} >> 24) | (({c} & 65535) << 8)", f"({c} >> 16) | (({d} & 255) << 16)", f"{d} >> 8"]


_M2 = ", ".join(f"{x} AS m{k}_{j}" for k in range(4) for j, x in enumerate(_m_sql(k)))


@query(f"{Q}, ms AS MATERIALIZED (SELECT *, {_M2} FROM sk), mq AS MATERIALIZED (SELECT *, {_M2} FROM q) {_union_sql([[WORDS[k], f'm{k}_{j}'] for k in range(4) for j in range(4)], 'ms', 'mq')}")
def join_manku_two_level(spark, sf):
    q, sk = _pair(spark, sf)
    mq, keys = links.two_level(q)
    ms, _ = links.two_level(sk)
    return links.probe(mq, ms, keys)


@query(f"WITH {b.SKETCHES} SELECT a.id AS x, b.id AS y FROM sk a JOIN sk b ON a.id < b.id AND ({b.HAMMING}) < 3")
def flt_hamming(spark, sf):
    pairs = links.block_pairs(b.sketches(spark, sf), cap=None)
    return pairs.select(F.col("src").alias("x"), F.col("dst").alias("y"))


@query(f"WITH {b.EDGES} SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE src = dst)::BIGINT AS n_self FROM edge")
def flt_self_pair(spark, sf):
    return links.edges(b.sketches(spark, sf)).agg(F.count("*").alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("n_self"))


@query(f"WITH {b.EDGES}, c AS (SELECT k, count(*) AS n FROM keys GROUP BY k) SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE n > 3)::BIGINT AS n_over FROM keys JOIN c USING (k)")
def agg_bucket_cap(spark, sf):
    rows = links.block_rows(b.sketches(spark, sf))
    kept = links.cap_buckets(rows, 3).agg(F.count("*").alias("kept"))
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(kept).select("n_rows", (F.col("n_rows") - F.col("kept")).alias("n_over"))


@query(f"WITH {b.EDGES} SELECT k, count(*)::BIGINT AS n, array_to_string(list(id ORDER BY id), ',') AS ids FROM keys GROUP BY k HAVING count(*) > 1")
def agg_bucket_collect(spark, sf):
    rows = links.cap_buckets(links.block_rows(b.sketches(spark, sf)), MAX_HASH)
    got = rows.groupBy("k").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).where("n > 1")
    return got.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(f"{Q}, {HITS} SELECT id, min(qid) AS first_query FROM hits GROUP BY id")
def win_first_seen(spark, sf):
    return _hits(spark, sf).groupBy("id").agg(F.min("qid").alias("first_query"))


@query(f"{Q}, {HITS} SELECT DISTINCT id FROM hits")
def agg_distinct_keys(spark, sf):
    return _hits(spark, sf).select("id").distinct()


@query(f"{Q}, {HITS} SELECT DISTINCT id FROM hits WHERE qid % 20 = 10 AND id NOT IN (SELECT id FROM hits WHERE qid % 20 = 0)")
def set_seen_difference(spark, sf):
    h = _hits(spark, sf)
    return h.where("qid % 20 = 10").select("id").distinct().join(h.where("qid % 20 = 0").select("id"), "id", "left_anti")


@query(f"{Q} SELECT a.qid, b.id FROM q a JOIN sk b ON a.w0 = b.w0 UNION SELECT a.qid, b.id FROM q a JOIN sk b ON a.w3 = b.w3")
def set_union_indexes(spark, sf):
    q, sk = _pair(spark, sf)
    one = lambda w: q.select("qid", w).join(sk.select("id", w), w).select("qid", "id")
    return one("w0").unionByName(one("w3")).distinct()


@query(f"{Q}, {HITS} SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id) AS rn FROM hits) WHERE rn <= 3")
def top_hits_cap(spark, sf):
    return links.first_hits(_hits(spark, sf), 3).select("qid", "id")


@query(f"{Q}, {HITS} SELECT count(*) FILTER (WHERE n = 0)::BIGINT AS n_empty, count(*)::BIGINT AS n_queries FROM (SELECT q.qid, count(hits.id) AS n FROM q LEFT JOIN hits ON q.qid = hits.qid GROUP BY 1)")
def agg_empty_count(spark, sf):
    q, sk = _pair(spark, sf)
    n = q.select("qid").join(links.probe(q, sk, links.WORD_KEYS), "qid", "left").groupBy("qid").agg(F.count("id").alias("n"))
    return n.agg(F.count_if(F.col("n") == 0).alias("n_empty"), F.count("*").alias("n_queries"))


_PROBES = " UNION ALL ".join(f"SELECT {32 * i}::BIGINT AS off, count(*)::BIGINT AS n FROM q JOIN sk USING ({w})" for i, w in enumerate(WORDS))


@query(f"{Q} {_PROBES}")
def agg_probe_stat(spark, sf):
    q, sk = _pair(spark, sf)
    side = lambda df, i: df.select(i, F.explode(F.array(*[F.struct(F.lit(32 * k).cast("long").alias("off"), F.col(w).alias("v")) for k, w in enumerate(WORDS)])).alias("key"))
    got = side(q, "qid").join(side(sk, "id"), "key").groupBy("key.off").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(32 * k,) for k in range(4)], "off long").join(got, "off", "left").select("off", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"{Q} SELECT w0 >> 24 AS slot, count(*)::BIGINT AS n FROM (SELECT q.w0 FROM q JOIN sk USING (w0)) GROUP BY 1")
def agg_hit_stat(spark, sf):
    q, sk = _pair(spark, sf)
    return q.select("w0").join(sk.select("w0"), "w0").groupBy(F.shiftright("w0", 24).alias("slot")).agg(F.count("*").alias("n"))


@query(f"{Q}, {HITS}, seen AS (SELECT id, min(qid) AS ord FROM hits GROUP BY id) SELECT id, row_number() OVER (ORDER BY ord, id) - 1 AS pos FROM seen ORDER BY ord, id LIMIT 20 OFFSET 20")
def lmt_page(spark, sf):
    seen = _hits(spark, sf).groupBy("id").agg(F.min("qid").alias("ord"))
    page = seen.orderBy("ord", "id").offset(20).limit(20)
    return page.select("id", (F.row_number().over(Window.orderBy("ord", "id")) + 19).cast("long").alias("pos"))


@query(f"{Q}, {HITS} SELECT id, min(qid) AS ord FROM hits WHERE qid < 200 GROUP BY id")
def lmt_goal_time(spark, sf):
    return _hits(spark, sf).where("qid < 200").groupBy("id").agg(F.min("qid").alias("ord"))


@query("SELECT doc_id, (n_chars + 19) // 20 AS n_pages, greatest(1, doc_id % 50 - 2) AS start, least((n_chars + 19) // 20 - 2, doc_id % 50 + 2) AS stop FROM documents")
def lmt_pager_ui(spark, sf):
    pages, cur = F.expr("(n_chars + 19) div 20"), F.col("doc_id") % 50
    return b.read(spark, sf, "documents").select("doc_id", pages.alias("n_pages"), F.greatest(F.lit(1), cur - 2).alias("start"), F.least(pages - 2, cur + 2).alias("stop"))


@query(f"WITH {b.SKETCHES}, h AS (SELECT id, {b.SKETCH_HEX} AS s FROM sk), r AS (SELECT id, substr(s, 9) || substr(s, 1, 8) AS rot, (('0x' || substr(s, 9, 4))::BIGINT * 8) >> 16 AS part FROM h) SELECT id, rot, part FROM r")
def srt_range_partition_sketch(spark, sf):
    sk = b.sketches(spark, sf).select("id", bits.rotate(bits.sketch_hex(), 32).alias("rot"))
    out = sk.withColumn("part", bits.range_partition16(F.col("rot"), 8))
    return out.repartitionByRange(8, "part", "rot").sortWithinPartitions("rot", "id")


@query("SELECT doc_id AS image_id, doc_id >> 8 AS container FROM documents")
def srt_range_partition_container(spark, sf):
    d = b.read(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), bits.container(F.col("doc_id")).alias("container"))
    return d.repartitionByRange(8, "container").sortWithinPartitions("container", "image_id")


@query(f"WITH {b.SKETCHES}, h AS (SELECT id, {b.SKETCH_HEX} AS s FROM sk) SELECT id, row_number() OVER (PARTITION BY id % 4 ORDER BY substr(s, 17) || substr(s, 1, 16), id) AS rank FROM h")
def srt_rotated_compare(spark, sf):
    sk = b.sketches(spark, sf).select("id", bits.rotate(bits.sketch_hex(), 64).alias("rot"))
    return sk.select("id", F.row_number().over(Window.partitionBy(F.col("id") % 4).orderBy("rot", "id")).cast("long").alias("rank"))


@query(f"WITH {b.SKETCHES}, h AS (SELECT id, {b.SKETCH_HEX} AS s FROM sk) SELECT id, s < p AS inverted FROM (SELECT id, s, lag(s) OVER (PARTITION BY id % 4 ORDER BY id) AS p FROM h) WHERE s < p")
def chk_sorted(spark, sf):
    sk = b.sketches(spark, sf).select("id", bits.sketch_hex().alias("s"))
    before = F.lag("s").over(Window.partitionBy(F.col("id") % 4).orderBy("id"))
    return sk.withColumn("p", before).where("s < p").select("id", F.lit(True).alias("inverted"))


@query()
def rnd_image(spark, sf):
    from nearfold.operators import graph

    deg = graph.degrees(links.edges(b.sketches(spark, sf)))
    return deg.where("degree > 5").orderBy(F.xxhash64("id", F.lit(42)), "id").limit(20).select("id")


@query()
def rnd_demo(spark, sf):
    return b.read(spark, sf, "documents").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(10)


@query()
def srt_shuffle(spark, sf):
    return b.read(spark, sf, "documents").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
