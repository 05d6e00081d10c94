"""Queries of vector functions and match kernels on vector features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfold import bindings as b
from nearfold.functions import vectors
from nearfold.operators import kernels as k
from nearfold.registry import query

W = f"WITH {b.FEATURES}"
#: The stated query set; it is matched against all images.
FG, BG = "image_id % 20 = 0", "true"
L2 = 'list_sum(list_transform(range(1, 65), lambda j: (q."desc"[j] - i."desc"[j]) * (q."desc"[j] - i."desc"[j])))::BIGINT'
PAIRS = "feat q, feat i WHERE q.image_id % 20 = 0 AND q.image_id <> i.image_id"
LABEL = "lab AS (SELECT *, (SELECT 1) FROM feat)"


def _pairs(spark, sf):
    return k.image_pairs(b.features(spark, sf), FG, BG)


def _bit(v, j, width):
    terms = " + ".join(f"{v}[{i + 1}] * {((i * 31 + j * 17 + i * i) % 101) - 50}" for i in range(64))
    return f"(floor(({terms} + {37 * j}) / {float(width)})::BIGINT & 1)"


@query(f"{W} SELECT vec_id, -list_sum([CASE WHEN n > 0 THEN n / 64.0::DOUBLE * log2(n / 64.0::DOUBLE) ELSE 0 END]) AS e FROM (SELECT 1 AS vec_id, 64 AS n) WHERE false UNION ALL SELECT vec_id, round(-sum(n / 64.0::DOUBLE * log2(n / 64.0::DOUBLE)), 9) AS e FROM (SELECT vec_id, v, count(*)::DOUBLE AS n FROM (SELECT vec_id, unnest(list_transform(\"desc\", lambda x: (x + 1000) // 16)) AS v FROM feat) GROUP BY 1, 2) GROUP BY 1")
def agg_entropy(spark, sf):
    return _entropy(b.features(spark, sf)).select("vec_id", F.round("e", 9).alias("e"))


def _entropy(feat):
    n = feat.select("vec_id", F.explode(F.transform("desc", lambda x: F.floor((x + 1000) / 16))).alias("v")).groupBy("vec_id", "v").agg(F.count("*").cast("double").alias("n"))
    return n.groupBy("vec_id").agg((-F.sum(F.col("n") / 64 * F.log2(F.col("n") / 64))).alias("e"))


@query(f"{W} SELECT vec_id FROM (SELECT vec_id, -sum(n / 64.0::DOUBLE * log2(n / 64.0::DOUBLE)) AS e FROM (SELECT vec_id, v, count(*)::DOUBLE AS n FROM (SELECT vec_id, unnest(list_transform(\"desc\", lambda x: (x + 1000) // 16)) AS v FROM feat) GROUP BY 1, 2) GROUP BY 1) WHERE e >= 4.4")
def flt_entropy(spark, sf):
    return _entropy(b.features(spark, sf)).where("e >= 4.4").select("vec_id")


@query(f"{W} SELECT vec_id FROM feat i WHERE vec_id % 50 <> 0 AND NOT EXISTS (SELECT 1 FROM feat q WHERE q.vec_id % 50 = 0 AND {L2} < 1300000)")
def flt_blacklist(spark, sf):
    feat = b.features(spark, sf)
    black = feat.where("vec_id % 50 = 0").select(F.col("desc").alias("black"))
    return feat.where("vec_id % 50 <> 0").join(black, vectors.l2sqr(F.col("desc"), F.col("black")) < 1300000, "left_anti").select("vec_id")


@query(f"{W} SELECT vec_id, (x >= 25 AND x <= 200 AND y >= 20 AND y <= 150) AS inside FROM feat WHERE (x >= 25 AND x <= 200 AND y >= 20 AND y <= 150) = (image_id % 2 = 0)")
def flt_crop_box(spark, sf):
    """Box bounds as fractions of a 250 x 200 image, inclusive; odd images are cut instead."""
    inside = F.col("x").between(0.1 * 250, 0.8 * 250) & F.col("y").between(0.1 * 200, 0.75 * 200)
    return b.features(spark, sf).where(inside == (F.col("image_id") % 2 == 0)).select("vec_id", inside.alias("inside"))


@query(f"{W} SELECT q.vec_id AS a, i.vec_id AS b, {L2} AS d FROM {PAIRS}")
def fx_l2sqr(spark, sf):
    return _pairs(spark, sf).select(F.col("q_vec_id").alias("a"), F.col("i_vec_id").alias("b"), vectors.l2sqr(F.col("q_desc"), F.col("i_desc")).alias("d"))


@query(f"{W} SELECT q.vec_id AS a, i.vec_id AS b, round(sqrt({L2}), 6) AS d FROM {PAIRS}")
def fx_l2(spark, sf):
    d = F.round(F.sqrt(vectors.l2sqr(F.col("q_desc"), F.col("i_desc"))), 6)
    return _pairs(spark, sf).select(F.col("q_vec_id").alias("a"), F.col("i_vec_id").alias("b"), d.alias("d"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda e: floor(least(1.0, (ln(greatest(e::DOUBLE, 0.001)) - ln(0.001)) / -ln(0.001)) * 1000 + 0.5)::BIGINT))::BIGINT AS total FROM embeddings")
def fx_logscale(spark, sf):
    v = F.transform(vectors.logscale(F.col("embedding"), 0.001), lambda x: F.floor(x * 1000 + 0.5))
    return b.read(spark, sf, "embeddings").select("vec_id", F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda e: floor(least(1.0, e::DOUBLE * 2) * 1000 + 0.5)::BIGINT))::BIGINT AS total FROM embeddings")
def fx_desc_scale(spark, sf):
    v = F.transform(vectors.descriptor_scale(F.col("embedding")), lambda x: F.floor(x * 1000 + 0.5))
    return b.read(spark, sf, "embeddings").select("vec_id", F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT vec_id, (" + " + ".join(f"CASE WHEN embedding[{i + 1}]::DOUBLE >= 0.05 THEN {1 << i} ELSE 0 END" for i in range(32)) + ")::BIGINT AS bits FROM embeddings")
def fx_binarify(spark, sf):
    return b.read(spark, sf, "embeddings").select("vec_id", vectors.binarify(F.slice("embedding", 1, 32), 0.05).alias("bits"))


@query(f"{W} SELECT vec_id, (" + " + ".join(f"{_bit(chr(34) + 'desc' + chr(34), j, 4000)} * {1 << j}" for j in range(16)) + ")::BIGINT AS sketch FROM feat")
def fx_sketch(spark, sf):
    return k.sketch_bits(b.features(spark, sf), 16, 4000).select("vec_id", "sketch")


_SKETCH16 = f"s16 AS MATERIALIZED (SELECT vec_id, image_id, (" + " + ".join(f"{_bit(chr(34) + 'desc' + chr(34), j, 4000)} * {1 << j}" for j in range(16)) + ")::BIGINT AS sketch FROM feat)"


@query(f"{W}, {_SKETCH16} SELECT q.image_id AS q, i.image_id AS i, bit_count(xor(q.sketch, i.sketch))::BIGINT AS d, count(*)::BIGINT AS n FROM s16 q, s16 i WHERE q.image_id % 20 = 0 AND q.image_id <> i.image_id AND bit_count(xor(q.sketch, i.sketch)) < 8 GROUP BY ALL")
def join_theta_sketch(spark, sf):
    pairs = k.image_pairs(k.sketch_bits(b.features(spark, sf), 16, 4000), FG, BG)
    return k.histogram(pairs, F.bit_count(F.col("q_sketch").bitwiseXOR(F.col("i_sketch"))).cast("long"), 8)


@query(f"{W}, sq AS MATERIALIZED (SELECT vec_id, image_id, list_transform(\"desc\", lambda x: (x + 1000) // 250) AS v FROM feat), p AS (SELECT q.image_id AS q, i.image_id AS i, list_max(list_transform(range(1, 65), lambda j: abs(q.v[j] - i.v[j]))) AS m, list_sum(list_transform(range(1, 65), lambda j: abs(q.v[j] - i.v[j])))::BIGINT AS d FROM sq q, sq i WHERE q.image_id % 20 = 0 AND q.image_id <> i.image_id) SELECT q, i, d, count(*)::BIGINT AS n FROM p WHERE m <= 1 AND d < 40 GROUP BY ALL")
def join_theta_sq(spark, sf):
    v = b.features(spark, sf).select("vec_id", "image_id", F.transform("desc", lambda x: F.floor((x + 1000) / 250)).alias("v"))
    return k.histogram(k.image_pairs(v, FG, BG), vectors.off_by_one(F.col("q_v"), F.col("i_v")), 40)


@query(f"{W} SELECT q.vec_id AS a, i.vec_id AS b, CASE WHEN list_max(list_transform(range(1, 65), lambda j: abs((q.\"desc\"[j] + 1000) // 250 - (i.\"desc\"[j] + 1000) // 250))) <= 1 THEN list_sum(list_transform(range(1, 65), lambda j: abs((q.\"desc\"[j] + 1000) // 250 - (i.\"desc\"[j] + 1000) // 250)))::BIGINT END AS d FROM {PAIRS}")
def fx_scalar_quant(spark, sf):
    v = b.features(spark, sf).select("vec_id", "image_id", F.transform("desc", lambda x: F.floor((x + 1000) / 250)).alias("v"))
    return k.image_pairs(v, FG, BG).select(F.col("q_vec_id").alias("a"), F.col("i_vec_id").alias("b"), vectors.off_by_one(F.col("q_v"), F.col("i_v")).alias("d"))


@query(f"{W} SELECT q.image_id AS q, i.image_id AS i, floor(sqrt({L2}) / 100)::BIGINT AS d, count(*)::BIGINT AS n FROM {PAIRS} AND sqrt({L2}) / 100 < 14 GROUP BY ALL")
def agg_float_histogram(spark, sf):
    return k.l2_histogram(b.features(spark, sf), FG, BG, lambda d: np.floor(np.sqrt(d) / 100), 14)


_HIST = f"hist AS (SELECT q.image_id AS q, i.image_id AS i, ({L2} // 250000)::BIGINT AS d, count(*)::BIGINT AS n FROM {PAIRS} GROUP BY ALL)"


def _hist(spark, sf, limit):
    return k.l2_histogram(b.features(spark, sf), FG, BG, lambda d: np.floor(d / 250000), limit)


@query(f"{W}, {_HIST} SELECT q, i, d, n FROM hist WHERE d < 9")
def agg_histogram(spark, sf):
    return _hist(spark, sf, 9)


@query(f"{W}, {_HIST} SELECT q, sum(n)::BIGINT AS n FROM hist WHERE d < 5 GROUP BY q HAVING sum(n) > 0")
def agg_accumulate(spark, sf):
    return _hist(spark, sf, 5).groupBy("q").agg(F.sum("n").alias("n")).where("n > 0")


@query(f"{W} SELECT q.image_id AS q, i.image_id AS i, count(*)::BIGINT AS n FROM {PAIRS} GROUP BY ALL")
def join_fg_bg(spark, sf):
    return _pairs(spark, sf).groupBy(F.col("q_image_id").alias("q"), F.col("i_image_id").alias("i")).agg(F.count("*").alias("n"))


_NN = f"nn AS (SELECT q.vec_id AS a, i.image_id AS i, i.vec_id AS b, {L2} AS d, row_number() OVER (PARTITION BY q.vec_id, i.image_id ORDER BY {L2}, i.vec_id) AS rn FROM {PAIRS})"


@query(f"{W}, {_NN} SELECT x.a AS q_vec_id, x.i AS i_image_id, x.b AS i_vec_id, x.d AS d1 FROM nn x LEFT JOIN nn y ON y.a = x.a AND y.i = x.i AND y.rn = 2 WHERE x.rn = 1 AND (y.d IS NULL OR x.d < 0.8 * y.d)")
def join_nn_ratio(spark, sf):
    return k.nearest_ratio(_pairs(spark, sf), 0.8)


_WORDS = 'words AS (SELECT vec_id AS word, "desc" AS mean FROM feat WHERE vec_id % 31 = 0), vq AS MATERIALIZED (SELECT vec_id, image_id, word, row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(range(1, 65), lambda j: ("desc"[j] - mean[j]) * ("desc"[j] - mean[j]))), word) AS rank FROM feat, words)'


def _soft(spark, sf, soft):
    feat = b.features(spark, sf)
    return k.soft_words(feat, feat.where("vec_id % 31 = 0").select(F.col("vec_id").alias("word"), "desc"), soft)


@query(f"{W}, {_WORDS} SELECT vec_id, word, rank FROM vq WHERE rank <= 3")
def top_soft_words(spark, sf):
    return _soft(spark, sf, 3).select("vec_id", "word", F.col("rank").cast("long"))


@query(f"{W}, {_WORDS} SELECT vec_id, word FROM vq WHERE rank = 1")
def fx_vq_assign(spark, sf):
    return _soft(spark, sf, 1).select("vec_id", "word")


@query(f"{W}, {_WORDS} SELECT q.image_id AS q, i.image_id AS i, count(*)::BIGINT AS n FROM vq q JOIN vq i USING (word) WHERE q.rank <= 2 AND i.rank <= 2 AND q.image_id % 20 = 0 AND q.image_id <> i.image_id GROUP BY ALL")
def join_vq_word(spark, sf):
    vq = _soft(spark, sf, 2)
    return k.word_matches(vq.where(FG), vq.where(BG))


_LSH = "lsh AS MATERIALIZED (SELECT vec_id, image_id, unnest([" + ", ".join("(" + " + ".join(f"{_bit(chr(34) + 'desc' + chr(34), t * 6 + j, 4000)} * {1 << j}" for j in range(6)) + f") * 2 + {t}" for t in range(2)) + "])::BIGINT AS key FROM feat)"


@query(f"{W}, {_LSH} SELECT vec_id, key FROM lsh")
def fx_multiprobe_lsh(spark, sf):
    return k.lsh_keys(b.features(spark, sf).select("vec_id", "desc"), 2, 6, 4000).select("vec_id", "key")


@query(f"{W}, {_LSH} SELECT q.image_id AS q, i.image_id AS i, count(*)::BIGINT AS n FROM lsh q JOIN lsh i USING (key) WHERE q.image_id % 20 = 0 AND q.image_id <> i.image_id GROUP BY ALL")
def join_lsh_sortmerge(spark, sf):
    keys = k.lsh_keys(b.features(spark, sf).select("vec_id", "image_id", "desc"), 2, 6, 4000).select("image_id", F.col("key").alias("word"))
    return k.word_matches(keys.where(FG), keys.where(BG))


_T = "i.r::DOUBLE / q.r AS s, i.x - q.x * (i.r::DOUBLE / q.r) AS dx, i.y - q.y * (i.r::DOUBLE / q.r) AS dy"


@query(f"{W} SELECT q.vec_id AS a, i.vec_id AS b, round(s, 6) AS s, round(dx, 6) AS dx, round(dy, 6) AS dy FROM (SELECT q.vec_id, q.r, q.x, q.y FROM feat q) q, feat i, LATERAL (SELECT {_T}) WHERE q.vec_id // 5 % 20 = 0 AND q.vec_id // 5 <> i.image_id")
def fx_transform(spark, sf):
    m = _pairs(spark, sf).alias("m")
    s, dx, dy = k.transform_of("m")
    return m.select(F.col("q_vec_id").alias("a"), F.col("i_vec_id").alias("b"), F.round(s, 6).alias("s"), F.round(dx, 6).alias("dx"), F.round(dy, 6).alias("dy"))


_MATCH = f"m AS MATERIALIZED (SELECT q.vec_id AS qv, q.image_id AS q, q.x AS qx, q.y AS qy, q.r AS qr, i.vec_id AS iv, i.image_id AS i, i.x AS ix, i.y AS iy, i.r AS ir FROM {PAIRS})"
_ERR = "sqrt(power(b.qr * (a.ir::DOUBLE / a.qr) - b.ir, 2) + power(b.qx * (a.ir::DOUBLE / a.qr) + (a.ix - a.qx * (a.ir::DOUBLE / a.qr)) - b.ix, 2) + power(b.qy * (a.ir::DOUBLE / a.qr) + (a.iy - a.qy * (a.ir::DOUBLE / a.qr)) - b.iy, 2))"


@query(f"{W}, {_MATCH} SELECT q, i, hq, hi, n FROM (SELECT *, row_number() OVER (PARTITION BY q, i ORDER BY n DESC, hq, hi) AS rn FROM (SELECT a.q, a.i, a.qv AS hq, a.iv AS hi, count(*)::BIGINT AS n FROM m a JOIN m b ON a.q = b.q AND a.i = b.i WHERE {_ERR} <= 30.5 GROUP BY ALL)) WHERE rn = 1")
def fx_ransac(spark, sf):
    return k.consensus(_pairs(spark, sf), 30.5)


@query(f"{W}, {_MATCH} SELECT a.qv AS hq, a.iv AS hi, count(*)::BIGINT AS n, count(*) FILTER (WHERE {_ERR} <= 30.5)::BIGINT AS inliers FROM m a JOIN m b ON a.q = b.q AND a.i = b.i GROUP BY ALL")
def fx_transform_error(spark, sf):
    m = _pairs(spark, sf)
    both = m.alias("a").join(m.alias("b"), (F.col("a.q_image_id") == F.col("b.q_image_id")) & (F.col("a.i_image_id") == F.col("b.i_image_id")))
    err = k.transform_error(*k.transform_of("a"), "b")
    return both.groupBy(F.col("a.q_vec_id").alias("hq"), F.col("a.i_vec_id").alias("hi")).agg(F.count("*").alias("n"), F.count_if(err <= 30.5).alias("inliers"))


@query("SELECT vec_id, (40 + vec_id % 600) AS w, (30 + vec_id * 7 % 500) AS h, CASE WHEN greatest(40 + vec_id % 600, 30 + vec_id * 7 % 500) <= 250 THEN 40 + vec_id % 600 WHEN 40 + vec_id % 600 >= 30 + vec_id * 7 % 500 THEN 250 ELSE (40 + vec_id % 600) * 250 // (30 + vec_id * 7 % 500) END AS nw, CASE WHEN greatest(40 + vec_id % 600, 30 + vec_id * 7 % 500) <= 250 THEN 30 + vec_id * 7 % 500 WHEN 40 + vec_id % 600 >= 30 + vec_id * 7 % 500 THEN (30 + vec_id * 7 % 500) * 250 // (40 + vec_id % 600) ELSE 250 END AS nh FROM embeddings")
def fx_limit_size(spark, sf):
    from nearfold.functions import images

    w, h = 40 + F.col("vec_id") % 600, 30 + F.col("vec_id") * 7 % 500
    nw, nh = images.limit_size(w, h, 250)
    return b.read(spark, sf, "embeddings").select("vec_id", w.alias("w"), h.alias("h"), nw.alias("nw"), nh.alias("nh"))


@query("SELECT vec_id, CASE WHEN least(w, h) >= 80 THEN w WHEN w <= h THEN 80 ELSE w * 80 // h END AS nw, CASE WHEN least(w, h) >= 80 THEN h WHEN w <= h THEN h * 80 // w ELSE 80 END AS nh FROM (SELECT vec_id, 20 + vec_id % 100 AS w, 25 + vec_id * 7 % 110 AS h FROM embeddings)")
def fx_limit_below(spark, sf):
    from nearfold.functions import images

    nw, nh = images.limit_below(20 + F.col("vec_id") % 100, 25 + F.col("vec_id") * 7 % 110, 80)
    return b.read(spark, sf, "embeddings").select("vec_id", nw.alias("nw"), nh.alias("nh"))


@query("SELECT label, count(*)::BIGINT AS n, round(avg(x), 9) AS mean, round(min(x), 9) AS least, round(max(x), 9) AS most, round(coalesce(stddev_samp(x), 0), 9) AS sd FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label")
def agg_stat(spark, sf):
    x = F.col("embedding")[0].cast("double")
    r = lambda c: F.round(c, 9)
    return b.read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), r(F.avg(x)).alias("mean"), r(F.min(x)).alias("least"), r(F.max(x)).alias("most"), r(F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias("sd"))
