"""Match kernels between the local features of two images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfold.config import LOWE_RATIO
from nearfold.functions import vectors


def image_pairs(feat: DataFrame, fg: Column | str, bg: Column | str) -> DataFrame:
    """Feature pairs (q_*, i_*) of every foreground image with every other background image.

    The foreground is a small stated set of query images.
    """
    q = feat.where(fg).select(*[F.col(c).alias(f"q_{c}") for c in feat.columns])
    i = feat.where(bg).select(*[F.col(c).alias(f"i_{c}") for c in feat.columns])
    return i.join(q, F.col("q_image_id") != F.col("i_image_id"))


def histogram(pairs: DataFrame, distance: Column, limit: int) -> DataFrame:
    """q, i, d, n: pairs at each distance below the limit."""
    got = pairs.withColumn("d", distance).where(F.col("d") < limit)
    return got.groupBy(F.col("q_image_id").alias("q"), F.col("i_image_id").alias("i"), "d").agg(F.count("*").alias("n"))


def _blocks(feat: DataFrame, side: str, images: int) -> DataFrame:
    """Features in blocks of whole images, by length of descriptor; those with a null have no distances."""
    whole = feat.where(F.isnotnull("desc") & F.col("image_id").isNotNull() & ~F.exists("desc", F.isnull))
    rows = whole.groupBy(F.floor(F.col("image_id") / images).alias("block"), F.size("desc").alias(f"{side}_size"))
    return rows.agg(F.collect_list(F.struct("image_id", "desc")).alias(side)).where(F.col(f"{side}_size") > 0).drop("block")


def l2_histogram(feat: DataFrame, fg: Column | str, bg: Column | str, bins, limit: int) -> DataFrame:
    """As ``histogram`` of ``image_pairs`` by ``bins`` of the squared distance: a matrix product for each two blocks of images.

    Elements are integers, so sums are exact below 2**53.
    """
    pairs = _blocks(feat.where(bg), "i", 256).crossJoin(_blocks(feat.where(fg), "q", 2048)).where("q_size = i_size")

    def side(column, row: int):
        values = column.slice(row, 1).flatten()
        ids = values.field("image_id").to_numpy()
        return ids, values.field("desc").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)

    def count(batches):
        for b in batches:
            for row in range(b.num_rows):
                (qi, q), (ii, i) = side(b.column(0), row), side(b.column(1), row)
                qn, qat = np.unique(qi, return_inverse=True)
                im, iat = np.unique(ii, return_inverse=True)
                for x in range(0, len(q), 256):
                    part = q[x : x + 256]
                    d = bins((part * part).sum(axis=1)[:, None] + (i * i).sum(axis=1) - 2 * part @ i.T).astype(np.int64)
                    ok = (d < limit) & (qi[x : x + 256, None] != ii)
                    at, to = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays([pa.array(qn[qat[x + at]]), pa.array(im[iat[to]]), pa.array(d[ok])], ["q", "i", "d"])

    got = pairs.select("q", "i").mapInArrow(count, "q long, i long, d long")
    return got.groupBy("q", "i", "d").agg(F.count("*").alias("n"))


def nearest_ratio(pairs: DataFrame, ratio: float = LOWE_RATIO) -> DataFrame:
    """q_vec_id, i_image_id, i_vec_id, d1: the best match of each query feature in each image, kept where
    its squared distance is below ``ratio`` of the second's; a lone candidate is kept."""
    d = pairs.withColumn("d", vectors.l2sqr(F.col("q_desc"), F.col("i_desc")))
    w = Window.partitionBy("q_vec_id", "i_image_id").orderBy("d", "i_vec_id")
    two = d.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    best = two.groupBy("q_vec_id", "i_image_id").agg(F.min(F.struct("d", "i_vec_id")).alias("b"), F.max(F.when(F.col("rn") == 2, F.col("d"))).alias("d2"))
    return best.where(F.isnull("d2") | (F.col("b.d") < ratio * F.col("d2"))).select("q_vec_id", "i_image_id", F.col("b.i_vec_id").alias("i_vec_id"), F.col("b.d").alias("d1"))


def soft_words(feat: DataFrame, words: DataFrame, soft: int) -> DataFrame:
    """vec_id, word, rank: the ``soft`` nearest codewords (word, desc) of each feature.

    The codebook is a fixed model, so each feature meets every codeword once.
    """
    d = feat.select("vec_id", "image_id", "desc").join(words.select(F.col("word"), F.col("desc").alias("mean")))
    d = d.withColumn("d", vectors.l2sqr(F.col("desc"), F.col("mean")))
    w = Window.partitionBy("vec_id").orderBy("d", "word")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= soft).select("vec_id", "image_id", "word", "rank")


def word_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """q, i, n: equal word pairs of the images of a and b. Counted per image and word first, so that a
    frequent word costs one row for each image and not one for each pair of features."""
    n = lambda df, id_, c: df.groupBy(F.col("image_id").alias(id_), "word").agg(F.count("*").alias(c))
    both = n(a, "q", "x").join(n(b, "i", "y"), "word").where("q <> i")
    return both.groupBy("q", "i").agg(F.sum(F.col("x") * F.col("y")).alias("n"))


def lsh_keys(feat: DataFrame, tables: int, hashes: int, width: int) -> DataFrame:
    """Adds key: for each table, the hashes' bits and the table number."""
    bit = lambda t, j: vectors.lsh_bit(F.col("desc"), t * hashes + j, width)
    keys = [sum((bit(t, j) * (1 << j) for j in range(1, hashes)), bit(t, 0)) * tables + t for t in range(tables)]
    return feat.withColumn("key", F.explode(F.array(*keys)))


def sketch_bits(feat: DataFrame, bits: int, width: int) -> DataFrame:
    """vec_id, sketch: low bits of integer projections, least significant first."""
    parts = [vectors.lsh_bit(F.col("desc"), j, width) * F.lit(1 << j).cast("long") for j in range(bits)]
    return feat.select("vec_id", "image_id", sum(parts[1:], parts[0]).alias("sketch"))


def transform_of(m: str) -> tuple[Column, Column, Column]:
    """Scale and shift taking the query point of match ``m`` to its image point."""
    s = F.col(f"{m}.i_r") / F.col(f"{m}.q_r")
    return s, F.col(f"{m}.i_x") - F.col(f"{m}.q_x") * s, F.col(f"{m}.i_y") - F.col(f"{m}.q_y") * s


def transform_error(s: Column, dx: Column, dy: Column, m: str) -> Column:
    ds, ex, ey = F.col(f"{m}.q_r") * s - F.col(f"{m}.i_r"), F.col(f"{m}.q_x") * s + dx - F.col(f"{m}.i_x"), F.col(f"{m}.q_y") * s + dy - F.col(f"{m}.i_y")
    return F.sqrt(ds * ds + ex * ex + ey * ey)


def consensus(matches: DataFrame, tolerance: float) -> DataFrame:
    """q, i, hyp, n: the single-match hypothesis with most inliers of each image pair.

    Every match is tried, so the result is at least as good as random draws;
    of equals the least hypothesis (query, image feature) wins.
    """
    a, b = matches.alias("a"), matches.alias("b")
    both = a.join(b, (F.col("a.q_image_id") == F.col("b.q_image_id")) & (F.col("a.i_image_id") == F.col("b.i_image_id")))
    both = both.where(transform_error(*transform_of("a"), "b") <= tolerance)
    n = both.groupBy(F.col("a.q_image_id").alias("q"), F.col("a.i_image_id").alias("i"), F.col("a.q_vec_id").alias("hq"), F.col("a.i_vec_id").alias("hi")).agg(F.count("*").alias("n"))
    best = n.groupBy("q", "i").agg(F.max(F.struct("n", -F.col("hq"), -F.col("hi"))).alias("b"))
    return best.select("q", "i", (-F.col("b.col2")).alias("hq"), (-F.col("b.col3")).alias("hi"), F.col("b.n").alias("n"))
