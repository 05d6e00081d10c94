"""The search service as functions on DataFrames: one batch of queries in, result pages out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfold.operators import graph, links


class Engine:
    """sketch: id (feature's image), w0..w3; image: image_id, checksum, width, height, url; edge: src, dst."""

    def __init__(self, sketch: DataFrame, image: DataFrame, edge: DataFrame | None = None):
        self.sketch, self.image, self.edge = sketch, image, edge

    def search(self, q: DataFrame, expansion: bool = False, keep: str | None = None) -> DataFrame:
        """qid, id, rank. q: qid, ord, w0..w3 and whatever the predicate ``keep`` (such as a crop box) reads."""
        q = q.where(F.expr(keep)) if keep else q
        tagged = q.withColumn("fid", F.struct("qid", "ord")).withColumn("owner", F.col("qid"))
        hits = links.probe(tagged.select(F.col("fid").alias("qid"), *links.WORDS), self.sketch, links.WORD_KEYS)
        seen = hits.groupBy(F.col("qid.qid").alias("qid"), "id").agg(F.min("qid.ord").alias("first"))
        if expansion and self.edge is not None:
            return graph.nibble(seen.select("qid", "id"), self.edge)
        return seen.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("first", "id")).alias("rank"))

    def search_checksums(self, checksums: DataFrame, log: DataFrame) -> DataFrame:
        """Search of logged query records (log: checksum, ord, w0..w3)."""
        return self.search(log.join(checksums, "checksum").withColumn("qid", F.xxhash64("checksum")))

    def search_local(self, ids: DataFrame, expansion: bool = False) -> DataFrame:
        """By indexed id: its neighbours, or the expansion of it."""
        if expansion:
            return graph.nibble(ids.select(F.col("id").alias("qid"), "id"), self.edge)
        got = graph.neighbors(self.edge, ids).select(F.col("id").alias("qid"), F.posexplode("nbrs").alias("rank", "id"))
        return got.select("qid", "id", (F.col("rank") + 1).alias("rank"))

    def random_images(self, n: int, seed: int, degree: int = 5) -> DataFrame:
        deg = graph.degrees(self.edge).where(F.col("degree") > degree)
        return deg.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select("id")

    def page(self, results: DataFrame, offset: int, count: int) -> DataFrame:
        """Rows offset.. of each query's results; a count of 0 takes the rest."""
        rows = results.where(F.col("rank") > offset)
        return rows.where(F.col("rank") <= offset + count) if count else rows

    def meta(self, ids: DataFrame) -> DataFrame:
        return self.image.join(ids.withColumnRenamed("id", "image_id"), "image_id", "left_semi")

    def response(self, q: DataFrame, results: DataFrame, offset: int = 0, count: int = 20) -> DataFrame:
        """qid, body: the JSON answer of each query."""
        n = results.groupBy("qid").agg(F.count("*").alias("num_results"))
        page = self.page(results, offset, count).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("page"))
        total = q.groupBy("qid").agg(F.count("*").alias("total"))
        rows = total.join(n, "qid", "left").join(page, "qid", "left")
        page_col = F.coalesce("page", F.array().cast("array<bigint>"))
        body = F.struct(F.lit(True).alias("done"), F.struct("total", F.col("total").alias("done")).alias("retrieve"), F.coalesce("num_results", F.lit(0)).alias("num_results"), F.lit(offset).alias("page_offset"), F.size(page_col).alias("page_count"), page_col.alias("page"))
        return rows.select("qid", F.to_json(body).alias("body"))
