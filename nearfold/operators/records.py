"""Record layer: merge by checksum, dense ids, containers, counters, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfold.config import CHECKSUM_BUCKETS, MAX_SOURCES
from nearfold.functions import bits

#: Parts of a hot checksum, and keys of a block that one task numbers.
SALTS, KEY_BLOCK = 64, 1 << 16


def merge_by_checksum(rec: DataFrame, cap: int = MAX_SOURCES) -> DataFrame:
    """One record for each checksum: that of the least key, with all urls in key order, at most ``cap``.

    Urls are numbered before they are gathered, in salted parts first, so a hot
    checksum never brings more than ``cap`` rows of each part together.
    """
    rec = rec.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)))
    for part in (["checksum", "salt"], ["checksum"]):
        w = Window.partitionBy(*part).orderBy("key", "url")
        rec = rec.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    ranked = rec
    first = F.struct("key", "width", "height", "size")
    urls = F.transform(F.array_sort(F.collect_list(F.struct("rn", "url"))), lambda x: x["url"])
    return ranked.groupBy("checksum").agg(F.min(first).alias("f"), urls.alias("urls")).select("checksum", "f.*", "urls")


def bucket_counts(rec: DataFrame) -> DataFrame:
    return rec.groupBy(bits.checksum_bucket(F.col("checksum")).alias("bucket")).agg(F.count("*").alias("n"))


def bucket_starts(rec: DataFrame, buckets: int = CHECKSUM_BUCKETS) -> DataFrame:
    """bucket, start: exclusive running sum over all buckets, empty ones too."""
    all_ = rec.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(bucket_counts(rec), "bucket", "left")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return all_.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def dense_ids(rec: DataFrame) -> DataFrame:
    """Adds image_id 0..N-1 by (bucket, checksum, key).

    Rows are numbered inside (checksum, block of keys), which no hot checksum
    makes large; the blocks' counts give where each starts in its bucket.
    """
    rows = rec.withColumn("bucket", bits.checksum_bucket(F.col("checksum"))).withColumn("block", F.floor(F.col("key") / KEY_BLOCK))
    part = ["bucket", "checksum", "block"]
    before = Window.partitionBy("bucket").orderBy("checksum", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*part).count().select(*part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("inside"))
    starts = starts.join(bucket_starts(rec), "bucket").select(*part, (F.col("start") + F.col("inside")).alias("start"))
    at = F.row_number().over(Window.partitionBy(*part).orderBy("key")) - 1
    return rows.withColumn("at", at).join(starts, part).withColumn("image_id", F.col("start") + F.col("at")).drop("at", "start", "bucket", "block")


def containers(img: DataFrame) -> DataFrame:
    return img.groupBy(bits.container(F.col("image_id")).alias("container")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.array_sort(F.collect_list("image_id")).alias("ids"))


def container_index(img: DataFrame) -> DataFrame:
    """container, start, bytes: byte offset of each container in container order."""
    c = img.groupBy(bits.container(F.col("image_id")).alias("container")).agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("container").rowsBetween(Window.unboundedPreceding, -1)
    return c.select("container", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"), "bytes")


def map_ids(rec: DataFrame, mapping: DataFrame) -> DataFrame:
    """Records under their new ids; exactly one of each is asserted."""
    both = rec.join(mapping, rec.image_id == mapping.old_id, "full")
    one = F.count("*").over(Window.partitionBy(F.coalesce("image_id", "old_id")))
    fail = F.raise_error(F.lit("record and mapping must match one to one")).cast("boolean")
    checked = both.withColumn("ok", F.when(F.isnull("image_id") | F.isnull("old_id") | (one > 1), fail).otherwise(True)).where("ok")
    return checked.drop("image_id", "old_id", "ok").withColumnRenamed("new_id", "image_id")


def min_size(width: Column, height: Column, least: int) -> Column:
    return F.least(width, height) >= least


def systematic(df: DataFrame, key: str, every: int, block: int = 1 << 16) -> DataFrame:
    """Every ``every``-th row by ``key``, numbered in blocks of key ranges."""
    df = df.withColumn("__b", F.floor(F.col(key) / block))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("__b").count().select("__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__s"))
    rows = df.withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1).join(starts, "__b")
    return rows.where((F.col("__s") + F.col("__i")) % every == 0).drop("__b", "__s", "__i")


def insert_absent(new: DataFrame, logged: DataFrame) -> DataFrame:
    """Records of ``new`` to append to the query log: those whose checksum isn't there, one of each."""
    return new.join(logged.select("checksum"), "checksum", "left_anti").dropDuplicates(["checksum"])
