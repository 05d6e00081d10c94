"""Sessions over request streams, and progressive retrieval by feature prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(requests: DataFrame, expire: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """user_id, start, stop, n: sessions that end after ``expire`` without a request. Batch or stream alike."""
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    w = F.session_window("ts", expire)
    return rows.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def progressive(hits: DataFrame, features_done: int) -> DataFrame:
    """id, first: first-seen union over the first ``features_done`` features of a query (hits: ord, id)."""
    return hits.where(F.col("ord") < features_done).groupBy("id").agg(F.min("ord").alias("first"))
