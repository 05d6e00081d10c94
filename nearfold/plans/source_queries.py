"""Queries of sources, sinks, the request log and the service."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfold import bindings as b
from nearfold.functions import text
from nearfold.operators import links
from nearfold.plans.api import Engine
from nearfold.registry import query
from nearfold.sources import files
from nearfold.streaming import sessions as st

TYPE = "CASE WHEN page_id % 3 = 0 THEN 'IMAGE/JPEG; q=1' WHEN page_id % 3 = 1 THEN 'image/jpeg' ELSE 'text/html' END"


def _crawl(spark, sf):
    return b.read(spark, sf, "pages").withColumn("content_type", F.expr(TYPE))


@query(f"SELECT page_id, url FROM pages WHERE lower({TYPE}) LIKE 'image/jpeg%'")
def flt_mime(spark, sf):
    return files.crawl_images(_crawl(spark, sf)).select("page_id", "url")


@query("SELECT url, sha1(html) AS checksum, octet_length(encode(html))::BIGINT AS size FROM pages")
def src_crawl_segment(spark, sf):
    raw = F.col("html").cast("binary")
    return b.read(spark, sf, "pages").select("url", F.sha1(raw).alias("checksum"), F.octet_length(raw).cast("long").alias("size"))


@query("SELECT (row_number() OVER (ORDER BY n) - 1) AS old_id, n AS new_id FROM (SELECT unnest(range(0, 3000, 3)) AS n)")
def src_id_import(spark, sf):
    return files.mapping_from_vector(spark, list(range(0, 3000, 3)))


@query("SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events")
def src_json_lines(spark, sf):
    lines = b.read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("o"))
    return lines.select("event_id", "o.k")


@query("SELECT regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events WHERE regexp_extract(props, '([0-9]+)', 1)::BIGINT > 50")
def flt_user_expr(spark, sf):
    return files.json_lines(b.read(spark, sf, "events").select(F.col("props").alias("value")), "k bigint", "k > 50")


@query("SELECT regexp_extract(props, '([0-9]+)', 1)::BIGINT * 2 AS kk FROM events")
def prj_user_expr(spark, sf):
    return files.json_lines(b.read(spark, sf, "events").select(F.col("props").alias("value")), "k bigint", None, ["k * 2 AS kk"])


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events")
def snk_json(spark, sf):
    return b.read(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS clients FROM events GROUP BY ALL")
def snk_access_log(spark, sf):
    e = b.read(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("clients"))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, epoch_us(min(ts))::BIGINT AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def st_session_expire(spark, sf):
    got = st.sessions(b.read(spark, sf, "events"), "1 hour")
    return got.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n")


_HITS = f"WITH {b.SKETCHES}, {b.QUERY_SKETCHES}, hits AS MATERIALIZED (SELECT DISTINCT a.qid, b.id, a.qid // 10 AS ord FROM q a JOIN sk b ON ({b.HAMMING}) < 4 WHERE {' OR '.join(f'a.{w} = b.{w}' for w in links.WORDS)})"


@query(f"{_HITS} SELECT id, min(ord) AS first FROM hits WHERE ord < 25 GROUP BY id")
def st_progressive(spark, sf):
    sk = b.sketches(spark, sf)
    hits = links.probe(b.queries_of(sk), sk, links.WORD_KEYS).select("id", F.expr("qid div 10").alias("ord"))
    return st.progressive(hits, 25)


def _engine(spark, sf):
    sk = b.sketches(spark, sf)
    image = b.records(spark, sf).withColumnRenamed("key", "image_id")
    return Engine(sk, image, links.edges(sk)), b.queries_of(sk)


_SEEN = f"{_HITS}, seen AS (SELECT qid // 50 AS qid, id, min(qid) AS first FROM hits GROUP BY ALL), ranked AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY first, id) AS rank FROM seen)"


def _requests(q):
    """Five sketches make a query image."""
    return q.select(F.expr("qid div 50").alias("qid"), F.col("qid").alias("ord"), *links.WORDS)


@query(f"{_SEEN} SELECT qid, id, rank FROM ranked")
def search_upload(spark, sf):
    engine, q = _engine(spark, sf)
    return engine.search(_requests(q)).select("qid", "id", F.col("rank").cast("long"))


@query(f"{_SEEN} SELECT qid, id, rank FROM ranked WHERE rank > 2 AND rank <= 5")
def search_page(spark, sf):
    engine, q = _engine(spark, sf)
    return engine.page(engine.search(_requests(q)), 2, 3).select("qid", "id", F.col("rank").cast("long"))


@query(f"{_HITS}, seen AS (SELECT qid // 50 AS qid, id, min(qid) AS first FROM hits WHERE qid % 20 = 0 GROUP BY ALL) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY first, id) AS rank FROM seen")
def search_update(spark, sf):
    """The same queries under another predicate on their features."""
    engine, q = _engine(spark, sf)
    return engine.search(_requests(q), keep="ord % 20 = 0").select("qid", "id", F.col("rank").cast("long"))


@query(f"WITH {b.EDGES}, i AS (SELECT doc_id AS id FROM documents WHERE doc_id % 7 = 0), n AS (SELECT id AS qid, id, 0 AS o FROM i UNION ALL SELECT src, dst, 1 FROM edge WHERE src % 7 = 0) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY o, id) AS rank FROM n")
def search_local(spark, sf):
    engine, _ = _engine(spark, sf)
    ids = b.read(spark, sf, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))
    return engine.search_local(ids).select("qid", "id", F.col("rank").cast("long"))


@query()
def search_random(spark, sf):
    engine, _ = _engine(spark, sf)
    return engine.random_images(10, 42)


@query(f"{_SEEN}, n AS (SELECT qid, count(*) AS n, list(id ORDER BY rank) FILTER (WHERE rank <= 20) AS page FROM ranked GROUP BY qid), t AS (SELECT qid // 50 AS qid, count(*) AS total FROM q GROUP BY 1) SELECT qid, '{{\"done\":true,\"retrieve\":{{\"total\":' || total || ',\"done\":' || total || '}},\"num_results\":' || coalesce(n, 0) || ',\"page_offset\":0,\"page_count\":' || coalesce(len(page), 0) || ',\"page\":[' || coalesce(array_to_string(page, ','), '') || ']}}' AS body FROM t LEFT JOIN n USING (qid)")
def search_response(spark, sf):
    engine, q = _engine(spark, sf)
    req = _requests(q)
    return engine.response(req, engine.search(req))


@query(f"WITH {b.RECORDS} SELECT key AS image_id, width, height, size, url FROM rec WHERE key % 11 = 0")
def meta(spark, sf):
    image = b.records(spark, sf).withColumnRenamed("key", "image_id")
    ids = image.where("image_id % 11 = 0").select(F.col("image_id").alias("id"))
    return Engine(image, image).meta(ids).select("image_id", "width", "height", "size", "url")


@query(f"{_SEEN} SELECT r.qid, r.id, d.source FROM ranked r JOIN documents d ON d.doc_id = r.id WHERE rank <= 3")
def src_batch_client(spark, sf):
    """A batch of queries; each hit's follow-up lookup is a join."""
    engine, q = _engine(spark, sf)
    top = engine.page(engine.search(_requests(q)), 0, 3)
    return top.join(b.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id").select("qid", "id", "source")


@query(f"WITH {b.RECORDS} SELECT checksum, min(key) AS key FROM rec WHERE key % 5 = 0 GROUP BY checksum")
def src_records_by_sha1(spark, sf):
    rec = b.records(spark, sf)
    return rec.where("key % 5 = 0").groupBy("checksum").agg(F.min("key").alias("key"))


@query(f"WITH {b.RECORDS} SELECT key, checksum, '/record/' || substr(checksum, 1, 2) || '/' || checksum AS path FROM rec WHERE key < 100")
def src_records_by_id(spark, sf):
    return b.records(spark, sf).where("key < 100").select("key", "checksum", text.log_path(F.col("checksum")).alias("path"))


@query("SELECT rank, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents) WHERE rank BETWEEN 3 AND 5")
def src_records_by_demo(spark, sf):
    """Demo images by ordinal among the first ones listed."""
    first = b.read(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(10)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("doc_id")).cast("long")).where("rank between 3 and 5").select("rank", "doc_id")
