"""Queries of the record layer, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfold import bindings as b
from nearfold.config import MAX_BINARY, MIN_SIZE_INDEX
from nearfold.functions import bits, text
from nearfold.operators import records as r
from nearfold.registry import query

BUCKET = "(((('0x' || substr(checksum, 1, 2))::BIGINT & 3) << 8) | xor(('0x' || substr(checksum, 3, 2))::BIGINT, 128))"
W = f"WITH {b.RECORDS}"
DENSE = f"img AS (SELECT *, row_number() OVER (ORDER BY {BUCKET}, checksum, key) - 1 AS image_id FROM rec)"


@query(f"{W} SELECT checksum, min(key) AS key, arg_min(width, key) AS width, arg_min(height, key) AS height, arg_min(size, key) AS size, array_to_string(list(url ORDER BY key), '|') AS urls FROM rec GROUP BY checksum")
def agg_merge_by_checksum(spark, sf):
    return r.merge_by_checksum(b.records(spark, sf)).withColumn("urls", F.array_join("urls", "|"))


@query(f"{W} SELECT {BUCKET} AS bucket, count(*)::BIGINT AS n FROM rec GROUP BY 1")
def agg_prefix_count(spark, sf):
    return r.bucket_counts(b.records(spark, sf))


@query(f"{W}, c AS (SELECT {BUCKET} AS bucket, count(*) AS n FROM rec GROUP BY 1) SELECT range AS bucket, coalesce(sum(n) OVER (ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM range(1024) LEFT JOIN c ON range = bucket")
def agg_prefix_sum(spark, sf):
    return r.bucket_starts(b.records(spark, sf))


@query(f"{W}, {DENSE} SELECT image_id, checksum, key FROM img")
def win_dense_id(spark, sf):
    return r.dense_ids(b.records(spark, sf)).select("image_id", "checksum", "key")


@query(f"{W}, {DENSE} SELECT image_id >> 8 AS container, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes, array_to_string(list(image_id ORDER BY image_id), ',') AS ids FROM img GROUP BY 1")
def agg_container(spark, sf):
    return r.containers(r.dense_ids(b.records(spark, sf))).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(f"{W} SELECT count(*)::BIGINT AS n_images, ((count(*) + 255) // 256)::BIGINT AS n_containers FROM rec")
def agg_total_images(spark, sf):
    return b.records(spark, sf).agg(F.count("*").alias("n_images"), F.expr("(count(*) + 255) div 256").alias("n_containers"))


@query(f"{W}, {DENSE} SELECT image_id, checksum, width, height, size FROM img WHERE image_id IN (5, 255, 256, 700)")
def join_meta_lookup(spark, sf):
    ids = [5, 255, 256, 700]
    img = r.dense_ids(b.records(spark, sf))
    found = img.where(bits.container(F.col("image_id")).isin(sorted({i >> 8 for i in ids})) & F.col("image_id").isin(ids))
    return found.select("image_id", "checksum", "width", "height", "size")


@query(f"{W}, {DENSE} SELECT image_id * 3 + 2 AS image_id, checksum FROM img")
def join_mapid(spark, sf):
    img = r.dense_ids(b.records(spark, sf)).select("image_id", "checksum")
    return r.map_ids(img, img.select(F.col("image_id").alias("old_id"), (F.col("image_id") * 3 + 2).alias("new_id"))).select("image_id", "checksum")


@query(f"{W} SELECT checksum, width, height, size, url, parent_url FROM rec")
def prj_strip_features(spark, sf):
    full = b.records(spark, sf).withColumn("regions", F.array(F.struct(F.lit(0.0).alias("x")))).withColumn("features", F.array(F.lit(b"0")))
    return full.drop("regions", "features", "key")


@query(f"{W} SELECT checksum, size FROM rec")
def prj_strip_regions(spark, sf):
    return b.records(spark, sf).withColumn("regions", F.array(F.lit(1.0))).drop("regions").select("checksum", "size")


@query(f"{W} SELECT key, url AS source_url, url AS source_parent FROM rec")
def prj_set_source(spark, sf):
    rec = b.records(spark, sf).withColumn("sources", F.array(F.struct(F.col("url"), F.col("url").alias("parent_url"))))
    return rec.select("key", F.col("sources")[0]["url"].alias("source_url"), F.col("sources")[0]["parent_url"].alias("source_parent"))


@query(f"{W} SELECT key, width, height FROM rec WHERE least(width, height) >= 50")
def flt_min_size(spark, sf):
    return b.records(spark, sf).where(r.min_size(F.col("width"), F.col("height"), MIN_SIZE_INDEX)).select("key", "width", "height")


@query(f"{W} SELECT key FROM rec WHERE size >= 300")
def flt_no_feature(spark, sf):
    rec = b.records(spark, sf).withColumn("features", F.when(F.col("size") >= 300, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return rec.where(F.size("features") > 0).select("key")


@query("SELECT event_id, try_cast(regexp_extract(props, '\"[a-z_]+\": ?\"?([0-9.]+)', 1) AS DOUBLE) AS v FROM events WHERE try_cast(regexp_extract(props, '\"[a-z_]+\": ?\"?([0-9.]+)', 1) AS DOUBLE) IS NOT NULL")
def flt_bad_record(spark, sf):
    v = F.regexp_extract("props", '"[a-z_]+": ?"?([0-9.]+)', 1).try_cast("double")
    return b.read(spark, sf, "events").select("event_id", v.alias("v")).where("v is not null")


@query("SELECT count(*) FILTER (WHERE length(text) < 100)::BIGINT AS bad, count(*) FILTER (WHERE length(text) > 5000)::BIGINT AS trimmed FROM documents")
def agg_counters(spark, sf):
    return b.read(spark, sf, "documents").agg(F.count_if(F.length("text") < 100).alias("bad"), F.count_if(F.length("text") > 5000).alias("trimmed"))


@query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE (rn - 1) % 10 = 0")
def smp_systematic(spark, sf):
    return r.systematic(b.read(spark, sf, "documents"), "doc_id", 10).select("doc_id", "text")


@query()
def smp_list(spark, sf):
    return b.read(spark, sf, "documents").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").limit(100)


@query(f"{W} SELECT DISTINCT checksum, substr(checksum, 1, 2) AS prefix FROM rec WHERE key % 2 = 1 AND checksum NOT IN (SELECT checksum FROM rec WHERE key % 2 = 0)")
def snk_query_log(spark, sf):
    rec = b.records(spark, sf)
    return r.insert_absent(rec.where("key % 2 = 1"), rec.where("key % 2 = 0")).select("checksum", F.substring("checksum", 1, 2).alias("prefix"))


@query(f"{W} SELECT DISTINCT checksum FROM rec WHERE key % 2 = 1 AND checksum NOT IN (SELECT checksum FROM rec WHERE key % 2 = 0) UNION ALL SELECT DISTINCT checksum FROM rec WHERE key % 2 = 0")
def join_cache_by_checksum(spark, sf):
    rec = b.records(spark, sf).select("key", "checksum")
    cached = rec.where("key % 2 = 0").select("checksum").distinct()
    return rec.where("key % 2 = 1").select("checksum").distinct().join(cached, "checksum", "left_anti").unionByName(cached)


# --- scalar functions ---


@query(f"WITH {b.SKETCHES} SELECT id, {b.SKETCH_HEX} AS sk, substr({b.SKETCH_HEX}, 9) || substr({b.SKETCH_HEX}, 1, 8) AS rot FROM sk")
def fn_rotate(spark, sf):
    return b.sketches(spark, sf).withColumn("sk", bits.sketch_hex()).select("id", "sk", bits.rotate(F.col("sk"), 32).alias("rot"))


@query(f"WITH {b.SKETCHES} SELECT id, {b.SKETCH_HEX} AS back FROM sk")
def fn_unrotate(spark, sf):
    return b.sketches(spark, sf).select("id", bits.unrotate(bits.rotate(bits.sketch_hex(), 40), 40).alias("back"))


@query(f"WITH {b.SKETCHES} SELECT a.id, ({b.HAMMING})::BIGINT AS d FROM sk a JOIN sk b ON b.id = a.id + 1")
def fn_hamming(spark, sf):
    sk = b.sketches(spark, sf)
    return sk.alias("a").join(sk.alias("b"), F.col("b.id") == F.col("a.id") + 1).select(F.col("a.id").alias("id"), bits.hamming().alias("d"))


@query(f"WITH {b.SKETCHES} SELECT id, (('0x' || substr({b.SKETCH_HEX}, 2, 8))::BIGINT >> 2) & 4095 AS win, ((('0x' || substr({b.SKETCH_HEX}, 31, 2) || substr({b.SKETCH_HEX}, 1, 1))::BIGINT >> 1) & 255) AS wrap FROM sk")
def fn_bit_window(spark, sf):
    sk = b.sketches(spark, sf).withColumn("sk", bits.sketch_hex())
    return sk.select("id", bits.bit_window(F.col("sk"), 22, 12).alias("win"), bits.bit_window(F.col("sk"), 123, 8).alias("wrap"))


@query(f"WITH {b.SKETCHES} SELECT id, {', '.join(f'({s})::BIGINT AS k{i}' for i, s in enumerate(b.split_sql()))} FROM sk")
def fn_sketch_split(spark, sf):
    return b.sketches(spark, sf).select("id", *[c.alias(f"k{i}") for i, c in enumerate(bits.sketch_split())])


@query(f"WITH {b.SKETCHES} SELECT id, w0 & 16777215 AS p0, (w0 >> 24) | ((w1 & 65535) << 8) AS p1, (w1 >> 16) | ((w2 & 255) << 16) AS p2, w2 >> 8 AS p3 FROM sk")
def fn_manku_block(spark, sf):
    return b.sketches(spark, sf).select("id", *[c.alias(f"p{i}") for i, c in enumerate(bits.second_level(3))])


@query(f"WITH {b.SKETCHES} SELECT id, (('0x' || substr({b.SKETCH_HEX}, 1, 4))::BIGINT * 100) >> 16 AS part FROM sk")
def fn_range_partition16(spark, sf):
    return b.sketches(spark, sf).select("id", bits.range_partition16(bits.sketch_hex(), 100).alias("part"))


@query(f"{W} SELECT key, {BUCKET} AS bucket FROM rec")
def fn_checksum_bucket(spark, sf):
    return b.records(spark, sf).select("key", bits.checksum_bucket(F.col("checksum")).alias("bucket"))


@query(f"{W} SELECT key, checksum FROM rec")
def fn_sha1(spark, sf):
    return b.records(spark, sf).select("key", "checksum")


@query("SELECT doc_id, lower(hex(encode(source))) AS h, source AS back, NULL::VARCHAR AS odd FROM documents")
def fn_hex(spark, sf):
    h = F.lower(F.hex(F.col("source").cast("binary")))
    return b.read(spark, sf, "documents").select("doc_id", h.alias("h"), bits.safe_unhex(F.upper(h)).cast("string").alias("back"), bits.safe_unhex(F.concat(h, F.lit("a"))).cast("string").alias("odd"))


@query("SELECT doc_id, length(source)::BIGINT AS n_bytes, (length(source) % 2 = 0) AS ok FROM documents")
def fn_unhex(spark, sf):
    raw = bits.safe_unhex(F.translate("source", "srclog", "abcdef"))
    return b.read(spark, sf, "documents").select("doc_id", F.length("source").cast("long").alias("n_bytes"), raw.isNotNull().alias("ok"))


@query("SELECT doc_id, doc_id >> 8 AS container, doc_id & 255 AS off, doc_id AS id FROM documents")
def fn_make_id(spark, sf):
    c, o = bits.container(F.col("doc_id")), bits.offset(F.col("doc_id"))
    return b.read(spark, sf, "documents").select("doc_id", c.alias("container"), o.alias("off"), bits.make_id(c, o).alias("id"))


@query("SELECT doc_id, doc_id >> 8 AS container FROM documents")
def fn_container(spark, sf):
    return b.read(spark, sf, "documents").select("doc_id", bits.container(F.col("doc_id")).alias("container"))


@query("SELECT doc_id, doc_id & 255 AS off FROM documents")
def fn_offset(spark, sf):
    return b.read(spark, sf, "documents").select("doc_id", bits.offset(F.col("doc_id")).alias("off"))


@query(f"SELECT doc_id, printf('%08x', doc_id) AS big, {b.hex_sql('doc_id')} AS little FROM documents")
def fn_encode(spark, sf):
    """32-bit ids as hex bytes in both orders."""
    big = F.lpad(F.lower(F.hex("doc_id")), 8, "0")
    return b.read(spark, sf, "documents").select("doc_id", big.alias("big"), bits.word_hex(F.col("doc_id")).alias("little"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 NOT IN (1, 2)")
def flt_path(spark, sf):
    """Files whose name starts with an underscore or a dot are passed over."""
    name = F.concat(F.element_at(F.array(F.lit("part-"), F.lit("_"), F.lit("."), F.lit("x_"), F.lit("y.")), (F.col("doc_id") % 5 + 1).cast("int")), F.col("doc_id").cast("string"))
    return b.read(spark, sf, "documents").where(~name.rlike("^[_.]")).select("doc_id")


@query(f"{W} SELECT key, CASE WHEN url LIKE '%.jpg' THEN 'image/jpeg' WHEN url LIKE '%.html' THEN 'text/html' ELSE 'test/plain' END AS mime FROM rec")
def fn_mime(spark, sf):
    return b.records(spark, sf).select("key", text.mime(F.col("url")).alias("mime"))


@query(f"{W} SELECT key, '/record/' || substr(checksum, 1, 2) || '/' || checksum AS path FROM rec")
def fn_log_path(spark, sf):
    return b.records(spark, sf).select("key", text.log_path(F.col("checksum")).alias("path"))


@query("SELECT page_id, regexp_extract(url, '://[^/:?#]*?([^./:?#]+\\.[^./:?#]+)(?:[/:?#]|$)', 1) AS short FROM pages")
def fn_short_url(spark, sf):
    return b.read(spark, sf, "pages").select("page_id", text.short_url(F.col("url")).alias("short"))


@query("SELECT doc_id, CASE WHEN contains(lang || ',zh', 'zh') AND doc_id % 2 = 0 THEN '/cn.html' ELSE '/index.html' END AS page FROM documents")
def fn_lang_route(spark, sf):
    accept = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(",zh"))).otherwise(F.col("lang"))
    return b.read(spark, sf, "documents").select("doc_id", text.lang_route(accept).alias("page"))


@query("SELECT doc_id, coalesce(try_cast(CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR WHEN doc_id % 3 = 1 THEN source ELSE NULL END AS INTEGER), 20) AS n FROM documents")
def fn_param_cast(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, F.col("source"))
    return b.read(spark, sf, "documents").select("doc_id", text.param(raw, "int", 20).alias("n"))


@query("SELECT doc_id, doc_id::VARCHAR || ',' || n_chars::VARCHAR AS ids FROM documents")
def fn_json_page_ids(spark, sf):
    made = F.to_json(F.struct(F.lit(True).alias("done"), F.array("doc_id", "n_chars").alias("page")))
    return b.read(spark, sf, "documents").select("doc_id", F.array_join(text.page_ids(made).cast("array<string>"), ",").alias("ids"))


@query("SELECT doc_id, '{\"id\":' || doc_id || ',\"tags\":[\"' || lang || '\",\"' || source || '\"]}' AS j FROM documents")
def fn_array2json(spark, sf):
    return b.read(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), F.array("lang", "source").alias("tags"))).alias("j"))


@query("SELECT doc_id, source || '/' || doc_id::VARCHAR AS fg FROM documents")
def fn_fg_id(spark, sf):
    return b.read(spark, sf, "documents").select("doc_id", text.first_component(F.concat("source", F.lit("/x/y.jpg")), F.col("doc_id")).alias("fg"))


@query(f"WITH {b.SKETCHES} SELECT id, {b.SKETCH_HEX} AS sk FROM sk")
def fn_print_hex(spark, sf):
    return b.sketches(spark, sf).select("id", bits.sketch_hex().alias("sk"))


@query("SELECT CASE WHEN 1 = 1 THEN doc_id END AS doc_id, length(text)::BIGINT AS n FROM documents WHERE octet_length(encode(text)) <= 104857600")
def src_records_by_upload(spark, sf):
    d = b.read(spark, sf, "documents").where(F.octet_length("text") <= MAX_BINARY)
    return d.select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 200")
def top_features(spark, sf):
    """Groups of at least 200 keep their 200 largest; smaller ones stay whole."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return b.read(spark, sf, "documents").select("doc_id", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 200")
