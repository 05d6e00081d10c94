"""Record, sketch, feature and graph views of the given tables, in DataFrame
form and, for the oracle, as DuckDB common table expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions import bits, vectors
from nearfold.functions.bits import WORDS

VECTOR_SCALE = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media records: one for each document; key is the import order."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("key"), F.sha1(F.col("text").cast("binary")).alias("checksum"),
        (F.col("doc_id") * 7 % 90 + 10).alias("width"), (F.col("doc_id") * 13 % 110 + 5).alias("height"), F.octet_length("text").cast("long").alias("size"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".jpg").when(F.col("doc_id") % 3 == 1, ".html").otherwise("")).alias("url"), F.col("source").alias("parent_url"),
    )


RECORDS = """rec AS (SELECT doc_id AS key, sha1(text) AS checksum, doc_id * 7 % 90 + 10 AS width, doc_id * 13 % 110 + 5 AS height, octet_length(encode(text))::BIGINT AS size,
 source || '/' || doc_id::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN '.jpg' WHEN doc_id % 3 = 1 THEN '.html' ELSE '' END AS url, source AS parent_url FROM documents)"""


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, w0..w3: 128-bit SimHash of each document's words (md5 of a word gives its 128 signs).

    One aggregation with map-side partial sums; no row per bit.  Each sum
    counts two bits, 32 places apart, in the halves of a long.
    """
    d = read(spark, sf_dir, "documents")
    words = d.select(F.col("doc_id").alias("id"), F.explode(F.split(F.trim(F.lower("text")), r"\s+")).alias("t")).where("t <> ''").withColumn("h", F.md5(F.col("t").cast("binary")))
    halves = words.select("id", *[F.conv(F.substring("h", 16 * k + 1, 16), 16, -10).cast("long").alias(f"a{k}") for k in range(2)])
    both = F.lit(1 << 32 | 1)
    sums = halves.groupBy("id").agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned(f"a{k}", i).bitwiseAND(both)).alias(f"s{k}_{i}") for k in range(2) for i in range(32)])

    def word(k: int):
        ones = (lambda i: F.shiftrightunsigned(f"s{k // 2}_{i}", 32)) if k % 2 == 0 else (lambda i: F.col(f"s{k // 2}_{i}").bitwiseAND(F.lit((1 << 32) - 1)))
        return reduce(add, [F.when(2 * ones(i) > F.col("n"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(32)])

    return sums.select("id", *[word(k).alias(f"w{k}") for k in range(4)])


def _sketch_sql() -> str:
    sums = ", ".join(f"sum(((a{k} >> {i}) & 1) * 2 - 1) AS s{k}_{i}" for k in range(4) for i in range(32))
    word = ", ".join("(" + " + ".join(f"CASE WHEN s{k}_{i} > 0 THEN {1 << i} ELSE 0 END" for i in range(32)) + f")::BIGINT AS w{k}" for k in range(4))
    heads = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS a{k}" for k in range(4))
    return f"""tok AS (SELECT id, t, md5(t) AS h FROM (SELECT doc_id AS id, unnest(string_split_regex(trim(lower(text)), '\\s+')) AS t FROM documents) WHERE t <> ''),
sums AS (SELECT id, {sums} FROM (SELECT id, {heads} FROM tok) GROUP BY id),
sk AS MATERIALIZED (SELECT id, {word} FROM sums)"""


SKETCHES = _sketch_sql()
HAMMING = " + ".join(f"bit_count(xor(a.{w}, b.{w}))" for w in WORDS)


def hex_sql(word: str) -> str:
    return "(" + " || ".join(f"substr(printf('%08x', {word}), {i}, 2)" for i in (7, 5, 3, 1)) + ")"


SKETCH_HEX = " || ".join(hex_sql(w) for w in WORDS)


def queries_of(sk: DataFrame) -> DataFrame:
    """Query sketches: every tenth, with one to three bits flipped."""
    d = F.col("id")
    flip0 = F.call_function("shiftleft", F.lit(1).cast("long"), (d % 31).cast("int"))
    return sk.where(d % 10 == 0).select(
        d.alias("qid"), F.col("w0").bitwiseXOR(flip0).alias("w0"), F.when(F.expr("id div 10 % 3 >= 1"), F.col("w1").bitwiseXOR(F.lit(4).cast("long"))).otherwise(F.col("w1")).alias("w1"),
        F.when(F.expr("id div 10 % 3 = 2"), F.col("w2").bitwiseXOR(F.lit(128).cast("long"))).otherwise(F.col("w2")).alias("w2"), "w3",
    )


QUERY_SKETCHES = """q AS (SELECT id AS qid, xor(w0, (1::BIGINT << (id % 31)::INT)) AS w0, CASE WHEN id // 10 % 3 >= 1 THEN xor(w1, 4::BIGINT) ELSE w1 END AS w1,
 CASE WHEN id // 10 % 3 = 2 THEN xor(w2, 128::BIGINT) ELSE w2 END AS w2, w3 FROM sk WHERE id % 10 = 0)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local features: five vectors make an image; region by a fixed formula; descriptor as integers."""
    e = read(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    return e.select(
        F.expr("vec_id div 5").alias("image_id"), (v % 5).alias("ord"), v.alias("vec_id"), (v * 37 % 250).alias("x"), (v * 53 % 200).alias("y"), (v * 11 % 40 + 1).alias("r"), "label", "embedding",
        vectors.quantized(F.col("embedding"), VECTOR_SCALE).alias("desc"),
    )


FEATURES = f"""feat AS MATERIALIZED (SELECT vec_id // 5 AS image_id, vec_id % 5 AS ord, vec_id, vec_id * 37 % 250 AS x, vec_id * 53 % 200 AS y, vec_id * 11 % 40 + 1 AS r, label, embedding,
 list_transform(embedding, lambda e: floor(e::DOUBLE * {VECTOR_SCALE} + 0.5)::BIGINT) AS \"desc\" FROM embeddings)"""


def split_sql(prefix: str = "") -> list[str]:
    """The three block keys as SQL."""
    p = prefix
    return [f"((({p}w3 & 2047) << 32) + {p}w0) << 2", f"(((({p}w3 >> 11) & 2047) << 32) + {p}w1) << 2 | 1", f"((({p}w3 >> 22) << 32) + {p}w2) << 2 | 2"]


EDGES = f"""{SKETCHES},
keys AS MATERIALIZED (SELECT sk.*, unnest([{', '.join(split_sql())}]) AS k FROM sk),
edge AS MATERIALIZED (WITH p AS (SELECT DISTINCT a.id AS x, b.id AS y FROM keys a JOIN keys b ON a.k = b.k AND a.id < b.id WHERE {HAMMING} < 3)
 SELECT x AS src, y AS dst FROM p UNION ALL SELECT y, x FROM p)"""
