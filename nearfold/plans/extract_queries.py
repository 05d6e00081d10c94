"""Queries of binary formats and of extraction on rasters made from vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from nearfold import bindings as b
from nearfold.functions import sift, vectors
from nearfold.operators import extract, graph, kernels, links
from nearfold.registry import query
from nearfold.sources import files

#: Height and width of a raster.
SIDE = 64
IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def raster_of(v: np.ndarray) -> np.ndarray:
    """64 x 64 gray picture of 64 values: smooth hills on an 8 x 8 grid with a fine pattern."""
    v = np.asarray(v, np.float64).reshape(8, 8)
    big = sift.smooth(np.kron(v, np.ones((8, 8))), 2.0)
    fine = np.kron(v[::-1], np.ones((2, 2)))
    img = 128 + 300 * big + 120 * sift.smooth(np.tile(fine, (4, 4)), 1.0)
    return np.clip(img, 0, 255).astype(np.uint8)


def images(spark, sf):
    """Every vector as a row of the image source's shape."""

    def make(batches):
        for pdf in batches:
            yield pd.DataFrame({"image": [{"origin": f"vec/{i}", "height": SIDE, "width": SIDE, "nChannels": 1, "mode": 0, "data": raster_of(v).tobytes()} for i, v in zip(pdf["vec_id"], pdf["embedding"])]})

    return b.read(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(make, IMAGE)


@query()
def fx_extract(spark, sf):
    got = extract.extract(images(spark, sf))
    return got.select("url", F.lower(F.hex("checksum")).alias("checksum"), "width", "height", "size", F.size("regions").alias("n_regions"), F.size("features").alias("n_features"))


@query("SELECT 'vec/' || vec_id::VARCHAR AS url, 64 AS width, 64 AS height FROM embeddings")
def src_image_decode(spark, sf):
    return images(spark, sf).select(F.col("image.origin").alias("url"), "image.width", "image.height")


@query()
def snk_image_encode(spark, sf):
    return extract.extract(images(spark, sf)).select("url", F.lower(F.hex(F.substring("thumbnail", 2, 3))).alias("magic"), F.octet_length("thumbnail").alias("n_bytes"))


def _stat(name, f):
    """A query that gives count, mean and spread of what ``f`` makes of each raster."""

    def rows(batches):
        for pdf in batches:
            out = []
            for im in pdf["image"]:
                v = np.asarray(f(np.frombuffer(im["data"], np.uint8).reshape(im["height"], im["width"]).astype(np.float64)), np.float64).ravel()
                out.append((im["origin"], len(v), round(float(v.mean()), 4) if len(v) else 0.0, round(float(v.std()), 4) if len(v) else 0.0))
            yield pd.DataFrame(out, columns=["url", "n", "mean", "sd"])

    query(name=name)(lambda spark, sf: images(spark, sf).mapInPandas(rows, "url string, n long, mean double, sd double"))


_stat("fx_gray", sift.gray)
_stat("fx_smooth", lambda im: sift.smooth(im, 1.6))
_stat("fx_gradient", lambda im: sift.gradient(im)[0])
_stat("fx_sift_scale_space", lambda im: np.concatenate([x.ravel() for o in sift.scale_space(im) for x in o]))
_stat("fx_sift_detect", lambda im: [k for o in sift.scale_space(im) for k in sift.extrema(o, 1.0)] or [0])
_stat("fx_sift_orientation", lambda im: [k[-1] / (2 * np.pi) for k in sift.keypoints(im, 1.0)])
_stat("fx_sift_descriptor", lambda im: [f[4] for f in sift.extract(im, 1.0, 0)] or [0])


@query(f"WITH {b.EDGES} SELECT src, dst FROM edge")
def src_graph_load(spark, sf):
    """The graph file written and parsed again."""

    def parse(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, n) for body in pdf["body"] for i, ns in files.parse_graph(body) for n in ns], columns=["src", "dst"])

    return files.graph_bytes(graph.adjacency(links.edges(b.sketches(spark, sf)))).select("body").mapInPandas(parse, "src long, dst long")


@query(f"WITH {b.RECORDS} SELECT checksum AS k, url AS v FROM rec")
def src_record_stream(spark, sf):
    """Framed key and value pairs written and parsed again, one stream a batch."""

    def trip(batches):
        for pdf in batches:
            body = files.frame([(k.encode(), v.encode()) for k, v in zip(pdf["checksum"], pdf["url"])])
            yield pd.DataFrame([(k.decode(), v.decode()) for k, v in files.unframe(body)], columns=["k", "v"])

    return b.records(spark, sf).select("checksum", "url").mapInPandas(trip, "k string, v string")


@query(f"WITH {b.RECORDS} SELECT count(*)::BIGINT AS n, sum(octet_length(encode(checksum)) + octet_length(encode(url)) + 8)::BIGINT AS n_bytes FROM rec")
def src_seqfile_import(spark, sf):
    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)], "n_bytes": [len(files.frame([(k.encode(), v.encode()) for k, v in zip(pdf["checksum"], pdf["url"])]))]})

    got = b.records(spark, sf).select("checksum", "url").mapInPandas(sizes, "n long, n_bytes long")
    return got.agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"))


@query(f"WITH {b.FEATURES} SELECT vec_id, x, y, r, \"desc\"[1] AS d0, \"desc\"[64] AS d63 FROM feat")
def src_text_features(spark, sf):
    """Tab-separated features made and parsed again."""
    line = F.concat_ws("\t", "vec_id", "x", "y", "r", F.array_join(F.col("desc").cast("array<string>"), "\t"))
    v = F.split(line, "\t")
    names = ["vec_id", "x", "y", "r"]
    return b.features(spark, sf).select(*[v[i].cast("long").alias(n) for i, n in enumerate(names)], v[4].cast("long").alias("d0"), v[67].cast("long").alias("d63"))


@query("SELECT r_regionkey::INTEGER AS r_regionkey, true AS whole FROM region")
def src_file_list(spark, sf):
    """Whole files: the region table's, beside its rows."""
    whole = files.read_blobs(spark, f"{sf}/region.parquet").agg(F.min((F.octet_length("content") == F.col("length")).cast("int")).alias("w"))
    return b.read(spark, sf, "region").crossJoin(whole).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), (F.col("w") == 1).alias("whole"))


_DIMS = range(0, 128, 16)


def _proj(v: str, j: int) -> str:
    return "(" + " + ".join(f"{v}[{i + 1}] * {((i * 31 + j * 17 + i * i) % 101) - 50}" for i in range(64)) + ")"


def _projected(spark, sf):
    """Vectors after a linear projection, whose matrix is given (here a fixed formula)."""
    coef = lambda j: F.array(*[F.lit(((i * 31 + j * 17 + i * i) % 101) - 50).cast("long") for i in range(64)])
    dot = lambda j: F.aggregate(F.zip_with("desc", coef(j), lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    return b.features(spark, sf).select("vec_id", "image_id", F.array(*[dot(j) for j in _DIMS]).alias("v"))


@query(f"WITH {b.FEATURES} SELECT vec_id, " + ", ".join(f"({_proj(chr(34) + 'desc' + chr(34), j)})::BIGINT AS p{k}" for k, j in enumerate(_DIMS)) + " FROM feat")
def fx_pca(spark, sf):
    return _projected(spark, sf).select("vec_id", *[F.col("v")[k].alias(f"p{k}") for k in range(len(_DIMS))])


@query(
    f"WITH {b.FEATURES}, p AS MATERIALIZED (SELECT vec_id, image_id, [" + ", ".join(_proj('"desc"', j) for j in _DIMS) + "] AS v FROM feat) SELECT q.image_id AS q, i.image_id AS i, floor(sqrt(("
    + " + ".join(f"(q.v[{j + 1}] - i.v[{j + 1}]) * (q.v[{j + 1}] - i.v[{j + 1}])" for j in range(len(_DIMS)))
    + ")::BIGINT) / 20000)::BIGINT AS d, count(*)::BIGINT AS n FROM p q, p i WHERE q.image_id % 20 = 0 AND q.image_id <> i.image_id GROUP BY ALL"
)
def join_theta_pca(spark, sf):
    """Distances after the projection."""
    pairs = kernels.image_pairs(_projected(spark, sf), "image_id % 20 = 0", "true")
    return kernels.histogram(pairs, F.floor(F.sqrt(vectors.l2sqr(F.col("q_v"), F.col("i_v"))) / 20000), 1 << 40)
