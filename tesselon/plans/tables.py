"""Image tables derived from the driver's tables, in Spark and as SQL fragments.

An embedding of 64 numbers is a tile of 8 by 8 grey pixels, three numbers in a row are an RGB pixel of
a strip of 21; orders are slides, their line items tiles; events are measurements of objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, i, j, v)"""
    flat = read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    return flat.select("vec_id", F.floor(F.col("p") / 8).cast("int").alias("i"), (F.col("p") % 8).alias("j"), F.floor((F.col("x").cast("double") + 1) * 127.5).alias("v"))


def rgb(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, j, r, g, b), stretched so that all colours occur"""
    e = read(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("j"))
    c = lambda k: F.least(F.greatest(F.floor((F.col("embedding")[F.col("j") * 3 + k].cast("double") + 0.3) * 425.0), F.lit(0)), F.lit(255))
    return e.select("vec_id", "j", *(c(k).alias(n) for k, n in enumerate("rgb")))


def instances(spark: SparkSession, sf: str) -> DataFrame:
    """(graph_id, i, j, label, v): ten tiles of a label side by side are one image with up to four objects a tile"""
    px = pixels(spark, sf)
    label = F.when(F.col("v") > 127, (F.col("vec_id") * 4 + F.floor(F.col("i") / 4) * 2 + F.floor(F.col("j") / 4)) % 5 + 1).otherwise(0)
    return px.select(F.col("vec_id").alias("graph_id"), "i", "j", label.cast("long").alias("label"), "v")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """(graph_id, node, x, y): one graph a label"""
    at = lambda k: F.floor(F.col("embedding")[k].cast("double") * 1000)
    return read(spark, sf, "embeddings").select(F.col("label").cast("long").alias("graph_id"), F.col("vec_id").alias("node"), at(0).alias("x"), at(1).alias("y"))


def slides(spark: SparkSession, sf: str, *labels: Column) -> DataFrame:
    """(slide_id, height, width), and ``labels`` of the orders."""
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("slide_id"), (256 + F.col("o_orderkey") % 700).cast("int").alias("height"), (256 + (F.col("o_orderkey") * 7) % 500).cast("int").alias("width"), *labels)


PX = """px AS (SELECT vec_id, ((p - 1) // 8)::INT AS i, ((p - 1) % 8)::INT AS j, floor((x::DOUBLE + 1) * 127.5)::BIGINT AS v
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings))"""
RGB = """rgb AS (SELECT vec_id, j::INT AS j, least(greatest(floor((embedding[j * 3 + 1]::DOUBLE + 0.3) * 425.0), 0), 255)::BIGINT AS r,
  least(greatest(floor((embedding[j * 3 + 2]::DOUBLE + 0.3) * 425.0), 0), 255)::BIGINT AS g, least(greatest(floor((embedding[j * 3 + 3]::DOUBLE + 0.3) * 425.0), 0), 255)::BIGINT AS b
  FROM embeddings, range(21) t(j))"""
INST = PX + """, inst AS (SELECT vec_id AS graph_id, i, j, v, (CASE WHEN v > 127 THEN (vec_id * 4 + (i // 4) * 2 + j // 4) % 5 + 1 ELSE 0 END)::BIGINT AS label FROM px)"""
POINTS = """pts AS (SELECT label::BIGINT AS graph_id, vec_id AS node, floor(embedding[1]::DOUBLE * 1000)::BIGINT AS x, floor(embedding[2]::DOUBLE * 1000)::BIGINT AS y FROM embeddings)"""
SLIDES = """slides AS (SELECT o_orderkey AS slide_id, (256 + o_orderkey % 700)::INT AS height, (256 + (o_orderkey * 7) % 500)::INT AS width FROM orders)"""
KNN = POINTS + """, knn AS (SELECT graph_id, src, dst, d FROM (
  SELECT a.graph_id, a.node AS src, b.node AS dst, sqrt((a.x - b.x)::DOUBLE * (a.x - b.x) + (a.y - b.y)::DOUBLE * (a.y - b.y)) AS d,
    row_number() OVER (PARTITION BY a.graph_id, a.node ORDER BY sqrt((a.x - b.x)::DOUBLE * (a.x - b.x) + (a.y - b.y)::DOUBLE * (a.y - b.y)), b.node) AS r
  FROM pts a JOIN pts b ON a.graph_id = b.graph_id AND a.node <> b.node) WHERE r <= 5)"""
#: Offsets of the eight neighbours.
AROUND = "(SELECT a, b FROM range(-1, 2) x(a), range(-1, 2) y(b) WHERE a <> 0 OR b <> 0)"
