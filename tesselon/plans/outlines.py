"""Queries over contours of regions, instances of images that are segmented in tiles, and pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.operators import contours, labels, pyramid, segment
from tesselon.plans import rounds as R
from tesselon.plans import tables as T
from tesselon.plans.registry import query
from tesselon.sources import images

#: Four embeddings are an image of 16 by 16 pixels.
_IMAGE = "img AS (SELECT vec_id // 4 AS vec_id, (vec_id % 4 // 2 * 8 + i)::INT AS i, (vec_id % 2 * 8 + j)::INT AS j, v FROM px)"


def _image(spark, sf) -> DataFrame:
    part = F.pmod("vec_id", F.lit(4))
    at = lambda c, k: (F.col(c) + 8 * F.floor(k).cast("int")).alias(c)
    return T.pixels(spark, sf).select(F.floor(F.col("vec_id") / 4).alias("image"), at("i", part / 2), at("j", part % 2), "v")


#: Regions of v > 127 on images of 16 by 16 pixels, found by spreading the smallest place.
_REGIONS = f"""{T.PX}, {_IMAGE}, on_ AS (SELECT vec_id, i * 16 + j AS k, i, j FROM img WHERE v > 127),
spread AS (SELECT vec_id, k AS root, k, i, j FROM on_ UNION SELECT s.vec_id, s.root, o.k, o.i, o.j FROM spread s JOIN on_ o ON o.vec_id = s.vec_id AND abs(o.i - s.i) <= 1 AND abs(o.j - s.j) <= 1 AND o.k > s.root),
lowest AS (SELECT vec_id, k, i, j, min(root) AS root FROM spread GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_REGIONS} SELECT vec_id AS image, i, j, (root // 16)::INT AS ri, (root % 16)::INT AS rj FROM lowest")
def instances_across_tiles(spark, sf):
    """Regions of images of four tiles, found in tiles widened by two pixels and joined by what they share."""
    mask = _image(spark, sf).filter("v > 127").select("image", F.col("i"), F.col("j"))
    return segment.across_tiles(mask, "image", 8, 2, lambda px, keys: labels.tile_regions(px, keys), 0.0)


# In a window of two by two pixels the polygon through a region's pixels covers all of it if four of them
# are the region's, half if three are, and nothing otherwise. It is crossed by one step of a contour for
# three pixels, or two side by side, and by two steps for two that touch at a corner only.
_QUADS = """quads AS (SELECT vec_id, root, y, x, count(*) AS n, sum(1 << (2 * (i - y) + (j - x))) AS q FROM (SELECT vec_id, root, i, j, i - a AS y, j - b AS x FROM lowest, range(2) s(a), range(2) t(b)) GROUP BY ALL),
nets AS (SELECT vec_id, root, sum(CASE n WHEN 4 THEN 2 WHEN 3 THEN 1 ELSE 0 END) AS twice, sum(CASE WHEN n = 3 THEN 1 WHEN n = 2 THEN CASE WHEN q IN (6, 9) THEN 2 ELSE 1 END ELSE 0 END) AS steps,
  2 - floor(sum(CASE n WHEN 1 THEN 1 WHEN 3 THEN -1 WHEN 2 THEN CASE WHEN q IN (6, 9) THEN -2 ELSE 0 END ELSE 0 END) / 4) AS rings FROM quads GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_REGIONS}, {_QUADS}
SELECT vec_id AS image, (root // 16)::INT AS ri, (root % 16)::INT AS rj, rings::BIGINT AS contours, greatest(steps, 1)::BIGINT AS vertices, (twice / 2.0)::DOUBLE AS area FROM nets""")
def contour_areas(spark, sf):
    """Contours of each region, their vertices, and the area inside the outer one without those of the holes; tiles are 8 by 8."""
    mask = _image(spark, sf).filter("v > 127").select("image", "i", "j")
    area = F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))).alias("area")
    return contours.hierarchy(mask, "image", 8).groupBy("image", "ri", "rj").agg(F.count(F.lit(1)).alias("contours"), F.sum("vertices").alias("vertices"), area)


@query(f"""WITH RECURSIVE {_REGIONS}, {_QUADS} SELECT vec_id AS image, sum(steps)::BIGINT AS steps, sum(twice)::DOUBLE / 2 AS area FROM nets GROUP BY 1""")
def contour_vertices(spark, sf):
    """The steps of all contours of an image, counted from their vertices, and their areas by the shoelace formula."""
    mask = _image(spark, sf).filter("v > 127").select("image", "i", "j")
    _, vertices = contours.trace(mask, "image", 8)
    n = vertices.groupBy("image", "contour").agg(F.max("place").alias("last"))
    after = vertices.select("image", "contour", F.col("place").alias("_p"), F.col("i").alias("ni"), F.col("j").alias("nj"))
    steps = vertices.join(n, ["image", "contour"]).withColumn("_p", F.when(F.col("place") == F.col("last"), 0).otherwise(F.col("place") + 1)).join(after, ["image", "contour", "_p"])
    moved = F.count(F.when((F.col("i") != F.col("ni")) | (F.col("j") != F.col("nj")), 1)).alias("steps")
    return steps.groupBy("image").agg(moved, (F.sum(F.col("j") * F.col("ni") - F.col("nj") * F.col("i")).cast("double") / 2).alias("area"))


@query(f"""WITH {T.PX}, l0 AS (SELECT vec_id // 16 AS slide_id, (vec_id % 16 // 4 * 8 + i)::INT AS y, (vec_id % 4 * 8 + j)::INT AS x, v FROM px),
l1 AS (SELECT slide_id, y // 2 AS y, x // 2 AS x, (2 * sum(v) + count(*)) // (2 * count(*)) AS v FROM l0 GROUP BY ALL), l2 AS (SELECT slide_id, y // 2 AS y, x // 2 AS x, (2 * sum(v) + count(*)) // (2 * count(*)) AS v FROM l1 GROUP BY ALL)
SELECT slide_id, 0 AS level, y, x, v::INT AS v FROM l0 UNION ALL SELECT slide_id, 1, y, x, v::INT FROM l1 UNION ALL SELECT slide_id, 2, y, x, v::INT FROM l2""")
def pyramid_levels(spark, sf):
    """Slides of four by four tiles and two levels above; a slide without some of its tiles has uneven levels."""
    place = F.pmod("vec_id", F.lit(16))
    packed = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "v"))), lambda s: F.lpad(F.hex(s["v"].cast("long")), 2, "0")), ""))
    tiles = T.pixels(spark, sf).groupBy("vec_id").agg(packed.alias("image"))
    index = {"slide_id": F.floor(F.col("vec_id") / 16), "ti": F.floor(place / 4).cast("int"), "tj": F.pmod("vec_id", F.lit(4)).cast("int"), **{c: F.lit(n) for c, n in (("height", 8), ("width", 8), ("channels", 1))}}
    found = images.pixels(pyramid.levels(tiles.withColumns(index), 2, 1, (8, 8)), ("slide_id", "level", "ti", "tj"))
    side = lambda t, at: F.col(t) * 8 + F.col(at)
    return found.select("slide_id", "level", side("ti", "i").alias("y"), side("tj", "j").alias("x"), "v")
