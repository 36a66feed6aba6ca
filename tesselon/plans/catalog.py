"""The registered image queries and, beside each, its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions import color
from tesselon.lineage import shared_dir
from tesselon.operators import graph, grid, infer, labels, metrics, point, quantify, stain, stencil, threshold
from tesselon.plans import datasets as _datasets
from tesselon.plans import outlines as _outlines
from tesselon.plans import rounds as R
from tesselon.plans import segments as _segments
from tesselon.plans import tables as T
from tesselon.plans.registry import ORACLE_SQL, QUERIES, query, rounded
from tesselon.sources import store
from tesselon.streaming import arrivals

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "_datasets", "_outlines", "_segments"]

_r = rounded


# ---- flagship: mean intensity per object in the tiles that are not mostly white


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    px = T.pixels(spark, sf)
    white = px.groupBy("vec_id").agg((F.avg((F.col("v") > 135).cast("int")) > 0.5).alias("white")).filter("white")
    kind = T.read(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    kept = px.join(white, "vec_id", "left_anti").join(kind, "vec_id")
    return quantify.quantify(kept.withColumn("label", F.col("label") + 1), (), ("v",)).select("label", "area", _r("mean_v"), "min_v", "max_v")


@query(f"""WITH {T.PX}, white AS (SELECT vec_id FROM px GROUP BY vec_id HAVING avg((v > 135)::INT) > 0.5)
SELECT label::BIGINT + 1 AS label, count(*)::BIGINT AS area, round(avg(v), 6) AS mean_v, min(v) AS min_v, max(v) AS max_v
FROM px JOIN embeddings USING (vec_id) WHERE vec_id NOT IN (SELECT vec_id FROM white) GROUP BY label""")
def intensity_of_objects(spark, sf):
    return flagship(spark, sf)


# ---- grids, frames, masks


def _grid_sql(pad: bool) -> str:
    n = lambda side: f"greatest(CASE WHEN {str(pad).upper()} AND {side} % 200 <> 0 THEN floor({side} / 200.0) + 1 ELSE floor(({side} - 224) / 200.0) + 1 END, 0)::INT"
    return f"""WITH {T.SLIDES}, n AS (SELECT slide_id, {n("height")} AS ni, {n("width")} AS nj FROM slides)
SELECT slide_id, (i * 200)::INT AS tile_i, (j * 200)::INT AS tile_j FROM n, range(6) a(i), range(6) b(j) WHERE i < ni AND j < nj"""


@query(_grid_sql(False))
def tile_grid_nopad(spark, sf):
    return grid.tile_grid(T.slides(spark, sf), (224, 224), (200, 200)).select("slide_id", "tile_i", "tile_j")


@query(_grid_sql(True))
def tile_grid_pad(spark, sf):
    return grid.tile_grid(T.slides(spark, sf), (224, 224), (200, 200), pad=True).select("slide_id", "tile_i", "tile_j")


@query(f"""WITH {T.SLIDES} SELECT slide_id, (i * 100)::INT AS tile_i, (j * 100)::INT AS tile_j FROM slides, range(10) a(i), range(8) b(j)
WHERE i < (height - 100) // 100 + 1 AND j < (width - 100) // 100 + 1 AND i * 100 >= 150 AND i * 100 < 450 AND j * 100 >= 100 AND j * 100 < 300""")
def tile_grid_in_box(spark, sf):
    return grid.tile_grid(T.slides(spark, sf), (100, 100), box=(150, 100, 450, 300)).select("slide_id", "tile_i", "tile_j")


@query("""SELECT l_orderkey AS idx, (l_orderkey // 7) * 500 AS i, (l_orderkey % 7) * 500 AS j, l_orderkey AS idx_back, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey""")
def dicom_index_coords(spark, sf):
    items = T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    i, j = grid.frame_coords(F.col("idx"), F.lit(7), 500, 500)
    return items.select("idx", i.alias("i"), j.alias("j"), grid.frame_index(i, j, F.lit(7), 500, 500).alias("idx_back"), "n")


_EXTENSIONS = (".h5path", ".svs", ".ome.tif", ".dcm", ".scn", ".TIF", ".png")


@query(f"""WITH f AS (SELECT page_id, url || (ARRAY{list(_EXTENSIONS)})[1 + page_id % 7] AS path FROM pages)
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'h5path' WHEN 1 THEN 'openslide' WHEN 2 THEN 'bioformats' WHEN 3 THEN 'dicom' WHEN 4 THEN 'bioformats' WHEN 6 THEN 'bioformats' END AS backend FROM f""")
def infer_backend(spark, sf):
    names = F.array(*map(F.lit, _EXTENSIONS))
    pages = T.read(spark, sf, "pages").select("page_id", F.concat("url", F.element_at(names, (F.col("page_id") % 7 + 1).cast("int"))).alias("path"))
    return pages.select("page_id", grid.infer_backend(F.col("path")).alias("backend"))


@query("""SELECT p_partkey, (p_size * power(1000, p_partkey % 4))::BIGINT AS bytes FROM part""")
def file_sizes(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ("B", "kb", "MB", "GB"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return T.read(spark, sf, "part").select("p_partkey", grid.parse_file_size(F.concat_ws(" ", "p_size", unit)).alias("bytes"))


@query(f"""WITH {T.PX} SELECT vec_id, i - 2 AS i, j - 3 AS j, v FROM px WHERE i BETWEEN 2 AND 5 AND j BETWEEN 3 AND 5""")
def region_read(spark, sf):
    return grid.region(T.pixels(spark, sf), 2, 3, 4, 3)


@query(f"""WITH {T.PX} SELECT vec_id, (i // 2)::INT AS i, (j // 2)::INT AS j, avg(v) AS v FROM px GROUP BY ALL""")
def thumbnail(spark, sf):
    return grid.thumbnail(T.pixels(spark, sf), 2, ("vec_id",))


@query("""SELECT l_orderkey AS slide_id, l_linenumber AS tile, o_orderstatus AS label, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def tile_labels_inherit(spark, sf):
    slides = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("slide_id"), F.col("o_orderstatus").alias("label"))
    return T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").alias("tile"), F.col("l_quantity").alias("q")).join(slides, "slide_id")


@query(f"""WITH {T.SLIDES}, t AS (SELECT slide_id, i * 128 AS ti, j * 128 AS tj FROM slides, range(8) a(i), range(6) b(j) WHERE i < (height - 128) // 128 + 1 AND j < (width - 128) // 128 + 1),
m AS (SELECT l_orderkey AS slide_id, l_linenumber AS mask, (l_partkey % 400)::INT AS top, (l_suppkey % 300)::INT AS lft, (l_partkey % 400 + 1 + l_quantity)::INT AS bottom, (l_suppkey % 300 + 150)::INT AS rgt FROM lineitem)
SELECT slide_id, ti::INT AS tile_i, tj::INT AS tile_j, mask, (least(ti + 128, bottom) - greatest(ti, top))::INT AS "rows", (least(tj + 128, rgt) - greatest(tj, lft))::INT AS "columns"
FROM t JOIN m USING (slide_id) WHERE least(ti + 128, bottom) > greatest(ti, top) AND least(tj + 128, rgt) > greatest(tj, lft)""")
def mask_slice_range_join(spark, sf):
    top, left = (F.col("l_partkey") % 400).cast("int"), (F.col("l_suppkey") % 300).cast("int")
    masks = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").alias("mask"), top.alias("top"), left.alias("left"), (top + 1 + F.col("l_quantity")).cast("int").alias("bottom"), (left + 150).alias("right"))
    return grid.grid_masks(T.slides(spark, sf), masks, (128, 128)).select("slide_id", "tile_i", "tile_j", "mask", "rows", "columns")


@query(f"""WITH {T.SLIDES}, t AS (SELECT slide_id, i * 128 AS ti, j * 128 AS tj FROM slides, range(8) a(i), range(6) b(j) WHERE i < (height - 128) // 128 + 1 AND j < (width - 128) // 128 + 1),
m AS (SELECT l_orderkey AS slide_id, l_linenumber AS name, (l_partkey % 400)::INT AS top, (l_suppkey % 300)::INT AS lft, (l_partkey % 400 + 1 + l_quantity)::INT AS bottom, (l_suppkey % 300 + 150)::INT AS rgt FROM lineitem),
hit AS (SELECT slide_id, ti, tj, name, greatest(top - ti, 0) AS y, greatest(lft - tj, 0) AS x, least(ti + 128, bottom) - greatest(ti, top) AS h, least(tj + 128, rgt) - greatest(tj, lft) AS w
  FROM t JOIN m USING (slide_id) WHERE least(ti + 128, bottom) > greatest(ti, top) AND least(tj + 128, rgt) > greatest(tj, lft))
SELECT t.slide_id, ti::INT AS tile_i, tj::INT AS tile_j, any_value(o_orderstatus) AS label, coalesce(string_agg(name || '@' || y || ',' || x || ':' || h || 'x' || w, ' ' ORDER BY name, y, x, h, w), '') AS masks
FROM t JOIN orders ON o_orderkey = t.slide_id LEFT JOIN hit USING (slide_id, ti, tj) GROUP BY ALL""")
def tiles_with_masks_and_labels(spark, sf):
    """Tiles, what they hold of their slide's masks, and the slide's label, from one operator."""
    top, left = (F.col("l_partkey") % 400).cast("int"), (F.col("l_suppkey") % 300).cast("int")
    masks = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").alias("name"), top.alias("top"), left.alias("left"), (top + 1 + F.col("l_quantity")).cast("int").alias("bottom"), (left + 150).alias("right"))
    found = grid.tiles_with_masks(T.slides(spark, sf, F.col("o_orderstatus").alias("label")), masks, (128, 128))
    written = F.transform("masks", lambda m: F.concat(m["name"], F.lit("@"), m["top"], F.lit(","), m["left"], F.lit(":"), m["rows"], F.lit("x"), m["columns"]))
    return found.select("slide_id", "tile_i", "tile_j", "label", F.array_join(written, " ").alias("masks"))


@query("""SELECT l_orderkey AS slide_id, count(DISTINCT l_linestatus)::BIGINT AS types FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1""")
def slides_with_mixed_types(spark, sf):
    tiles = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slide_id"), F.lit(256).alias("height"), F.lit(256).alias("width"), F.col("l_linestatus").alias("slide_type"))
    return grid.uniform_tiles(tiles).select("slide_id", "types")


# ---- colour and point operators


@query(f"""WITH {T.RGB} SELECT vec_id, j, (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 AS grey FROM rgb""")
def rgb_grey(spark, sf):
    return T.rgb(spark, sf).select("vec_id", "j", color.grey(F.col("r"), F.col("g"), F.col("b")).alias("grey"))


@query(f"""WITH {T.RGB} SELECT vec_id, j, round(-ln((r + 1) / 255.0::DOUBLE), 6) + 0 AS r, round(-ln((g + 1) / 255.0::DOUBLE), 6) + 0 AS g, round(-ln((b + 1) / 255.0::DOUBLE), 6) + 0 AS b FROM rgb""")
def rgb_od(spark, sf):
    return T.rgb(spark, sf).select("vec_id", "j", *((F.round(color.optical_density(F.col(c)), 6) + 0).alias(c) for c in "rgb"))


@query(f"""WITH {T.RGB}, n AS (SELECT *, r / (r + g + b + 1e-6::DOUBLE) AS rn, g / (r + g + b + 1e-6::DOUBLE) AS gn, b / (r + g + b + 1e-6::DOUBLE) AS bn FROM rgb),
a AS (SELECT *, acos(least(greatest(0.5 * ((rn - gn) + (rn - bn)) / (sqrt((rn - gn) * (rn - gn) + (rn - bn) * (gn - bn)) + 1e-6::DOUBLE), -1.0::DOUBLE), 1.0::DOUBLE)) AS t FROM n)
SELECT vec_id, j, round(CASE WHEN r = g AND g = b THEN 0 WHEN b > g THEN (2 * pi() - t) / (2 * pi()) ELSE t / (2 * pi()) END, 4) AS h, round(1 - 3 * least(rn, gn, bn), 6) + 0 AS s, round((r + g + b) / 765.0::DOUBLE, 6) AS i FROM a""")
def rgb_hsi(spark, sf):
    h, s, i = color.hsi(F.col("r"), F.col("g"), F.col("b"))
    return T.rgb(spark, sf).select("vec_id", "j", F.round(h, 4).alias("h"), (F.round(s, 6) + 0).alias("s"), F.round(i, 6).alias("i"))


@query(f"""WITH {T.RGB}, m AS (SELECT *, greatest(r, g, b) AS v, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS d FROM rgb),
a AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN 60 * (g - b) / d WHEN v = g THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END AS t FROM m)
SELECT vec_id, j, floor((CASE WHEN t < 0 THEN t + 360 ELSE t END) / 2 + 0.5)::BIGINT % 180 AS h, (CASE WHEN v = 0 THEN 0 ELSE floor(255 * d / v + 0.5) END)::BIGINT AS s, v FROM a""")
def rgb_hsv(spark, sf):
    h, s, v = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    return T.rgb(spark, sf).select("vec_id", "j", h.alias("h"), s.alias("s"), v.alias("v"))


_LIN = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN power(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4::DOUBLE) ELSE {c} / 255.0::DOUBLE / 12.92 END"
_LABF = lambda t: f"CASE WHEN {t} > 0.008856 THEN power({t}, 1::DOUBLE / 3) ELSE 7.787::DOUBLE * {t} + 16::DOUBLE / 116 END"


@query(f"""WITH {T.RGB}, l AS (SELECT vec_id, j, {_LIN("r")} AS r, {_LIN("g")} AS g, {_LIN("b")} AS b FROM rgb),
x AS (SELECT vec_id, j, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.95047 AS x, 0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b AS y, (0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / 1.08883 AS z FROM l),
f AS (SELECT vec_id, j, {_LABF("x")} AS x, {_LABF("y")} AS y, {_LABF("z")} AS z FROM x)
SELECT vec_id, j, round(116 * y - 16, 4) + 0 AS l, round(500 * (x - y), 4) + 0 AS a, round(200 * (y - z), 4) + 0 AS b FROM f""")
def rgb_lab(spark, sf):
    found = color.lab(F.col("r"), F.col("g"), F.col("b"))
    return T.rgb(spark, sf).select("vec_id", "j", *((F.round(c, 4) + 0).alias(n) for c, n in zip(found, "lab", strict=True)))


@query(f"""WITH {T.PX} SELECT vec_id, i, j, round(coalesce((v - min(v) OVER w)::DOUBLE / nullif((max(v) OVER w - min(v) OVER w)::DOUBLE, 0), 0) * 255, 6) AS v FROM px WINDOW w AS (PARTITION BY vec_id)""")
def rescale_intensity(spark, sf):
    return point.rescale_intensity(T.pixels(spark, sf), ("vec_id",)).select("vec_id", "i", "j", _r("v"))


@query(f"""WITH {T.PX}, q AS (SELECT vec_id, i * 8 + j AS k, v FROM px) SELECT vec_id, k // 32 AS x, (k // 16) % 2 AS y, ((k // 4) % 2) * 4 + k % 4 AS ch, v FROM q WHERE (k // 8) % 2 = 1""")
def codex_collapse(spark, sf):
    k = F.col("i") * 8 + F.col("j")
    at = lambda n, m: (F.floor(k / n) % m).cast("int")
    five = T.pixels(spark, sf).select("vec_id", at(32, 2).alias("x"), at(16, 2).alias("y"), at(8, 2).alias("z"), at(4, 2).alias("c"), at(1, 4).alias("t"), "v")
    return point.collapse_runs(five, 1, 4)


@query(f"""WITH {T.PX} SELECT vec_id, (i * 2 + a)::INT AS i, (j * 2 + b)::INT AS j, v FROM px, range(2) x(a), range(2) y(b)""")
def upsample(spark, sf):
    return point.upsample(T.pixels(spark, sf), 2)


@query(f"""WITH {T.PX} SELECT e.vec_id, i2::INT AS i, j2::INT AS j, coalesce(v, 0) AS v FROM (SELECT vec_id FROM embeddings) e CROSS JOIN range(11) x(i2) CROSS JOIN range(5) y(j2)
LEFT JOIN px ON px.vec_id = e.vec_id AND px.i + 1 = i2 AND px.j - 1 = j2""")
def pad_or_crop(spark, sf):
    return point.pad_or_crop(T.pixels(spark, sf), ("vec_id",), (8, 8), (11, 5))


@query(f"""WITH {T.PX} SELECT vec_id, i, j, round(coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY vec_id, i)), 0), 0), 6) AS v FROM px""")
def normalize_rows(spark, sf):
    return point.normalize_lines(T.pixels(spark, sf), ("vec_id",), "i").select("vec_id", "i", "j", _r("v"))


@query(f"""WITH {T.PX} SELECT vec_id, i, j, round(coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY vec_id, j)), 0), 0), 6) AS v FROM px""")
def normalize_cols(spark, sf):
    return point.normalize_lines(T.pixels(spark, sf), ("vec_id",), "j").select("vec_id", "i", "j", _r("v"))


@query(f"""WITH {T.PX} SELECT vec_id, i, (j // 4)::INT AS j, sum(v)::BIGINT AS v FROM px WHERE j % 4 < 3 GROUP BY ALL""")
def pannuke_mask(spark, sf):
    return point.nucleus_mask(T.pixels(spark, sf).select("vec_id", "i", F.floor(F.col("j") / 4).cast("int").alias("j"), (F.col("j") % 4).alias("c"), "v"), ("vec_id",), 4)


@query(f"""WITH {T.PX} SELECT vec_id, i - 2 AS i, j - 1 AS j, (v * 257 // 256)::INT AS v FROM px WHERE i BETWEEN 2 AND 5 AND j BETWEEN 1 AND 6""")
def centre_crop(spark, sf):
    return point.centre_crop(T.pixels(spark, sf), (8, 8), (4, 6)).withColumn("v", point.narrow(F.col("v") * 257, 2))


# ---- thresholds and histograms


@query(f"""WITH {T.PX} SELECT vec_id, i, j, CASE WHEN v > 127 THEN 0 ELSE 255 END AS v FROM px""")
def binary_threshold(spark, sf):
    return threshold.binary_threshold(T.pixels(spark, sf), ("vec_id",), 127, inverse=True)


def _otsu_ctes(source: str, name: str = "otsu") -> str:
    return f"""{name}_h AS (SELECT vec_id, v, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL),
{name}_s AS (SELECT *, sum(n) OVER u AS n0, sum(n * v) OVER u AS s0, sum(n) OVER a AS nn, sum(n * v) OVER a AS ss FROM {name}_h WINDOW u AS (PARTITION BY vec_id ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY vec_id)),
{name}_b AS (SELECT *, round(coalesce(n0 * (nn - n0) * (s0 / n0 - (ss - s0) / nullif(nn - n0, 0)) * (s0 / n0 - (ss - s0) / nullif(nn - n0, 0)), -1), 6) AS b FROM {name}_s),
{name} AS (SELECT vec_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY b DESC, v) AS r FROM {name}_b) WHERE r = 1)"""


_OTSU = f"WITH {T.PX}, {_otsu_ctes('px')}"


@query(_OTSU + " SELECT * FROM otsu")
def otsu_threshold(spark, sf):
    return threshold.otsu(T.pixels(spark, sf), ("vec_id",))


@query(_OTSU + " SELECT vec_id, i, j, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM px JOIN otsu USING (vec_id)")
def otsu_mask(spark, sf):
    return threshold.binary_threshold(T.pixels(spark, sf), ("vec_id",))


@query(f"""WITH {T.RGB} SELECT vec_id, avg((((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14) > 130)::INT) > 0.5 AS white FROM rgb GROUP BY vec_id""")
def whitespace_label(spark, sf):
    return threshold.whitespace(T.rgb(spark, sf), ("vec_id",), 130)


@query(f"""WITH {T.RGB}, n AS (SELECT *, r / (r + g + b + 1e-6::DOUBLE) AS rn, g / (r + g + b + 1e-6::DOUBLE) AS gn, b / (r + g + b + 1e-6::DOUBLE) AS bn FROM rgb),
a AS (SELECT *, acos(least(greatest(0.5 * ((rn - gn) + (rn - bn)) / (sqrt((rn - gn) * (rn - gn) + (rn - bn) * (gn - bn)) + 1e-6::DOUBLE), -1.0::DOUBLE), 1.0::DOUBLE)) AS t FROM n),
c AS (SELECT vec_id, CASE WHEN r = g AND g = b THEN 0 WHEN b > g THEN (2 * pi() - t) / (2 * pi()) ELSE t / (2 * pi()) END AS h, 1 - 3 * least(rn, gn, bn) AS s, (r + g + b) / 765.0::DOUBLE AS i FROM a),
f AS (SELECT vec_id, i >= 0.1 AND s <= 0.1 AS w, (h > 0.4 AND h < 0.7 AND s > 0.1) OR i < 0.1 AS p FROM c)
SELECT vec_id, avg(w::INT) >= 0.8 OR avg(p::INT) >= 0.05 OR avg((NOT w AND NOT p)::INT) < 0.5 AS artifact FROM f GROUP BY vec_id""")
def artifact_label(spark, sf):
    return threshold.artifacts(T.rgb(spark, sf), ("vec_id",))


@query(f"""WITH {T.PX} SELECT vec_id FROM px GROUP BY vec_id HAVING avg((v > 127)::INT) >= 0.5""")
def tiles_with_mask(spark, sf):
    return threshold.tiles_with_mask(T.pixels(spark, sf).withColumn("v", (F.col("v") > 127).cast("int")), ("vec_id",), 0.5)


@query(f"""WITH {T.PX}, h AS (SELECT vec_id, v // 4 AS k, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT vec_id, k, sum(n) OVER (PARTITION BY vec_id ORDER BY k) / sum(n) OVER (PARTITION BY vec_id) AS cdf FROM h)
SELECT vec_id, i, j, v, cdf FROM px JOIN c USING (vec_id) WHERE px.v // 4 = c.k""")
def hist_equalize(spark, sf):
    return threshold.equalize(T.pixels(spark, sf), ("vec_id",), 64)


@query(R.clahe(4, 3.0, 32))
def clahe(spark, sf):
    return threshold.adaptive_equalize(T.pixels(spark, sf), ("vec_id",), 4, 3.0, 32).select("vec_id", "i", "j", "v", _r("cdf"))


@query("""WITH c AS (SELECT event_type, quantile_cont(nullif(value, 0), 0.9) AS cap FROM events GROUP BY 1)
SELECT event_type, round(max(cap), 6) AS cap, round(sum(least(value, cap)), 4) AS total FROM events JOIN c USING (event_type) GROUP BY 1""")
def percentile_clip(spark, sf):
    clipped = threshold.clip_percentile(T.read(spark, sf, "events"), ("event_type",), 0.9)
    return clipped.groupBy("event_type").agg(F.round(F.max("cap"), 6).alias("cap"), F.round(F.sum("value"), 4).alias("total"))


# ---- stencils


def _box(aggregate: str, source: str = "px") -> str:
    return f"SELECT p.vec_id, p.i, p.j, {aggregate} AS v FROM {source} p JOIN {source} q ON q.vec_id = p.vec_id AND abs(q.i - p.i) <= 1 AND abs(q.j - p.j) <= 1 GROUP BY ALL"


@query(f"WITH {T.PX} {_box('round(avg(q.v), 6)')}")
def box_blur(spark, sf):
    return stencil.box_blur(T.pixels(spark, sf), ("vec_id",), 3).select("vec_id", "i", "j", _r("v"))


@query(f"WITH {T.PX} {_box('round(sum(q.v * exp(-((q.i - p.i) * (q.i - p.i) + (q.j - p.j) * (q.j - p.j)) / 2.0::DOUBLE)) / sum(exp(-((q.i - p.i) * (q.i - p.i) + (q.j - p.j) * (q.j - p.j)) / 2.0::DOUBLE)), 6)')}")
def gaussian_blur(spark, sf):
    return stencil.gaussian_blur(T.pixels(spark, sf), ("vec_id",), 3, 1.0).select("vec_id", "i", "j", _r("v"))


@query(f"WITH {T.PX} {_box('median(q.v)')}")
def median_blur(spark, sf):
    return stencil.median_blur(T.pixels(spark, sf), ("vec_id",), 3)


@query(f"WITH {T.PX}, e AS ({_box('min(q.v)')}) {_box('max(q.v)', 'e')}")
def morph_open(spark, sf):
    return stencil.morph_open(T.pixels(spark, sf), ("vec_id",), 3)


@query(f"WITH {T.PX}, e AS ({_box('max(q.v)')}) {_box('min(q.v)', 'e')}")
def morph_close(spark, sf):
    return stencil.morph_close(T.pixels(spark, sf), ("vec_id",), 3)


@query(f"""WITH {T.PX} SELECT p.vec_id, p.i, p.j,
  round(sum(q.v * (q.j - p.j) / ((q.i - p.i) * (q.i - p.i) + (q.j - p.j) * (q.j - p.j) + 1e-5::DOUBLE)), 4) + 0 AS gh, round(sum(q.v * (q.i - p.i) / ((q.i - p.i) * (q.i - p.i) + (q.j - p.j) * (q.j - p.j) + 1e-5::DOUBLE)), 4) + 0 AS gv
FROM px p JOIN px q ON q.vec_id = p.vec_id AND abs(q.i - p.i) <= 2 AND abs(q.j - p.j) <= 2 GROUP BY ALL""")
def sobel_gradient(spark, sf):
    return stencil.sobel(T.pixels(spark, sf), ("vec_id",)).select("vec_id", "i", "j", (F.round("gh", 4) + 0).alias("gh"), (F.round("gv", 4) + 0).alias("gv"))


@query(f"""WITH {T.PX}, m AS (SELECT vec_id, i, j FROM px WHERE v > 127) SELECT DISTINCT vec_id, (i + a)::INT AS i, (j + b)::INT AS j FROM m, {T.AROUND}
EXCEPT SELECT vec_id, i, j FROM m""")
def segmentation_lines(spark, sf):
    return stencil.boundary_outside(T.pixels(spark, sf).filter("v > 127").select("vec_id", "i", "j"), ("vec_id",))


@query(f"""WITH {T.INST} SELECT p.graph_id, p.i, p.j, CASE WHEN EXISTS (SELECT 1 FROM inst q WHERE q.graph_id = p.graph_id AND abs(q.i - p.i) + abs(q.j - p.j) = 1 AND q.label <> p.label) THEN 0 ELSE p.label END AS label FROM inst p""")
def erode_edges(spark, sf):
    return stencil.erode_edges(T.instances(spark, sf).drop("v"), ("graph_id",), 1).select("graph_id", "i", "j", "label")


# ---- measurements


@query(f"""WITH {T.INST} SELECT graph_id, label, count(*)::BIGINT AS area, round(avg(i) + 100, 6) AS y, round(avg(j) + 7, 6) AS x, round(avg(v), 6) AS mean_v, min(v) AS min_v, max(v) AS max_v FROM inst WHERE label <> 0 GROUP BY ALL""")
def quantify_cells(spark, sf):
    tiles = T.instances(spark, sf).withColumns({"tile_i": F.lit(100), "tile_j": F.lit(7)})
    return quantify.quantify(tiles, ("graph_id",), ("v",), ("tile_i", "tile_j")).select("graph_id", "label", "area", _r("y"), _r("x"), _r("mean_v"), "min_v", "max_v")


@query("""SELECT user_id, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL""")
def quantify_channels(spark, sf):
    return T.read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(f"""WITH {T.INST}, q AS (SELECT graph_id, label, i - a AS y, j - b AS x, sum(1 << (2 * a + b))::INT AS q FROM inst, range(2) s(a), range(2) t(b) WHERE label <> 0 GROUP BY ALL)
SELECT graph_id, label, floor(sum(CASE WHEN q IN (1, 2, 4, 8) THEN 1 WHEN q IN (7, 11, 13, 14) THEN -1 WHEN q IN (6, 9) THEN -2 ELSE 0 END) / 4)::BIGINT AS euler FROM q GROUP BY ALL""")
def euler_number(spark, sf):
    return quantify.euler_number(T.instances(spark, sf), ("graph_id",))


@query("""SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL)) WHERE r = 1""")
def majority_vote(spark, sf):
    return quantify.majority(T.read(spark, sf, "events"), ("user_id",), "event_type")


_NUCLEI = f"""WITH {T.INST}, k AS (SELECT graph_id, label, v % 4 AS type, count(*) AS n, sum(i) AS si, sum(j) AS sj FROM inst WHERE label <> 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY graph_id, label ORDER BY type = 0, n DESC, type) AS r, sum(n) OVER w AS area, sum(si) OVER w AS y, sum(sj) OVER w AS x FROM k WINDOW w AS (PARTITION BY graph_id, label)),
nuclei AS (SELECT graph_id, label, round(y / area, 6) AS y, round(x / area, 6) AS x, area::BIGINT AS area, type, round(n / (area + 1e-6::DOUBLE), 6) AS prob FROM r WHERE r = 1)"""


@query(_NUCLEI + " SELECT * FROM nuclei")
def nuclei_info(spark, sf):
    found = quantify.nuclei(T.instances(spark, sf).withColumn("kind", F.col("v") % 4), ("graph_id",), "kind")
    return found.select("graph_id", "label", _r("y"), _r("x"), "area", "type", _r("prob"))


@query(_NUCLEI + " SELECT type, count(*)::BIGINT AS n, round(min(y), 6) AS first_y FROM nuclei WHERE prob >= 0.5 GROUP BY type")
def centroids_by_type(spark, sf):
    grouped = quantify.centroids_by_type(nuclei_info(spark, sf), 0.5)
    return grouped.select("type", F.size("centroids").cast("long").alias("n"), F.round(F.col("centroids")[0]["y"], 6).alias("first_y"))


@query(f"""WITH {T.PX} SELECT vec_id, i, j, floor(avg(v) OVER (PARTITION BY vec_id, i // 2, j // 2))::BIGINT AS v FROM px""")
def superpixel_mean(spark, sf):
    px = T.pixels(spark, sf).withColumn("label", F.floor(F.col("i") / 2) * 4 + F.floor(F.col("j") / 2))
    return quantify.superpixel_mean(px, ("vec_id",)).select("vec_id", "i", "j", "v")


@query(f"""WITH {T.POINTS}, c AS (SELECT graph_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM pts GROUP BY 1)
SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY round(atan2(x - cx, y - cy), 9), x, y)::INT AS rank FROM pts JOIN c USING (graph_id)""")
def clockwise_order(spark, sf):
    return quantify.clockwise(T.points(spark, sf), ("graph_id",)).select("graph_id", "node", "rank")


_CLOCKWISE = ORACLE_SQL["clockwise_order"]


@query(f"""WITH o AS ({_CLOCKWISE}), {T.POINTS}, s AS (SELECT graph_id, x::DOUBLE AS x, y::DOUBLE AS y, coalesce(lead(x) OVER w, first_value(x) OVER w)::DOUBLE AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w)::DOUBLE AS y2 FROM pts JOIN o USING (graph_id, node) WINDOW w AS (PARTITION BY graph_id ORDER BY rank))
SELECT graph_id, round(sum(x * y2 - x2 * y) / 2, 3) + 0 AS area, round(sum((x + x2) * (x * y2 - x2 * y)) / 6 / (sum(x * y2 - x2 * y) / 2 + 1e-5::DOUBLE), 4) + 0 AS cx, round(sum((y + y2) * (x * y2 - x2 * y)) / 6 / (sum(x * y2 - x2 * y) / 2 + 1e-5::DOUBLE), 4) + 0 AS cy FROM s GROUP BY 1""")
def polygon_centroid(spark, sf):
    found = quantify.polygon(quantify.clockwise(T.points(spark, sf), ("graph_id",)), ("graph_id",))
    return found.select("graph_id", (F.round("area", 3) + 0).alias("area"), (F.round("cx", 4) + 0).alias("cx"), (F.round("cy", 4) + 0).alias("cy"))


@query(f"""WITH {T.INST}, c AS (SELECT *, floor(avg(i) OVER w) AS cy, floor(avg(j) OVER w) AS cx FROM inst WHERE label <> 0 WINDOW w AS (PARTITION BY graph_id, label)),
d AS (SELECT *, j - cx AS dx, i - cy AS dy FROM c)
SELECT graph_id, label, i, j, round(CASE WHEN dx < 0 THEN dx / -min(dx) OVER w ELSE coalesce(dx / nullif(max(dx) OVER w, 0), 0) END, 6) AS h, round(CASE WHEN dy < 0 THEN dy / -min(dy) OVER w ELSE coalesce(dy / nullif(max(dy) OVER w, 0), 0) END, 6) AS v FROM d WINDOW w AS (PARTITION BY graph_id, label)""")
def direction_map(spark, sf):
    return quantify.direction_map(T.instances(spark, sf), ("graph_id",)).select("graph_id", "label", "i", "j", _r("h"), _r("v"))


@query("""SELECT user_id, count(click)::BIGINT AS clicks, count(value)::BIGINT AS values, count(*)::BIGINT AS n FROM (
SELECT user_id, event_id AS click, NULL AS value FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, NULL, value FROM events WHERE event_type IS DISTINCT FROM 'click') GROUP BY 1""")
def counts_outer_union(spark, sf):
    e = T.read(spark, sf, "events")
    both = quantify.outer_union(e.filter("event_type <=> 'click'").select("user_id", F.col("event_id").alias("click")), e.filter("NOT (event_type <=> 'click')").select("user_id", "value"))
    return both.groupBy("user_id").agg(F.count("click").alias("clicks"), F.count("value").alias("values"), F.count(F.lit(1)).alias("n"))


# ---- metrics


@query("""SELECT s_suppkey, coalesce(sum(l_quantity), 0) AS total FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def scatter_sum(spark, sf):
    rows = T.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    return metrics.scatter_sum(rows, "s_suppkey", "l_quantity", T.read(spark, sf, "supplier"))


@query(f"""WITH {T.KNN}, d AS (SELECT node, count(src) AS degree FROM pts LEFT JOIN knn ON knn.dst = pts.node GROUP BY 1) SELECT degree::BIGINT AS degree, count(*)::BIGINT AS n FROM d GROUP BY 1""")
def degree_histogram(spark, sf):
    return metrics.degree_histogram(T.points(spark, sf), _knn(spark, sf))


@query("""SELECT event_type, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM events GROUP BY 1""")
def class_weights(spark, sf):
    return metrics.class_weights(T.read(spark, sf, "events"), "event_type").select("event_type", _r("weight"))


@query("""SELECT doc_id % 10 AS slide, round(2 * sum((quality > 0 AND toxic > 0)::INT) / (sum((quality > 0)::INT) + sum((toxic > 0)::INT) + 1e-3::DOUBLE), 6) AS dice FROM labels GROUP BY 1""")
def dice_score(spark, sf):
    return T.read(spark, sf, "labels").groupBy((F.col("doc_id") % 10).alias("slide")).agg(F.round(metrics.dice(F.col("quality"), F.col("toxic")), 6).alias("dice"))


@query("""WITH p AS (SELECT doc_id % 10 AS slide, quality::DOUBLE AS t, (doc_id % 97 + 1) / 98.0::DOUBLE AS p, toxic::DOUBLE AS m FROM labels)
SELECT slide, round(1 - (2 * sum(p * t) + 1e-3::DOUBLE) / (sum(p) + sum(t) + 1e-3::DOUBLE), 6) AS dice, round(-avg(t * ln(p) + (1 - t) * ln(1 - p)), 6) AS ce, round(avg((p - t) * (p - t)), 6) AS mse, round(sum((p - t) * (p - t) * m) / (sum(m) + 1e-7::DOUBLE), 6) AS masked FROM p GROUP BY 1""")
def losses(spark, sf):
    p, t, m = (F.col("doc_id") % 97 + 1) / 98.0, F.col("quality").cast("double"), F.col("toxic").cast("double")
    found = {"dice": metrics.soft_dice_loss(p, t), "ce": metrics.cross_entropy(p, t), "mse": metrics.squared_error(p, t), "masked": metrics.masked_squared_error(p, t, m)}
    return T.read(spark, sf, "labels").groupBy((F.col("doc_id") % 10).alias("slide")).agg(*(F.round(c, 6).alias(n) for n, c in found.items()))


@query("""WITH c AS (SELECT o_orderstatus AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS p FROM orders),
k AS (SELECT t AS c, count(*) AS s, sum((t = p)::INT) AS h FROM c GROUP BY 1), g AS (SELECT p AS c, count(*) AS g FROM c GROUP BY 1)
SELECT round(sum(2 * h / (s + coalesce(g, 0)) * s) / sum(s), 6) AS f1 FROM k LEFT JOIN g USING (c)""")
def weighted_f1(spark, sf):
    rows = T.read(spark, sf, "orders").select(F.col("o_orderstatus").alias("t"), F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("p"))
    return metrics.weighted_f1(rows, "t", "p").select(_r("f1"))


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS max, min(value) AS min, round(sum(value), 4) AS sum, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1""")
def value_stats(spark, sf):
    return T.read(spark, sf, "events").groupBy("event_type").agg(*metrics.summary("value")).select("event_type", _r("mean"), _r("median"), "max", "min", _r("sum", 4), _r("std"))


# ---- graphs


def _knn(spark, sf) -> DataFrame:
    return graph.knn_graph(T.points(spark, sf), 5)


@query(f"WITH {T.KNN} SELECT graph_id, src, dst, round(d, 6) AS d FROM knn")
def knn_graph(spark, sf):
    return _knn(spark, sf).select("graph_id", "src", "dst", _r("d"))


@query(f"WITH {T.KNN} SELECT graph_id, src, dst FROM knn WHERE d <= 40")
def knn_graph_thresh(spark, sf):
    return graph.knn_graph(T.points(spark, sf), 5, 40.0).select("graph_id", "src", "dst")


_RAG = f"""WITH {T.INST}, rag AS (SELECT DISTINCT p.graph_id, p.label AS src, q.label AS dst FROM inst p JOIN inst q ON q.graph_id = p.graph_id AND abs(q.i - p.i) <= 1 AND abs(q.j - p.j) <= 1 WHERE p.label <> 0 AND q.label <> 0 AND p.label <> q.label)"""


@query(_RAG + " SELECT * FROM rag")
def rag_graph(spark, sf):
    return graph.adjacency(T.instances(spark, sf))


@query(_RAG + " SELECT * FROM rag UNION ALL SELECT DISTINCT a.graph_id, a.src, b.dst FROM rag a JOIN rag b ON a.graph_id = b.graph_id AND a.dst = b.src AND a.src <> b.dst")
def rag_two_hop(spark, sf):
    return graph.two_hop(graph.adjacency(T.instances(spark, sf)))


_PATHS = """WITH e AS (SELECT DISTINCT l_partkey % 500 AS src, l_suppkey % 500 AS dst FROM lineitem)
SELECT 0::BIGINT AS graph_id, src, count(*)::BIGINT AS paths FROM (SELECT src, dst FROM e UNION ALL SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src AND a.src <> b.dst) GROUP BY src"""


@query(_PATHS)
def two_hop_paths(spark, sf):
    e = T.read(spark, sf, "lineitem").select(F.lit(0).cast("long").alias("graph_id"), (F.col("l_partkey") % 500).alias("src"), (F.col("l_suppkey") % 500).alias("dst")).distinct()
    return graph.two_hop(e, distinct=False).groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("paths"))


_NODES = f"""{T.INST}, nodes AS (SELECT graph_id, label AS node, round_even(avg(j), 0)::BIGINT AS cx, round_even(avg(i), 0)::BIGINT AS cy FROM inst WHERE label <> 0 GROUP BY ALL)"""


@query(f"WITH {_NODES} SELECT n.graph_id, n.node AS cell, i.label AS tissue FROM nodes n LEFT JOIN inst i ON i.graph_id = n.graph_id AND i.i = n.cy AND i.j = n.cx AND i.label <> 0")
def assignment_matrix(spark, sf):
    inst = T.instances(spark, sf)
    return graph.assign(graph.centroids(inst, 8, 8).withColumnRenamed("node", "cell"), inst)


@query(f"WITH {_NODES} SELECT graph_id, node, cx, cy, cx / 8.0::DOUBLE AS nx, cy / 8.0::DOUBLE AS ny FROM nodes")
def node_features_loc(spark, sf):
    return graph.centroids(T.instances(spark, sf), 8, 8)


_UND = f"WITH {R.UNDIRECTED}"


@query(_UND + """, tri AS (SELECT x.graph_id, count(*) AS t FROM p x JOIN p y ON x.graph_id = y.graph_id AND x.b = y.a JOIN p z ON z.graph_id = x.graph_id AND z.a = x.a AND z.b = y.b GROUP BY 1),
n AS (SELECT graph_id, count(*)::BIGINT AS nodes FROM pts GROUP BY 1), w AS (SELECT graph_id, sum(d * (d - 1) / 2) AS w, (sum(d) / 2)::BIGINT AS edges FROM deg GROUP BY 1),
c AS (SELECT s.graph_id, corr(x.d, y.d) AS assortativity FROM s JOIN deg x ON x.graph_id = s.graph_id AND x.node = s.src JOIN deg y ON y.graph_id = s.graph_id AND y.node = s.dst GROUP BY 1)
SELECT graph_id, nodes, edges, round(2.0::DOUBLE * edges / (nodes * (nodes - 1)), 6) AS density, round(3.0::DOUBLE * coalesce(t, 0) / w, 6) AS transitivity, round(assortativity, 6) AS assortativity FROM n JOIN w USING (graph_id) LEFT JOIN tri USING (graph_id) JOIN c USING (graph_id)""")
def graph_stats(spark, sf):
    return graph.graph_stats(T.points(spark, sf), _knn(spark, sf)).select("graph_id", "nodes", "edges", _r("density"), _r("transitivity"), _r("assortativity"))


@query(f"WITH {T.KNN}, {R.pagerank_ctes(10)} SELECT graph_id, node, round(r, 9) AS rank FROM r10")
def pagerank_fixed_iter(spark, sf):
    return graph.pagerank(T.points(spark, sf), _knn(spark, sf), 10).select("graph_id", "node", _r("rank", 9))


@query(f'WITH {R.UNDIRECTED}, {R.CONSTRAINT} SELECT graph_id, node, round(tie, 6) AS "constraint" FROM tied')
def node_constraint(spark, sf):
    return graph.constraint(_knn(spark, sf)).select("graph_id", "node", _r("constraint"))


@query(R.hits(6))
def hits_scores(spark, sf):
    return graph.hits(_knn(spark, sf), 6).select("graph_id", "node", _r("hub"), _r("authority"))


@query(R.eigenvector(8))
def eigenvector_centrality(spark, sf):
    return graph.eigenvector(_knn(spark, sf), 8).select("graph_id", "node", _r("centrality"))


@query(R.CORENESS)
def core_numbers(spark, sf):
    return graph.coreness(_knn(spark, sf))


@query(R.ECCENTRICITY)
def graph_eccentricity(spark, sf):
    return graph.eccentricities(_knn(spark, sf))


@query(R.FOREST)
def mst_edges(spark, sf):
    return graph.spanning_forest(_knn(spark, sf).withColumnRenamed("d", "w")).select("graph_id", "a", "b", _r("w"))


_REGIONS = f"""WITH RECURSIVE {T.PX}, m AS (SELECT vec_id, i, j, i * 8 + j AS k FROM px WHERE v > 127),
reach AS (SELECT vec_id, k, k AS r FROM m UNION SELECT m.vec_id, m.k, reach.r FROM reach JOIN m ON m.vec_id = reach.vec_id AND abs(m.k // 8 - reach.k // 8) <= 1 AND abs(m.k % 8 - reach.k % 8) <= 1),
reg AS (SELECT vec_id, (k // 8)::INT AS i, (k % 8)::INT AS j, min(r) AS root FROM reach GROUP BY vec_id, k)"""


@query(_REGIONS + " SELECT vec_id, i, j, (root // 8)::INT AS ri, (root % 8)::INT AS rj FROM reg")
def connected_regions(spark, sf):
    return labels.label_regions(T.pixels(spark, sf).filter("v > 127"), "vec_id")


@query(_REGIONS + " SELECT vec_id, i, j, (root // 8)::INT AS ri, (root % 8)::INT AS rj FROM reg WHERE (vec_id, root) IN (SELECT vec_id, root FROM reg GROUP BY ALL HAVING count(*) >= 5)")
def remove_small_objects(spark, sf):
    return labels.remove_small(T.pixels(spark, sf).filter("v > 127"), "vec_id", 5)


@query(f"WITH RECURSIVE {T.PX}, {R.filled('f', 'SELECT vec_id, i * 8 + j AS k FROM px WHERE v > 120', 4)} {R.as_pixels('f')}")
def fill_holes(spark, sf):
    px = T.pixels(spark, sf).withColumn("v", (F.col("v") > 120).cast("int"))
    return labels.fill_holes(px, "vec_id", 8, 8, 4)


@query(f"WITH RECURSIVE {T.PX}, {R.foreground('f', 'SELECT vec_id, i * 8 + j AS k FROM px WHERE v > 120', 4, 3)} {R.as_pixels('f')}")
def foreground_regions(spark, sf):
    px = T.pixels(spark, sf).withColumn("v", (F.col("v") > 120).cast("int"))
    return labels.foreground(px, "vec_id", 8, 8, 4, 3)


@query(R.WATERSHED)
def deep_watershed(spark, sf):
    px = T.pixels(spark, sf)
    peaks = labels.local_maxima(px, ("vec_id",), 3, 130)
    markers = peaks.withColumn("marker", F.col("i") * 8 + F.col("j") + 1)
    return labels.watershed(px.withColumn("v", 255 - F.col("v")), markers, "vec_id")


@query(f"WITH {R.superpixels(4, 8.0, 3)} SELECT vec_id, i, j, li || ':' || lj AS label FROM l3")
def slic_superpixels(spark, sf):
    return labels.superpixels(T.pixels(spark, sf), "vec_id", 4, 8.0, 3)


@query(R.merged(2, 8.0, 2, 6.0))
def merged_superpixels(spark, sf):
    px = T.pixels(spark, sf)
    clusters = labels.superpixels(px, "vec_id", 2, 8.0, 2)
    return labels.merge_superpixels(px.join(clusters, ["vec_id", "i", "j"]), "vec_id", 6.0)


_TILES = f"""WITH {T.PX}, t AS (SELECT vec_id // 10 AS slide_id, (vec_id % 10) // 5 * 6 AS ti, vec_id % 5 * 6 AS tj, i, j, v FROM px)"""


@query(_TILES + """ SELECT slide_id, (ti + i)::INT AS i, (tj + j)::INT AS j, max_by(v, ti * 1000 + tj) AS v FROM t WHERE ti + i < 13 AND tj + j < 30 GROUP BY ALL""")
def stitch_tiles(spark, sf):
    place = lambda c: c.cast("int")
    tiles = T.pixels(spark, sf).select(F.floor(F.col("vec_id") / 10).alias("slide_id"), place(F.floor(F.col("vec_id") % 10 / 5) * 6).alias("tile_i"), place(F.col("vec_id") % 5 * 6).alias("tile_j"), "i", "j", "v")
    return labels.stitch(tiles, 13, 30)


@query("""SELECT page_id, split, CASE WHEN page_id % 3 + 1 = split THEN 'train' WHEN split = 2 AND page_id % 3 = 0 OR split <> 2 AND page_id % 3 = 1 THEN 'valid' ELSE 'test' END AS role FROM pages, (SELECT unnest([1, 2, 3]) AS split)""")
def pannuke_splits(spark, sf):
    """The role of every image in each of the three splits."""
    from tesselon.sources import datasets

    files = T.read(spark, sf, "pages").select("page_id", (F.col("page_id") % 3 + 1).alias("fold"))
    parts = [datasets.pannuke_split(files, s).select("page_id", F.lit(s).alias("split"), "role") for s in datasets.PANNUKE_SPLITS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(f"""WITH {T.INST}, c AS (SELECT graph_id, label, floor(avg(i))::INT - 1 AS y, floor(avg(j))::INT - 1 AS x FROM inst WHERE label <> 0 GROUP BY ALL)
SELECT c.graph_id, c.label, y, x, count(*)::BIGINT AS overlap FROM c JOIN inst p ON p.graph_id = c.graph_id AND p.label = c.label AND p.i BETWEEN y AND y + 2 AND p.j BETWEEN x AND x + 2 GROUP BY ALL HAVING count(*) >= 3""")
def patch_lattice(spark, sf):
    return graph.cell_patches(T.instances(spark, sf), ("graph_id",), 3, 3)


@query("""SELECT page_id % 3 + 1 AS fold, 'fold' || (page_id % 3 + 1) || '_' || page_id || '_' || (ARRAY['Breast', 'Colon', 'Bile-duct'])[1 + page_id % 3] || '.png' AS name, (ARRAY['Breast', 'Colon', 'Bile-duct'])[1 + page_id % 3] AS tissue FROM pages""")
def dataset_splits(spark, sf):
    from tesselon.sources.images import tissue_of

    kinds = F.array(*map(F.lit, ("Breast", "Colon", "Bile-duct")))
    fold = F.col("page_id") % 3 + 1
    name = F.concat(F.lit("fold"), fold, F.lit("_"), F.col("page_id"), F.lit("_"), F.element_at(kinds, fold.cast("int")), F.lit(".png"))
    return T.read(spark, sf, "pages").select(fold.alias("fold"), name.alias("name"), tissue_of(F.concat(F.lit("/data/"), name)).alias("tissue"))


# ---- stain, models, store, streams


@query()
def stain_macenko(spark, sf):
    rgb = T.rgb(spark, sf).withColumn("slide", F.col("vec_id") % 20)
    return stain.normalize_stain(rgb, "slide").select("vec_id", "j", "r", "g", "b")


_DARK = f"""WITH RECURSIVE {T.PX}, dark AS (SELECT vec_id, i, j, 255 - v AS v FROM px), med AS ({_box("median(q.v)", "dark")}), {_otsu_ctes("med")},
mask AS (SELECT vec_id, i, j, (v > threshold)::INT AS v FROM med JOIN otsu USING (vec_id)), er AS ({_box("min(q.v)", "mask")}), op AS ({_box("max(q.v)", "er")}), di AS ({_box("max(q.v)", "op")}), cl AS ({_box("min(q.v)", "di")})"""


@query(f"""{_DARK}, {R.foreground("f", "SELECT vec_id, i * 8 + j AS k FROM cl WHERE v > 0", 4, 4)} {R.as_pixels("f")}""")
def tissue_detect(spark, sf):
    px = T.pixels(spark, sf)
    return stain.detect_tissue(px.select("vec_id", "i", "j", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b")), "vec_id", 8, 8)


@query()
def nucleus_detect(spark, sf):
    v = F.col("v")
    colored = T.pixels(spark, sf).select("vec_id", "i", "j", F.greatest(v - 40, F.lit(0)).alias("r"), F.floor(v * v / 255).alias("g"), v.alias("b"))
    return stain.detect_nuclei(colored, "vec_id")


@query("""SELECT vec_id, round(sum(2.5::DOUBLE * x + 0.5), 3) AS total, count(*)::BIGINT AS n FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1""")
def onnx_inference(spark, sf):
    tiles = T.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("image"))
    found = infer.infer(tiles, infer.affine_model(2.5, 0.5), "vec_id", (1, 8, 8))
    return found.select("vec_id", F.round(F.aggregate("output", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"), F.size("output").cast("long").alias("n"))


@query("""WITH p AS (SELECT c_custkey AS node, o_totalprice AS a, o_orderkey::DOUBLE AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
SELECT node, round(coalesce(avg(a), 0), 4) AS a, round(coalesce(avg(b), 0), 4) AS b FROM p GROUP BY 1""")
def patch_features_mean(spark, sf):
    patches = T.read(spark, sf, "orders").select(F.col("o_custkey").alias("node"), F.array("o_totalprice", F.col("o_orderkey").cast("double")).alias("features"))
    found = infer.mean_per_entity(patches, T.read(spark, sf, "customer").select(F.col("c_custkey").alias("node")), ("node",))
    return found.select("node", F.round(F.col("features")[0], 4).alias("a"), F.round(F.col("features")[1], 4).alias("b"))


@query("""SELECT l_orderkey AS slide_id, l_linenumber AS tile, CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 1 END AS version FROM lineitem WHERE l_linenumber <> 5""")
def store_upsert_remove(spark, sf):
    tiles = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").alias("tile"), F.lit(1).alias("version"))
    new = tiles.filter("tile % 3 = 0").withColumn("version", F.lit(2))
    return store.remove(store.upsert(tiles, new, ("slide_id", "tile")), tiles.filter("tile = 5"), ("slide_id", "tile"))


@query("""SELECT user_id % 20 AS slide_id, user_id AS tile_i, event_id AS tile_j, event_type FROM events""")
def store_round_trip(spark, sf):
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    e = T.read(spark, sf, "events")
    store.write_tiles(e.select((F.col("user_id") % 20).alias("slide_id"), F.col("user_id").alias("tile_i"), F.col("event_id").alias("tile_j"), "event_type"), path)
    return store.read_tiles(spark, path).select(F.col("slide_id").cast("long").alias("slide_id"), "tile_i", "tile_j", "event_type")


@query("""SELECT user_id % 20 AS slide_id, user_id AS tile_i, event_id AS tile_j, CASE WHEN user_id % 20 IN (3, 7) AND event_id % 3 = 0 THEN 'changed' ELSE event_type END AS event_type
FROM events WHERE user_id % 20 <> 5 AND NOT (user_id % 20 = 7 AND event_id % 5 = 0) UNION ALL SELECT 99, user_id, event_id, event_type FROM events WHERE user_id % 20 = 3 AND event_id % 4 = 0""")
def store_rewrites(spark, sf):
    """A store read back after tiles were replaced, added to a new slide, and removed, one slide with all its tiles."""
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    slide = F.col("user_id") % 20
    tiles = T.read(spark, sf, "events").select(slide.alias("slide_id"), F.col("user_id").alias("tile_i"), F.col("event_id").alias("tile_j"), "event_type")
    store.write_tiles(tiles, path)
    changed = tiles.filter("slide_id IN (3, 7) AND tile_j % 3 = 0").withColumn("event_type", F.lit("changed"))
    added = tiles.filter("slide_id = 3 AND tile_j % 4 = 0").withColumn("slide_id", F.lit(99).cast(tiles.schema["slide_id"].dataType))
    store.write_upsert(spark, path, changed.unionAll(added))
    store.write_remove(spark, path, tiles.filter("slide_id = 5 OR slide_id = 7 AND tile_j % 5 = 0"))
    return store.read_tiles(spark, path).select(F.col("slide_id").cast("long").alias("slide_id"), "tile_i", "tile_j", "event_type")


@query("""SELECT user_id AS slide_id, count(DISTINCT event_id % 4)::BIGINT AS tiles, 4::BIGINT AS expected FROM events GROUP BY user_id HAVING count(DISTINCT event_id % 4) = 4""")
def stream_finished_slides(spark, sf):
    """Slides of four tiles all of which have come; each event is a tile, and tiles come again and again."""
    folder, name = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    stream = arrivals.arrivals(spark, sf, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "events.parquet*")
    tiles = stream.select(F.col("user_id").alias("slide_id"), (F.col("event_id") % 4).alias("tile_i"), F.lit(0).alias("tile_j"), F.lit(4).alias("expected"), F.col("ts").alias("at"))
    before = spark.conf.get(name)
    spark.conf.set(name, arrivals.STORE)
    try:
        arrivals.once(arrivals.finished(tiles, "3650 days"), f"{folder}/out", f"{folder}/checkpoint")
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{folder}/out").filter("complete").select("slide_id", "tiles", "expected")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_windows(spark, sf):
    """The stream's own result after it has read all that is there; complete mode keeps every window."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = arrivals.arrivals(spark, sf, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "events.parquet*")
    cells = stream.withColumn("ts", F.col("ts").cast("timestamp"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    found = arrivals.windowed(cells, "ts", "1 hour", "10 minutes", ("event_type",), "value")
    found.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", _r("total", 4))
