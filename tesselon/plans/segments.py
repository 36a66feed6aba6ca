"""Queries over segmentation models' outputs, single-cell tables, instance maps and graph features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.operators import gnn, graph, labels, metrics, quantify, resample, segment, stain, stencil
from tesselon.plans import rounds as R
from tesselon.plans import tables as T
from tesselon.plans.registry import query
from tesselon.plans.registry import rounded as _r


def _mirror(p: str) -> str:
    """A place outside 0..7 mirrored at the outer places."""
    m = f"((({p}) % 14) + 14) % 14"
    return f"least({m}, 14 - {m})"


def _lines(source: str, value: str, weights: str, axis: str) -> str:
    """Weighted sums along one axis of 8 by 8 tiles, borders mirrored; weights are rows (d, wt)."""
    at = f"q.{axis} = {_mirror(f'p.{axis} + d')} AND q.{'j' if axis == 'i' else 'i'} = p.{'j' if axis == 'i' else 'i'}"
    return f"SELECT p.vec_id, p.i, p.j, sum(wt * q.{value}) AS {value} FROM {source} p CROSS JOIN (VALUES {weights}) k(d, wt) JOIN {source} q ON q.vec_id = p.vec_id AND {at} GROUP BY ALL"


_SMOOTH, _SLOPE, _SOFT = "(-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)", "(-2, -1), (-1, -2), (0, 0), (1, 2), (2, 1)", "(-1, 0.25::DOUBLE), (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)"
_UNIT = lambda c: f"coalesce(({c} - min({c}) OVER t) / nullif(max({c}) OVER t - min({c}) OVER t, 0), 0)"
_TILE = "WINDOW t AS (PARTITION BY vec_id)"

_HOVERNET = f"""WITH RECURSIVE {T.PX}, {R.regions("q", "SELECT vec_id, i * 8 + j AS k FROM px WHERE v >= 127")},
tau AS (SELECT vec_id, k FROM q JOIN (SELECT vec_id, root FROM q GROUP BY ALL HAVING count(*) >= 3) USING (vec_id, root)),
u AS (SELECT vec_id, i, j, (v % 51) / 50.0::DOUBLE AS h, (v % 37) / 36.0::DOUBLE AS w FROM px), n AS (SELECT vec_id, i, j, {_UNIT("h")} AS h, {_UNIT("w")} AS w FROM u {_TILE}),
h1 AS ({_lines("n", "h", _SLOPE, "j")}), h2 AS ({_lines("h1", "h", _SMOOTH, "i")}), w1 AS ({_lines("n", "w", _SLOPE, "i")}), w2 AS ({_lines("w1", "w", _SMOOTH, "j")}),
st AS (SELECT vec_id, i, j, 1 - {_UNIT("h")} AS sh, 1 - {_UNIT("w")} AS sw FROM h2 JOIN w2 USING (vec_id, i, j) {_TILE}),
en AS (SELECT vec_id, i, j, CASE WHEN (vec_id, i * 8 + j) IN (SELECT vec_id, k FROM tau) THEN 1 - greatest(sh, sw) ELSE 0 END AS e FROM st),
{R.filled("m", "SELECT vec_id, i * 8 + j AS k FROM en WHERE round(e, 9) >= 0.5", 64)}, {R.regions("mk", "SELECT vec_id, k FROM m")},
marker AS (SELECT vec_id, k, root + 1 AS marker FROM mk JOIN (SELECT vec_id, root FROM mk GROUP BY ALL HAVING count(*) >= 3) USING (vec_id, root)),
g1 AS ({_lines("en", "e", _SOFT, "i")}), g2 AS ({_lines("g1", "e", _SOFT, "j")}),
{R.flooded("SELECT vec_id, i, j, round((1 - e) * 1e9)::BIGINT AS h, marker FROM g2 JOIN tau ON tau.vec_id = g2.vec_id AND tau.k = i * 8 + j LEFT JOIN marker USING (vec_id, k)").replace("SELECT vec_id, i, j, round", "SELECT g2.vec_id, i, j, round")},
lab AS (SELECT vec_id, i, j, dense_rank() OVER (PARTITION BY vec_id ORDER BY s % 1000) AS label FROM flood)
SELECT px.vec_id, px.i, px.j, coalesce(label, 0)::BIGINT AS label FROM px LEFT JOIN lab USING (vec_id, i, j)"""


@query(_HOVERNET.replace("LEFT JOIN marker USING (vec_id, k)", "LEFT JOIN marker ON marker.vec_id = tau.vec_id AND marker.k = tau.k"))
def hovernet_post(spark, sf):
    v = F.col("v")
    px = T.pixels(spark, sf).select("vec_id", "i", "j", F.lit(0.0).alias("n0"), ((v - 127) / 20.0).alias("n1"), (v % 51 / 50.0).alias("h"), (v % 37 / 36.0).alias("v"))
    return segment.hovernet(px, "vec_id", 3, 5)


_ERODED = "SELECT p.vec_id, p.i, p.j, CASE WHEN bool_or(q.l <> p.l) THEN 0 ELSE p.l END AS l FROM lab p LEFT JOIN lab q ON q.vec_id = p.vec_id AND abs(q.i - p.i) + abs(q.j - p.j) = 1 GROUP BY p.vec_id, p.i, p.j, p.l"

_MESMER = f"""WITH RECURSIVE {T.PX}, top AS (SELECT p.vec_id, p.i, p.j, max(q.v) AS m FROM px p JOIN px q ON q.vec_id = p.vec_id AND abs(q.i - p.i) <= 1 AND abs(q.j - p.j) <= 1 GROUP BY ALL),
{R.regions("mk", "SELECT px.vec_id, px.i * 8 + px.j AS k FROM px JOIN top USING (vec_id, i, j) WHERE v = m AND v / 255.0::DOUBLE > 0.5")},
{R.flooded("SELECT px.vec_id, i, j, round((1 - (v % 97) / 96.0::DOUBLE) * 1e9)::BIGINT AS h, root + 1 AS marker FROM px LEFT JOIN mk ON mk.vec_id = px.vec_id AND mk.k = i * 8 + j WHERE (v % 97) / 96.0::DOUBLE > 0.2")},
lab AS (SELECT px.vec_id, px.i, px.j, coalesce(s % 1000, 0) AS l FROM px LEFT JOIN flood USING (vec_id, i, j)), er AS ({_ERODED}),
big AS (SELECT vec_id, l FROM er WHERE l > 0 GROUP BY ALL HAVING count(*) >= 2), own AS (SELECT vec_id, l, row_number() OVER (PARTITION BY vec_id ORDER BY l) AS label FROM big)
SELECT vec_id, i, j, coalesce(label, 0)::BIGINT AS label FROM er LEFT JOIN own USING (vec_id, l)"""


@query(_MESMER)
def mesmer_watershed(spark, sf):
    px = T.pixels(spark, sf).select("vec_id", "i", "j", (F.col("v") / 255.0).alias("maxima"), (F.col("v") % 97 / 96.0).alias("interior"))
    return segment.deep_watershed(px, "vec_id", radius=1, maxima_threshold=0.5, interior_threshold=0.2, interior_smooth=0, label_erosion=1, small_objects=2, how="peak_local_max")


@query(f"""WITH {T.PX} SELECT vec_id, i, j, v / 255.0::DOUBLE AS cell_maxima, (v % 11)::DOUBLE AS cell_interior, (v % 7)::DOUBLE AS nucleus_maxima, (v % 5)::DOUBLE AS nucleus_interior FROM px""")
def mesmer_format(spark, sf):
    v = F.col("v")
    channels = lambda *c: F.array(*(x.cast("double") for x in c))
    px = T.pixels(spark, sf).select("vec_id", "i", "j", F.array(channels(v / 255.0), channels(v, v % 11), channels(v % 7), channels(v, v % 5)).alias("outputs"))
    cell, nucleus = segment.mesmer_outputs(F.col("outputs"))
    out = px.select("vec_id", "i", "j", cell.alias("c"), nucleus.alias("n"))
    return out.select("vec_id", "i", "j", F.col("c.maxima").alias("cell_maxima"), F.col("c.interior").alias("cell_interior"), F.col("n.maxima").alias("nucleus_maxima"), F.col("n.interior").alias("nucleus_interior"))


def _normalised(source: str) -> str:
    """Values stretched to 0..255 and equalised in blocks of 4 with 32 bins, clipped at an eighth of a block."""
    return f"""r AS (SELECT vec_id, i, j, (v - min(v) OVER t)::DOUBLE / nullif((max(v) OVER t - min(v) OVER t)::DOUBLE, 0) * 255 AS v FROM {source} {_TILE}),
b AS (SELECT vec_id, i, j, floor(coalesce(v, 0) * 32 / 256)::INT AS bin FROM r), {R.equalised("b", 4, 4.0, 32)}"""


@query(f"WITH {T.PX}, {_normalised('px')} SELECT vec_id, i, j, round(cdf, 6) AS v FROM equal")
def histogram_normalization(spark, sf):
    return segment.histogram_normalization(T.pixels(spark, sf), ("vec_id",), 4, 0.125, 32).select("vec_id", "i", "j", _r("v"))


@query(f"WITH {T.PX}, cap AS (SELECT vec_id, quantile_cont(nullif(v, 0)::DOUBLE, 0.9) AS cap FROM px GROUP BY 1), clipped AS (SELECT vec_id, i, j, least(v::DOUBLE, cap) AS v FROM px JOIN cap USING (vec_id)), {_normalised('clipped')} SELECT vec_id, i, j, round(cdf, 6) AS v FROM equal")
def mesmer_preprocess(spark, sf):
    px = T.pixels(spark, sf).withColumn("v", F.col("v").cast("double"))
    return segment.mesmer_preprocess(px, ("vec_id",), 0.9, 4, 0.125, 32).select("vec_id", "i", "j", _r("v"))


# ---- single-cell tables


def _cells(instances: str) -> str:
    """CTE ``cells`` (graph_id, label, area, y, x, mean_v, min_v, max_v, filled_area, euler) of ``inst``."""
    return f"""{instances}, other AS (SELECT l.graph_id, l.label, p.i, p.j FROM (SELECT DISTINCT graph_id, label FROM inst WHERE label <> 0) l JOIN inst p ON p.graph_id = l.graph_id AND p.label <> l.label),
outer_r AS (SELECT * FROM other WHERE i IN (0, 7) OR j IN (0, 7) UNION SELECT o.graph_id, o.label, o.i, o.j FROM outer_r r JOIN other o ON o.graph_id = r.graph_id AND o.label = r.label AND abs(o.i - r.i) + abs(o.j - r.j) = 1),
inner_n AS (SELECT graph_id, label, count(*) AS n FROM (SELECT * FROM other EXCEPT SELECT * FROM outer_r) GROUP BY ALL),
quad AS (SELECT graph_id, label, i - a AS y, j - b AS x, sum(1 << (2 * a + b))::INT AS q FROM inst, range(2) s(a), range(2) t(b) WHERE label <> 0 GROUP BY ALL),
eu AS (SELECT graph_id, label, floor(sum(CASE WHEN q IN (1, 2, 4, 8) THEN 1 WHEN q IN (7, 11, 13, 14) THEN -1 WHEN q IN (6, 9) THEN -2 ELSE 0 END) / 4)::BIGINT AS euler FROM quad GROUP BY ALL),
cells AS (SELECT graph_id, label, count(*)::BIGINT AS area, avg(i) AS y, avg(j) AS x, avg(v) AS mean_v, min(v) AS min_v, max(v) AS max_v, (count(*) + coalesce(any_value(n), 0))::BIGINT AS filled_area, any_value(euler) AS euler
  FROM inst LEFT JOIN inner_n USING (graph_id, label) JOIN eu USING (graph_id, label) WHERE label <> 0 GROUP BY graph_id, label)"""


@query(f"WITH RECURSIVE {_cells(T.INST)} SELECT graph_id, label, area, round(y + 100, 6) AS y, round(x + 7, 6) AS x, round(mean_v, 6) AS mean_v, min_v, max_v, filled_area, euler FROM cells")
def quantify_mif(spark, sf):
    tiles = T.instances(spark, sf).withColumns({"tile_i": F.lit(100), "tile_j": F.lit(7)})
    return quantify.quantify_mif(tiles, "graph_id", ("v",), ("tile_i", "tile_j")).select("graph_id", "label", "area", _r("y"), _r("x"), _r("mean_v"), "min_v", "max_v", "filled_area", "euler")


@query(f"""WITH RECURSIVE {T.PX}, {R.regions("s", "SELECT vec_id, i * 8 + j AS k FROM px WHERE v > 127")}, named AS (SELECT vec_id, k, dense_rank() OVER (PARTITION BY vec_id ORDER BY root) AS label FROM s),
{_cells("inst AS (SELECT px.vec_id AS graph_id, px.i, px.j, px.v, coalesce(label, 0) AS label FROM px LEFT JOIN named ON named.vec_id = px.vec_id AND named.k = px.i * 8 + px.j)")}
SELECT 'slide ' || graph_id || CASE graph_id % 2 WHEN 0 THEN 'A' ELSE 'B' END AS region, label::BIGINT AS label, area, round(mean_v, 6) AS mean_c0, min_v AS min_c1, filled_area, euler FROM cells""")
def vectra_workflow(spark, sf):
    """Slides of two runs; a slide's second channel is its first."""
    px = T.pixels(spark, sf)
    run = F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B")
    name = F.concat(F.lit("SlideData(name='slide "), F.col("vec_id"), F.lit("X_scan'"))
    planes = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(z).alias("z")) for c in (0, 1) for z in (0, 1))))
    slides = px.select(run.alias("run"), name.alias("name"), F.col("i").alias("x"), F.col("j").alias("y"), "v", planes.alias("p")).select("run", "name", "x", "y", "p.z", "p.c", F.lit(0).alias("t"), (F.col("v") + 1000 * F.col("p.z")).alias("v"))

    def parts(wide: DataFrame) -> DataFrame:
        found = labels.label_regions(wide.filter("c0 > 127"), "name")
        first = found.select("name", "ri", "rj").distinct().withColumn("label", F.expr("row_number() OVER (PARTITION BY name ORDER BY ri, rj)").cast("long"))
        return found.join(first, ["name", "ri", "rj"]).select("name", "i", "j", "label")

    return quantify.vectra_workflow(slides, parts, 2).select("region", "label", "area", _r("mean_c0"), "min_c1", "filled_area", "euler")


@query("""SELECT c_custkey, regexp_replace(regexp_replace(c_name || '(X)' || chr(10) || '#.tif', '[^a-zA-Z0-9 \\n\\.]', '', 'g'), '\\n', '', 'g') AS region FROM customer""")
def region_names(spark, sf):
    return T.read(spark, sf, "customer").select("c_custkey", quantify.region_name(F.concat("c_name", F.lit("(X)\n#.tif"))).alias("region"))


# ---- instance maps, patches


@query(f"""WITH RECURSIVE {T.PX}, t AS (SELECT vec_id // 4 AS vec_id, (vec_id % 4) // 2 * 4 + i AS i, vec_id % 2 * 4 + j AS j, v, vec_id % 4 AS o FROM px), st AS (SELECT vec_id, i, j, max_by(v, o) AS v FROM t WHERE i < 8 AND j < 8 GROUP BY ALL),
{R.regions("f", "SELECT vec_id, i * 8 + j AS k FROM st WHERE v > 127")}
SELECT vec_id AS slide_id, (root // 8)::INT AS ri, (root % 8)::INT AS rj, count(*)::BIGINT AS area, round_even(avg(k % 8), 0)::BIGINT AS cx, round_even(avg(k // 8), 0)::BIGINT AS cy FROM f GROUP BY ALL""")
def full_instance_map(spark, sf):
    place = lambda c: F.floor(c).cast("int")
    tiles = T.pixels(spark, sf).select(F.floor(F.col("vec_id") / 4).alias("slide_id"), (place(F.col("vec_id") % 4 / 2) * 4).alias("tile_i"), (place(F.col("vec_id") % 2) * 4).alias("tile_j"), "i", "j", "v")
    return labels.instance_map(tiles, 8, 8, 127)


@query(f"""WITH {T.INST}, b AS (SELECT graph_id, label, round_even(avg(i), 0)::INT AS ci, round_even(avg(j), 0)::INT AS cj, min(i) AS li, max(i) + 1 AS hi, min(j) AS lj, max(j) + 1 AS hj FROM inst WHERE label <> 0 GROUP BY ALL),
pt AS (SELECT graph_id, label, ci + 3 * a - 1 AS y, cj + 3 * c - 1 AS x FROM b, range(-4, 5) s(a), range(-4, 5) t(c) WHERE ci + 3 * a BETWEEN li AND hi AND cj + 3 * c BETWEEN lj AND hj)
SELECT pt.graph_id, pt.label, y::INT AS y, x::INT AS x, count(*)::BIGINT AS overlap FROM pt JOIN inst p ON p.graph_id = pt.graph_id AND p.label = pt.label AND p.i BETWEEN y AND y + 2 AND p.j BETWEEN x AND x + 2 GROUP BY ALL HAVING count(*) > 2""")
def tissue_patches(spark, sf):
    return graph.tissue_patches(T.instances(spark, sf), ("graph_id",), 3, 2)


@query(f"""WITH {T.INST}, mid AS (SELECT graph_id, label, floor(avg(i))::INT - 1 AS y, floor(avg(j))::INT - 1 AS x FROM inst WHERE label <> 0 GROUP BY ALL)
SELECT mid.graph_id, mid.label, y, x, count(*)::BIGINT AS overlap FROM mid JOIN inst p ON p.graph_id = mid.graph_id AND p.label = mid.label AND p.i BETWEEN y AND y + 2 AND p.j BETWEEN x AND x + 2 GROUP BY ALL HAVING count(*) >= 2""")
def cell_patches(spark, sf):
    return graph.cell_patches(T.instances(spark, sf), ("graph_id",), 3, 2)


@query(f"""WITH {R.superpixels(2, 8.0, 2)}, s AS (SELECT vec_id, li, lj FROM l2 GROUP BY ALL HAVING avg(CASE WHEN v > 100 THEN 1 ELSE 0 END) >= 0.5)
SELECT vec_id, i, j, li || ':' || lj AS label FROM l2 SEMI JOIN s USING (vec_id, li, lj)""")
def superpixels_in_tissue(spark, sf):
    """The pixels of the superpixels half of which is tissue."""
    px = T.pixels(spark, sf)
    clusters = labels.superpixels(px, "vec_id", 2, 8.0, 2)
    return labels.without_background(clusters, "vec_id", px.filter("v > 100"), 0.5).select("vec_id", "i", "j", "label")


# ---- losses, pools, graph features


@query(f"""WITH {T.PX}, f AS (SELECT vec_id, i, j, (v + 1) / 257.0::DOUBLE AS p, (v % 3 = 0)::INT AS mask, (v % 51) / 50.0::DOUBLE AS h, (v % 37) / 36.0::DOUBLE AS w, (v % 13) / 12.0::DOUBLE AS th, (v % 17) / 16.0::DOUBLE AS tw FROM px),
g AS (SELECT p.vec_id, p.i, p.j, any_value(p.mask) AS mask, sum((q.h - q.th) * (q.j - p.j) / ((q.i - p.i) * (q.i - p.i) + (q.j - p.j) * (q.j - p.j) + 1e-5::DOUBLE)) AS gh, sum((q.w - q.tw) * (q.i - p.i) / ((q.i - p.i) * (q.i - p.i) + (q.j - p.j) * (q.j - p.j) + 1e-5::DOUBLE)) AS gw
  FROM f p JOIN f q ON q.vec_id = p.vec_id AND abs(q.i - p.i) <= 2 AND abs(q.j - p.j) <= 2 GROUP BY p.vec_id, p.i, p.j), gr AS (SELECT vec_id, avg(gh * gh) + avg(gw * gw) AS grad FROM g WHERE mask = 1 GROUP BY 1),
a AS (SELECT vec_id, 1 - (2 * sum(p * mask) + 1e-3::DOUBLE) / (sum(p) + sum(mask) + 1e-3::DOUBLE) - avg(mask * ln(p) + (1 - mask) * ln(1 - p)) + (avg((h - th) * (h - th)) + avg((w - tw) * (w - tw))) / 2 AS rest FROM f GROUP BY 1)
SELECT vec_id, round(rest + 2 * coalesce(grad, 0), 5) AS loss FROM a LEFT JOIN gr USING (vec_id)""")
def hovernet_loss(spark, sf):
    v = F.col("v")
    px = T.pixels(spark, sf).select(
        "vec_id", "i", "j", ((v + 1) / 257.0).alias("p"), (v % 3 == 0).cast("int").alias("mask"), (v % 51 / 50.0).alias("h"), (v % 37 / 36.0).alias("v"), (v % 13 / 12.0).alias("th"), (v % 17 / 16.0).alias("tv")
    )
    return metrics.hovernet_loss(px, "vec_id").select("vec_id", _r("loss", 5))


@query(f"WITH {T.POINTS} SELECT graph_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM pts GROUP BY 1")
def graph_mean_pool(spark, sf):
    return metrics.mean_pool(T.points(spark, sf), ("x", "y")).select("graph_id", _r("x"), _r("y"))


@query(f"""WITH {T.KNN}, deg AS (SELECT pts.graph_id, node, x / 1000.0::DOUBLE AS x, y / 1000.0::DOUBLE AS y, 1 + count(src) AS d FROM pts LEFT JOIN knn ON knn.graph_id = pts.graph_id AND knn.dst = pts.node GROUP BY ALL),
met AS (SELECT graph_id, node, x / d AS x, y / d AS y FROM deg UNION ALL SELECT b.graph_id, b.node, a.x / sqrt(a.d * b.d::DOUBLE), a.y / sqrt(a.d * b.d::DOUBLE)
  FROM knn JOIN deg a ON a.graph_id = knn.graph_id AND a.node = src JOIN deg b ON b.graph_id = knn.graph_id AND b.node = dst),
one AS (SELECT graph_id, node, greatest(0.5 * sum(x) - 0.25 * sum(y) + 0.1, -1e9) AS a, 0.75 * sum(x) + 1.5 * sum(y) - 0.2 AS b, 2.0 * sum(y) + 0.3 AS c FROM met GROUP BY ALL)
SELECT graph_id, node, round(((a - 0.5) / sqrt(4 + 1e-5::DOUBLE))::DOUBLE, 5) AS a, round(((b - 0.5) / sqrt(4 + 1e-5::DOUBLE))::DOUBLE, 5) AS b, round(((c - 0.5) / sqrt(4 + 1e-5::DOUBLE))::DOUBLE, 5) AS c FROM one""")
def gnn_layer(spark, sf):
    """One graph convolution over nearest neighbours with normalisation, two channels to three."""
    points = T.points(spark, sf)
    nodes = points.select("graph_id", "node", F.array(F.col("x") / 1000.0, F.col("y") / 1000.0).alias("x"))
    weights = {"weight": np.array([[0.5, 0.75, 0.0], [-0.25, 1.5, 2.0]]), "bias": np.array([0.1, -0.2, 0.3]), "mean": np.full(3, 0.5), "variance": np.full(3, 4.0)}
    out = gnn.convolve(nodes, graph.knn_graph(points, 5), gnn.Layer("gcn", weights), 2)
    return out.select("graph_id", "node", *(F.round(F.col("x")[k], 5).alias(c) for k, c in enumerate("abc")))


@query(f"""WITH {T.KNN}, n AS (SELECT graph_id, node, row_number() OVER (ORDER BY graph_id, node) - 1 AS number FROM pts)
SELECT knn.graph_id, a.number AS src, b.number AS dst FROM knn JOIN n a ON a.graph_id = knn.graph_id AND a.node = src JOIN n b ON b.graph_id = knn.graph_id AND b.node = dst""")
def graph_batch(spark, sf):
    return graph.batch(T.points(spark, sf), graph.knn_graph(T.points(spark, sf), 5))[1]


@query(f"WITH {T.KNN} SELECT pts.graph_id, node, x, y, count(src)::BIGINT AS degree, any_value(p_type) AS target FROM pts LEFT JOIN knn ON knn.graph_id = pts.graph_id AND knn.dst = pts.node LEFT JOIN part ON p_partkey = pts.graph_id GROUP BY pts.graph_id, node, x, y")
def graph_build(spark, sf):
    target = T.read(spark, sf, "part").select(F.col("p_partkey").alias("graph_id"), F.col("p_type").alias("target"))
    return graph.build(T.points(spark, sf), graph.knn_graph(T.points(spark, sf), 5), target)


@query(R.features(8))
def graph_features(spark, sf):
    nodes = T.points(spark, sf)
    found = graph.features(nodes, graph.knn_graph(nodes, 5), 8, None)
    return found.select("graph_id", *(F.round(F.col(c).cast("double"), 5).alias(c) for c in found.columns if c != "graph_id"))


@query(R.vahadane(10, 0.1, stain.REFERENCE, 0.15))
def stain_vahadane(spark, sf):
    found = stain.sparse_stain_vectors(T.rgb(spark, sf).withColumn("slide", F.col("vec_id") % 20), "slide")
    return found.select("slide", *(F.round(F.col(n)[k], 5).alias(f"{n}{k}") for k in range(3) for n in "he"))


@query()
def color_merged_superpixels(spark, sf):
    px = T.pixels(spark, sf)
    clusters = labels.superpixels(px, "vec_id", 2, 8.0, 2)
    rgb = px.select("vec_id", "i", "j", F.col("v").alias("r"), F.floor(F.col("v") * F.col("v") / 255).alias("g"), (255 - F.col("v")).alias("b"))
    return labels.merge_by_color(rgb.join(clusters, ["vec_id", "i", "j"]), "vec_id", 0.1)


# ---- resampling and borders


def _spline(size: int, n: int = 8) -> str:
    """Rows (o, p, w): the weight of each of ``n`` pixels in each of ``size`` new ones, from the inverse of the splines' dense system."""
    system = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    system[0, 1] = system[-1, -2] = 2.0
    x = np.arange(size) * (n - 1) / (size - 1)
    far = np.abs(x[:, None] - np.arange(-1, n + 1)[None, :])
    bump = np.where(far < 1, 4 - 6 * far**2 + 3 * far**3, np.where(far < 2, (2 - far) ** 3, 0.0))
    folded = bump[:, 1:-1].copy()
    folded[:, 1] += bump[:, 0]
    folded[:, -2] += bump[:, -1]
    weights = folded @ np.linalg.inv(system)
    return ", ".join(f"({o}, {p}, {weights[o, p]!r}::DOUBLE)" for o in range(size) for p in range(n)).replace("np.float64(", "").replace(")::", "::")


@query(f"""WITH {T.PX}, r AS (SELECT * FROM (VALUES {_spline(5)}) t(o, p, w)), c AS (SELECT * FROM (VALUES {_spline(11)}) t(o, p, w))
SELECT vec_id, r.o::INT AS i, c.o::INT AS j, round(sum(r.w * c.w * v), 5) AS v FROM px JOIN r ON r.p = px.i JOIN c ON c.p = px.j GROUP BY ALL""")
def spline_thumbnail(spark, sf):
    """Tiles of 8 by 8 as images of 5 by 11."""
    return resample.zoom(T.pixels(spark, sf), ("vec_id",), (5, 11)).select("vec_id", "i", "j", _r("v", 5))


def _boxes(place: str) -> str:
    """Pixels p with those of the box of 3 by 3 around them as q, outer places as ``place`` says."""
    return f"px p CROSS JOIN range(-1, 2) x(a) CROSS JOIN range(-1, 2) y(b) JOIN px q ON q.vec_id = p.vec_id AND q.i = {place.format('p.i + a')} AND q.j = {place.format('p.j + b')}"


@query(f"WITH {T.PX} SELECT p.vec_id, p.i, p.j, round(avg(q.v), 5) AS v FROM {_boxes(_mirror('{0}'))} GROUP BY ALL")
def box_blur_reflected(spark, sf):
    return stencil.blur_within(T.pixels(spark, sf), ("vec_id",), "box", 3).select("vec_id", "i", "j", _r("v", 5))


@query(f"WITH {T.PX} SELECT p.vec_id, p.i, p.j, median(q.v) AS v FROM {_boxes('least(greatest({}, 0), 7)')} GROUP BY ALL")
def median_blur_replicated(spark, sf):
    return stencil.blur_within(T.pixels(spark, sf), ("vec_id",), "median", 3, border="replicate").select("vec_id", "i", "j", "v")


@query(f"""WITH {T.PX}, k(d, w) AS (SELECT d, exp(-d * d / 2.88::DOUBLE) FROM range(-2, 3) t(d)), g AS (SELECT a.d AS di, b.d AS dj, a.w * b.w / (SELECT sum(x.w * y.w) FROM k x, k y) AS w FROM k a, k b)
SELECT p.vec_id, p.i, p.j, round(sum(g.w * q.v), 5) AS v FROM px p CROSS JOIN g JOIN px q ON q.vec_id = p.vec_id AND q.i = {_mirror('p.i + di')} AND q.j = {_mirror('p.j + dj')} GROUP BY ALL""")
def gaussian_blur_reflected(spark, sf):
    return stencil.blur_within(T.pixels(spark, sf), ("vec_id",), "gaussian", 5, 1.2).select("vec_id", "i", "j", _r("v", 5))
