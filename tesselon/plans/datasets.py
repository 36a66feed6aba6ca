"""Queries over data sets, stores, frames and shapes of images."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.operators import grid, point
from tesselon.plans import tables as T
from tesselon.plans.registry import query
from tesselon.plans.registry import rounded as _r
from tesselon.sources import datasets, store

# ---- frames, levels, tiles


@query("""WITH s AS (SELECT o_orderkey AS slide_id, 1 + o_orderkey % 9 AS n_cols, (1 + o_orderkey % 9) * (1 + o_orderkey % 5) AS n_frames FROM orders)
SELECT slide_id, frame, frame // n_cols * 500 AS tile_i, frame % n_cols * 500 AS tile_j FROM s, range(45) f(frame) WHERE frame < n_frames - n_cols AND frame % n_cols < n_cols - 1""")
def dicom_tiles(spark, sf):
    key = F.col("o_orderkey")
    slides = T.read(spark, sf, "orders").select(key.alias("slide_id"), (1 + key % 9).alias("n_cols"), ((1 + key % 9) * (1 + key % 5)).alias("n_frames"))
    return grid.dicom_tiles(slides, 500, 500).select("slide_id", "frame", "tile_i", "tile_j")


@query(f"""WITH {T.PX} SELECT vec_id, (a * 2)::INT AS tile_i, (b * 2)::INT AS tile_j, (i - a * 2)::INT AS i, (j - b * 2)::INT AS j, v FROM px, range(3) s(a), range(3) t(b) WHERE i BETWEEN a * 2 AND a * 2 + 3 AND j BETWEEN b * 2 AND b * 2 + 3""")
def extract_tiles(spark, sf):
    return grid.extract_tiles(T.pixels(spark, sf), ("vec_id",), 4, 2)


@query(f"""WITH {T.PX} SELECT e.vec_id, (a * 5)::INT AS tile_i, (b * 5)::INT AS tile_j, i2::INT AS i, j2::INT AS j, coalesce(v, 0) AS v FROM (SELECT vec_id FROM embeddings) e CROSS JOIN range(2) s(a) CROSS JOIN range(2) t(b) CROSS JOIN range(5) x(i2) CROSS JOIN range(5) y(j2)
LEFT JOIN px ON px.vec_id = e.vec_id AND px.i = a * 5 + i2 AND px.j = b * 5 + j2""")
def padded_tiles(spark, sf):
    return grid.padded_tiles(T.pixels(spark, sf), ("vec_id",), 5)


@query(f"""WITH {T.SLIDES} SELECT slide_id, level, floor(height / (4.0::DOUBLE ** level * 1.01))::INT AS height, floor(width / (4.0::DOUBLE ** level * 1.01))::INT AS width FROM slides, range(3) l(level)""")
def level_shapes(spark, sf):
    slides = T.slides(spark, sf).withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    h, w = grid.level_shape(F.col("height"), F.col("width"), F.pow(F.lit(4.0), F.col("level")) * 1.01)
    return slides.select("slide_id", "level", h.alias("height"), w.alias("width"))


@query(f"""WITH {T.PX}, half AS (SELECT vec_id, (i // 2)::INT AS i, (j // 2)::INT AS j, avg(v) AS v FROM px GROUP BY ALL) SELECT vec_id, i - 1 AS i, j - 2 AS j, v FROM half WHERE i BETWEEN 1 AND 2 AND j BETWEEN 2 AND 3""")
def region_at_level(spark, sf):
    px = T.pixels(spark, sf).withColumn("v", F.col("v").cast("double"))
    levels = px.withColumn("level", F.lit(0)).unionByName(grid.thumbnail(px, 2, ("vec_id",)).withColumn("level", F.lit(1)))
    return grid.region_at_level(levels, {0: 1.0, 1: 2.02}, (3, 4), (2, 2), 1)


@query(f"""WITH {T.PX} SELECT vec_id, (i * 3 // 8)::INT AS i, (j * 5 // 8)::INT AS j, round(avg(v), 6) AS v FROM px GROUP BY ALL""")
def thumbnail_of_size(spark, sf):
    return grid.thumbnail_of(T.pixels(spark, sf), ("vec_id",), (3, 5), 8, 8).select("vec_id", "i", "j", _r("v"))


@query(f"""WITH {T.SLIDES} SELECT slide_id, height, width FROM slides WHERE height * width BETWEEN 100000 AND 300000""")
def slides_fit_for_graphs(spark, sf):
    return grid.fit_for_graphs(T.slides(spark, sf), 100_000, 300_000)


@query("""SELECT user_id, event_id, 'Fluor' AS stain FROM events""")
def stain_required(spark, sf):
    return grid.require(T.read(spark, sf, "events").select("user_id", "event_id", F.lit("Fluor").alias("stain")), "stain", "Fluor", "quantification")


# ---- channels and ranges


@query("""SELECT vec_id, j::INT AS j, embedding[j * 4 + 1] AS r, embedding[j * 4 + 2] AS g, embedding[j * 4 + 3] AS b FROM embeddings, range(16) t(j)""")
def drop_alpha(spark, sf):
    e = T.read(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("j"))
    return point.drop_alpha(e.select("vec_id", "j", *(F.col("embedding")[F.col("j") * 4 + k].alias(c) for k, c in enumerate("rgba"))))


@query(f"""WITH {T.PX} SELECT vec_id, i, j, round((least(greatest(v, 40), 200) - 40) / 160.0::DOUBLE * 2 - 1, 6) AS v FROM px""")
def rescale_in_range(spark, sf):
    return point.rescale_intensity(T.pixels(spark, sf), ("vec_id",), -1.0, 1.0, in_range=(40, 200)).select("vec_id", "i", "j", _r("v"))


@query(f"""WITH {T.PX} SELECT vec_id, i AS x, (j // 2)::INT AS y, (j % 2)::INT AS c, v FROM px""")
def squeeze_vectra(spark, sf):
    five = T.pixels(spark, sf).select("vec_id", F.col("i").alias("x"), F.floor(F.col("j") / 2).cast("int").alias("y"), F.lit(0).alias("z"), (F.col("j") % 2).cast("int").alias("c"), F.lit(0).alias("t"), "v")
    return point.squeeze(five)


@query(f"""WITH {T.PX} SELECT vec_id, i, (j // 4)::INT AS j, 1 - v // 128 AS v FROM px WHERE j % 4 = 3""")
def mask_to_binary(spark, sf):
    px = T.pixels(spark, sf).select("vec_id", "i", F.floor(F.col("j") / 4).cast("int").alias("j"), (F.col("j") % 4).alias("c"), F.floor(F.col("v") / 128).alias("v"))
    return point.foreground_of_classes(px, 4)


# ---- data sets and stores


@query("""SELECT vec_id // 10 AS slide_id, (vec_id % 10)::INT AS tile_i, '4,2,8' AS shape, p::INT AS p, embedding[(p % 16) * 4 + p // 16 + 1] AS v, embedding[p % 16 + p // 16 % 2 * 16 + 1] AS mask, 'L' || (vec_id // 10) AS slide_label FROM embeddings, range(64) r(p)""")
def tile_dataset(spark, sf):
    e = T.read(spark, sf, "embeddings")
    whole = lambda a, b: F.slice("embedding", a, b)
    tiles = e.select(
        F.floor(F.col("vec_id") / 10).alias("slide_id"), (F.col("vec_id") % 10).cast("int").alias("tile_i"), F.lit(0).alias("tile_j"), F.col("embedding").alias("image"), F.array(*map(F.lit, (2, 8, 4))).alias("shape"),
        F.create_map(F.lit("nucleus"), whole(17, 16), F.lit("cell"), whole(1, 16)).alias("masks"), F.create_map(F.lit("kind"), F.col("label").cast("string")).alias("labels"),
    )
    slides = tiles.select("slide_id").distinct().withColumn("labels", F.create_map(F.lit("name"), F.concat(F.lit("L"), "slide_id"), F.lit("site"), F.lit(None).cast("string")))
    found = datasets.tile_dataset(tiles, slides)
    flat = found.select("slide_id", "tile_i", F.array_join("shape", ",").alias("shape"), F.posexplode("image").alias("p", "v"), "masks", F.col("slide_labels")["name"].alias("slide_label"))
    mask = F.col("masks")[F.floor(F.col("p") / 16).cast("int") % 2][F.col("p") % 16]
    return flat.select("slide_id", "tile_i", "shape", "p", "v", mask.alias("mask"), "slide_label")


@query("""SELECT 'slide_' || c_custkey AS name, c_nationkey AS cell, s_nationkey AS tissue, (c_custkey * 3)::BIGINT AS assignment, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_name END, c_name) AS target FROM customer JOIN supplier ON s_suppkey = c_custkey""")
def entity_dataset(spark, sf):
    c, s = T.read(spark, sf, "customer"), T.read(spark, sf, "supplier")
    path = lambda folder, key: F.concat(F.lit(f"/data/{folder}/slide_"), F.col(key), F.lit(".pt")).alias("path")
    cells = c.select(path("cells", "c_custkey"), F.col("c_nationkey").alias("graph"), F.col("c_name").alias("target"))
    tissues = s.select(path("tissues", "s_suppkey"), F.col("s_nationkey").alias("graph"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("target"))
    assigned = c.select(path("assign", "c_custkey"), F.array(F.col("c_custkey"), F.col("c_custkey") * 3).alias("graph"))
    return datasets.entity_dataset(cells, tissues, assigned)


@query("""WITH b AS (SELECT l_orderkey AS fold, list(l_returnflag || '_' || l_linestatus ORDER BY l_linenumber, l_returnflag || '_' || l_linestatus) AS types FROM lineitem GROUP BY ALL),
o AS (SELECT fold, replace(unnest(types), '_', '-') AS tissue, generate_subscripts(types, 1) - 1 AS k FROM b)
SELECT fold, k::INT AS k, tissue, 'images/fold' || fold || '_' || k || '_' || tissue || '.png' AS image_file, 'masks/fold' || fold || '_' || k || '_' || tissue || '.npy' AS mask_file FROM o""")
def pannuke_files(spark, sf):
    one = F.struct("l_linenumber", F.concat_ws("_", "l_returnflag", "l_linestatus").alias("t"))
    folds = T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("fold")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]).alias("types"))
    return datasets.pannuke_files(folds)


@query("""SELECT vec_id, p::INT AS p, embedding[p % 16 * 4 + p // 16 + 1] AS v FROM embeddings, range(64) r(p)""")
def pannuke_masks(spark, sf):
    found = datasets.pannuke_masks(T.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("mask")), 4)
    return found.select("vec_id", F.posexplode("mask").alias("p", "v"))


@query("""SELECT CASE WHEN idx < 163200 THEN 1 WHEN idx < 183600 THEN 2 ELSE 3 END AS fold, count(*)::BIGINT AS n, sum(l_quantity) AS total FROM (SELECT (l_orderkey * 34 + l_linenumber) % 204000 AS idx, l_quantity FROM lineitem) GROUP BY 1""")
def focus_folds(spark, sf):
    rows = T.read(spark, sf, "lineitem").select(((F.col("l_orderkey") * 34 + F.col("l_linenumber")) % datasets.FOCUS_ROWS).alias("idx"), "l_quantity")
    folds = [datasets.focus_fold(rows, k).groupBy(F.lit(k).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total")) for k in datasets.FOCUS_FOLDS]
    return folds[0].unionByName(folds[1]).unionByName(folds[2])


@query("""SELECT l_orderkey AS slide_id, l_linenumber AS tile_i, l_quantity AS q FROM lineitem WHERE l_linenumber = 3""")
def tiles_by_place(spark, sf):
    tiles = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").alias("tile_i"), F.lit(0).alias("tile_j"), F.col("l_quantity").alias("q"))
    return store.get_tile(tiles, "(3, 0)").select("slide_id", "tile_i", "q")


@query("""SELECT vec_id, 'cell,nucleus' AS names, p::INT AS p, embedding[p + 1]::DOUBLE * 2 AS cell FROM embeddings, range(64) r(p)""")
def masks_added_and_updated(spark, sf):
    mask = lambda data: F.struct(F.array(F.lit(8), F.lit(8)).alias("shape"), data.alias("data"))
    own = F.transform("embedding", lambda x: x.cast("double"))
    tiles = T.read(spark, sf, "embeddings").select("vec_id", F.col("embedding"), F.create_map(F.lit("cell"), mask(own)).alias("masks"))
    tiles = tiles.withColumn("masks", store.add_mask("masks", "nucleus", mask(own)))
    tiles = tiles.withColumn("masks", store.update_mask("masks", "cell", mask(F.transform("embedding", lambda x: x.cast("double") * 2))))
    return tiles.select("vec_id", F.array_join(F.array_sort(F.map_keys("masks")), ",").alias("names"), F.posexplode(F.col("masks")["cell"]["data"]).alias("p", "cell"))
