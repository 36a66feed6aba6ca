import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators import graph, grid, infer, labels, metrics, point, quantify, segment, stain, stencil, threshold, tiles
from tesselon.plans.pipeline import Pipeline, Step, step
from tesselon.sources import datasets, images, store
from tesselon.streaming import arrivals


def frame(spark, image, name="v"):
    return spark.createDataFrame([(0, i, j, int(v)) for (i, j), v in np.ndenumerate(image)], f"k int, i int, j int, {name} int")


def array(df, shape, value="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["j"]] = r[value]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(4).integers(0, 256, (12, 9))


def test_tile_counts(spark):
    slide = spark.createDataFrame([(1, 2967, 2220)], "slide_id int, height int, width int")
    assert grid.tile_grid(slide, (300, 300)).count() == 63
    assert grid.tile_grid(slide, (300, 300), pad=True).count() == 80
    small = spark.createDataFrame([(1, 5, 5)], "slide_id int, height int, width int")
    assert grid.tile_grid(small, (3, 3), (2, 2), pad=True).count() == 9
    assert grid.tile_grid(small, (6, 6)).count() == 0


def test_frame_corners(spark):
    df = spark.createDataFrame([(0,), (1,), (14,), (41,)], "n int")
    i, j = grid.frame_coords(F.col("n"), F.lit(7), 500, 500)
    assert [tuple(r) for r in df.select(i, j).collect()] == [(0, 0), (0, 500), (1000, 0), (2500, 3000)]
    assert df.select(grid.frame_index(F.lit(3), F.lit(0), F.lit(7), 500, 500).alias("x")).first()["x"] is None


def test_stencils_equal_numpy(spark, image):
    df = frame(spark, image)
    pad = np.pad(image.astype(float), 1, constant_values=np.nan)
    views = np.lib.stride_tricks.sliding_window_view(pad, (3, 3)).reshape(*image.shape, 9)
    assert np.allclose(array(stencil.box_blur(df, ("k",), 3), image.shape), np.nanmean(views, axis=2))
    assert np.allclose(array(stencil.median_blur(df, ("k",), 3), image.shape), np.nanmedian(views, axis=2))
    assert np.allclose(array(stencil.erode(df, ("k",), 3), image.shape), np.nanmin(views, axis=2))
    opened = stencil.morph_open(df, ("k",), 3)
    assert np.array_equal(array(stencil.morph_open(opened, ("k",), 3), image.shape), array(opened, image.shape))


def test_otsu_equals_search(spark, image):
    best = max(np.unique(image), key=lambda t: (round((image <= t).mean() * (image > t).mean() * (image[image <= t].mean() - image[image > t].mean()) ** 2, 6) if (image > t).any() else -1, -t))
    assert threshold.otsu(frame(spark, image), ("k",)).first()["threshold"] == best


def test_clahe_without_clipping_is_local_equalisation(spark):
    flat = np.arange(64).reshape(8, 8) * 4
    whole = threshold.adaptive_equalize(frame(spark, flat), ("k",), 8, 1e9, 64)
    cdf = array(whole, flat.shape, "cdf")
    assert cdf.max() == pytest.approx(1) and (np.diff(cdf.ravel()) >= -1e-9).all()


def test_quantify_and_euler(spark):
    mask = np.zeros((50, 50), int)
    mask[25:30, 5:10] = 1
    ring = np.ones((5, 5), int) * 2
    ring[2, 2] = 0
    mask[40:45, 40:45] = ring
    df = frame(spark, mask, "label").withColumn("c", F.col("i"))
    rows = {r["label"]: r for r in quantify.quantify(df, ("k",), ("c",)).collect()}
    assert (rows[1]["y"], rows[1]["x"], rows[1]["area"]) == (27, 7, 25)
    assert {r["label"]: r["euler"] for r in quantify.euler_number(df, ("k",)).collect()} == {1: 1, 2: 0}


def test_nuclei(spark):
    mask = np.zeros((100, 100), int)
    mask[20:40, 20:40], mask[60:80, 60:80] = 1, 2
    df = frame(spark, mask, "label").withColumn("kind", F.col("label"))
    rows = {r["label"]: r for r in quantify.nuclei(df, ("k",), "kind").collect()}
    assert (rows[1]["y"], rows[2]["x"], rows[2]["type"]) == (29.5, 69.5, 2) and rows[1]["prob"] == pytest.approx(1)
    assert quantify.centroids_by_type(quantify.nuclei(df, ("k",), "kind"), 0.5).count() == 2


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1), (5, 0)], "v int, g int")
    assert {r["g"]: r["total"] for r in metrics.scatter_sum(rows, "g", "v").collect()} == {0: 9, 1: 6}
    nodes = spark.range(3).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(0, 2), (1, 1), (2, 0)], "src long, dst long")
    assert [tuple(r) for r in metrics.degree_histogram(nodes, edges).collect()] == [(1, 3)]


def brute_knn(pts, k):
    out = set()
    for n, x, y in pts:
        near = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, m) for m, a, b in pts if m != n)
        out |= {(n, m) for _, m in near[:k]}
    return out


def test_knn_equals_brute_force_with_outliers(spark):
    rng = np.random.default_rng(8)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (120, 2)).round(3))] + [(500, 900.0, 900.0), (501, -50.0, 3.0)]
    df = spark.createDataFrame([(0, *p) for p in pts] + [(1, 7, 1.0, 1.0), (2, 8, 1.0, 1.0), (2, 9, 1.0, 1.0)], "graph_id int, node int, x double, y double")
    got = graph.knn_graph(df, 4).collect()
    assert {(r["src"], r["dst"]) for r in got if r["graph_id"] == 0} == brute_knn(pts, 4)
    assert {(r["src"], r["dst"]) for r in got if r["graph_id"] == 2} == {(8, 9), (9, 8)} and not [r for r in got if r["graph_id"] == 1]


def test_spanning_forest_equals_kruskal(spark):
    rng = np.random.default_rng(2)
    edges = [(g, int(a), int(b), int(w)) for g in (0, 1) for a, b, w in rng.integers(0, 25, (60, 3)) if a != b]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    expected = set()
    for w, g, a, b in sorted((w, g, min(a, b), max(a, b)) for g, a, b, w in edges):
        if root((g, a)) != root((g, b)):
            parent[root((g, a))] = root((g, b))
            expected.add((g, a, b, w))
    got = graph.spanning_forest(spark.createDataFrame(edges, "graph_id int, src int, dst int, w int"))
    assert set(map(tuple, got.collect())) == expected


def test_core_numbers_and_eccentricity(spark):
    clique = [(0, a, b) for a in range(4) for b in range(4) if a < b] + [(0, 3, 4), (0, 4, 5)]
    df = spark.createDataFrame(clique, "graph_id int, src int, dst int")
    assert {r["node"]: r["core"] for r in graph.coreness(df).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1}
    assert {r["node"]: r["eccentricity"] for r in graph.eccentricities(df).collect()} == {0: 3, 1: 3, 2: 3, 3: 2, 4: 2, 5: 3}
    assert sum(r["rank"] for r in graph.pagerank(df.selectExpr("graph_id", "explode(array(src, dst)) AS node").distinct(), df, 5).collect()) == pytest.approx(1)
    hub = graph.hits(df, 10).agg(F.sum("hub"), F.sum("authority")).first()
    assert list(hub) == pytest.approx([1, 1])
    assert graph.eigenvector(df, 20).agg(F.sum(F.col("centrality") * F.col("centrality"))).first()[0] == pytest.approx(1)


def test_small_objects_and_holes(spark):
    mask = np.zeros((40, 40), int)
    mask[5:25, 5:25] = 1
    mask[10:12, 10:12] = 0
    mask[30:32, 30:32], mask[35:37, 2:4] = 1, 1
    df = frame(spark, mask)
    assert labels.remove_small(df.filter("v > 0"), "k", 10).count() == 396
    assert labels.foreground(df, "k", 40, 40, 10, 4).count() == 400
    assert labels.fill_holes(df, "k", 40, 40, 3).count() == 404


def test_watershed_splits_at_the_ridge(spark):
    heights = np.array([[0, 1, 9, 1, 0]])
    markers = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 4, 2)], "k int, i int, j int, marker int")
    got = {r["j"]: r["marker"] for r in labels.watershed(frame(spark, heights), markers, "k").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}


def test_superpixels_follow_colour(spark):
    two = np.zeros((8, 8), int)
    two[:, 4:] = 200
    df = frame(spark, two)
    found = labels.superpixels(df, "k", 4, 1.0, 3)
    assert found.count() == 64
    assert df.join(found, ["k", "i", "j"]).groupBy("label").agg(F.countDistinct("v").alias("n")).filter("n > 1").count() == 0
    merged = labels.merge_superpixels(df.join(found, ["k", "i", "j"]), "k", 5.0)
    assert merged.select("merged").distinct().count() == 2


def test_stain_round_trip(spark):
    rng = np.random.default_rng(3)
    amounts = rng.uniform(0.3, 1.5, (400, 2)) * (rng.random((400, 2)) > 0.3) + 0.05
    od = amounts @ np.array(stain.REFERENCE)
    rgb = np.clip(256 * np.exp(-od) - 1, 0, 255).round().astype(int)
    df = spark.createDataFrame([(0, i, 0, *map(int, c)) for i, c in enumerate(rgb)], "k int, i int, j int, r int, g int, b int")
    v = stain.stain_vectors(df, "k").first()
    assert np.dot(v["h"], stain.REFERENCE[0]) > 0.98 and np.dot(v["e"], stain.REFERENCE[1]) > 0.98
    out = stain.normalize_stain(df, "k")
    assert out.count() == 400 and out.filter("r < 0 OR r > 255").count() == 0


def test_inference(spark):
    model = infer.affine_model(2.0, 1.0)
    assert infer.is_clean(model)
    tiles = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0]), (2, None), (3, [1.0])], "k int, image array<float>")
    got = {r["k"]: r["output"] for r in infer.infer(tiles, model, "k", (1, 2, 2)).collect()}
    assert got == {1: [1.0, 3.0, 5.0, 7.0], 2: None, 3: None}
    assert infer.ModelCard(name="m").as_dict()["name"] == "m"


def test_store(spark, tmp_path):
    tiles = spark.createDataFrame([(s, i, 0, 1) for s in ("a", "b") for i in (0, 256)], "slide_id string, tile_i int, tile_j int, version int")
    store.write_tiles(tiles, str(tmp_path / "t"))
    back = store.read_tiles(spark, str(tmp_path / "t"), ["a"])
    assert back.count() == 2
    new = back.filter("tile_i = 0").withColumn("version", F.lit(2))
    assert sorted(r["version"] for r in store.upsert(back, new).collect()) == [1, 2]
    assert store.remove(back, new).count() == 1
    entry = spark.sql("SELECT map('a', '1') AS m").select(store.put_entry("m", "a", F.lit("2")).alias("m")).first()["m"]
    assert entry == {"a": "2"}


def test_stream_upsert_keeps_the_newest(spark, tmp_path):
    schema = "slide_id string, tile_i int, tile_j int, n int"
    for k in (1, 2):
        spark.createDataFrame([("a", 0, 0, k), ("a", k, 0, k)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arrivals.upsert_into(arrivals.arrivals(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {(r["tile_i"], r["n"]) for r in arrivals.latest(spark, str(tmp_path / "out")).collect()}
    assert got == {(0, 2), (1, 1), (2, 2)}


def test_stream_windows_and_sessions(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "x", 1.0), ("2024-01-01 00:20:00", "x", 2.0), ("2024-01-01 03:00:00", "x", 4.0), ("2024-01-02 00:00:00", "x", 8.0)]
    spark.createDataFrame(rows, "ts string, k string, v double").selectExpr("cast(ts AS timestamp) AS ts", "k", "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: arrivals.arrivals(spark, str(tmp_path / "in"), "ts timestamp, k string, v double")
    arrivals.once(arrivals.windowed(stream(), "ts", "1 hour", "1 hour", ("k",), "v"), str(tmp_path / "w"), str(tmp_path / "cw"))
    assert sorted(r["total"] for r in spark.read.parquet(str(tmp_path / "w")).collect()) == [3.0, 4.0]
    arrivals.once(arrivals.sessions(stream(), "ts", "1 hour", "1 hour", ("k",)), str(tmp_path / "s"), str(tmp_path / "cs"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 2]


@step("invert", batch=True)
def invert(tiles):
    return tiles.assign(v=255 - tiles["v"])


@step("add", batch=True)
def add(tiles, n):
    return tiles.assign(v=tiles["v"] + n)


@step("keep_above")
def keep_above(tiles, level):
    return tiles.filter(F.col("v") > level)


def test_pipeline_fuses_and_saves(spark, image):
    flow = Pipeline([Step("invert"), Pipeline([Step("add", {"n": 3})]), Step("keep_above", {"level": 100}), Step("invert")])
    again = Pipeline.from_json(flow.to_json())
    out = again.run(frame(spark, image).withColumn("v", F.col("v").cast("long")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2 and len(again) == 4 and json.loads(flow.to_json())[1]["params"] == {"n": 3}
    expected = sorted(255 - (255 - v + 3) for v in image.ravel() if 255 - v + 3 > 100)
    assert sorted(r["v"] for r in out.collect()) == expected
    with pytest.raises(ValueError):
        Step("unknown")


def tiff(image):
    h, w, c = image.shape
    raw = image.astype(np.uint8).tobytes()
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, c), (279, 4, 1, len(raw))]
    return b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)


def test_tiff_tiles(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (5, 7, 3))
    (tmp_path / "a.tif").write_bytes(tiff(image))
    (tmp_path / "b.tif").write_bytes(b"not an image")
    found = images.files(spark, str(tmp_path), "*.tif")
    assert found.count() == 2 and found.filter(images.is_tiff(F.col("content"))).count() == 1
    tiles = images.tiff_tiles(found, 4)
    assert tiles.count() == 4
    back = np.zeros_like(image)
    for r in images.pixels(tiles, ("tile_i", "tile_j")).collect():
        back[r["tile_i"] + r["i"], r["tile_j"] + r["j"], r["c"]] = r["v"]
    assert np.array_equal(back, image)


def blobs(spark, side=23, seed=3):
    rng = np.random.default_rng(seed)
    image = rng.integers(0, 256, (side, side))
    return image, spark.createDataFrame([(0, i, j, int(image[i, j])) for i in range(side) for j in range(side)], "tile int, i int, j int, v int")


@pytest.mark.parametrize("diagonal", [True, False])
def test_regions_do_not_depend_on_tiles(spark, diagonal):
    image, px = blobs(spark)
    mask = px.filter("v > 120")
    whole = sorted(map(tuple, labels.label_regions(mask, "tile", diagonal, 64).collect()))
    assert sorted(map(tuple, labels.label_regions(mask, "tile", diagonal, 4).collect())) == whole
    seen, todo = {}, sorted((i, j) for i, j in zip(*np.nonzero(image > 120), strict=True))
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for place in todo:
        if place not in seen:
            stack = [place]
            while stack:
                at = stack.pop()
                if at in seen:
                    continue
                seen[at] = place
                stack += [(at[0] + a, at[1] + b) for a, b in near if (at[0] + a, at[1] + b) in set(todo)]
    assert {(i, j): (a, b) for _, i, j, a, b in whole} == seen


def test_stencils_do_not_depend_on_tiles(spark, monkeypatch):
    _, px = blobs(spark)
    for work in (lambda: stencil.median_blur(px, ("tile",), 5), lambda: stencil.gaussian_blur(px, ("tile",), 3, 1.0), lambda: stencil.sobel(px, ("tile",), 5)):
        monkeypatch.setattr(tiles, "SIZE", 256)
        whole = sorted(map(tuple, work().collect()))
        monkeypatch.setattr(tiles, "SIZE", 4)
        assert np.allclose(sorted(map(tuple, work().collect())), whole)


def test_images_too_large_for_one_task_are_refused(spark):
    px = spark.createDataFrame([(0, 0, 0, 5, 1), (0, 5000, 5000, 5, 0)], "tile int, i int, j int, v int, marker int")
    with pytest.raises(Exception, match="must be tiled first"):
        labels.watershed(px.drop("marker"), px.filter("marker > 0").drop("v"), "tile").count()


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 0.9, 0.999, 1.0])
def test_percentiles_are_exact_however_few_values_are_sorted(spark, share):
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=3000), 1: rng.integers(0, 2, 2000).astype(float), 2: np.full(500, 3.0), 3: np.array([1.0, 5.0]), 4: np.concatenate((np.zeros(400), [1e9] * 2, rng.random(300) * 1e-6))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [(0, None), (5, None)], "g int, v double")
    for most in (10, 100_000):
        got = {r["g"]: r["p"] for r in threshold.percentile(df, ("g",), "v", share, bins=16, most=most).collect()}
        assert got == pytest.approx({g: np.quantile(v, share) for g, v in groups.items()})


def test_merging_by_color_takes_the_least_difference_first(spark):
    colors = {"a": (200, 10, 10), "b": (195, 12, 12), "c": (10, 10, 200), "d": (12, 12, 195), "e": (10, 200, 10)}
    rows = [(1, i, 2 * k + j, name, *rgb) for k, (name, rgb) in enumerate(colors.items()) for i in range(2) for j in range(2)]
    px = spark.createDataFrame(rows, "tile int, i int, j int, label string, r int, g int, b int")
    merged = {r["label"]: r["merged"] for r in labels.merge_by_color(px, "tile", 0.1).collect()}
    assert merged == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}
    assert len({r["merged"] for r in labels.merge_by_color(px, "tile", 2.0).collect()}) == 1
    tissue = px.filter("label = 'a' OR (label = 'b' AND i = 0 AND j = 2)").select("tile", "i", "j")
    assert {r["label"] for r in labels.without_background(px, "tile", tissue, 0.2).collect()} == {"a", "b"}


def test_superpixels_of_tissue_are_merged_hierarchically(spark):
    shades = {"a": 100, "b": 110, "c": 122, "d": 200}
    rows = [(1, i, 2 * k + j, name, v, 128, 128) for k, (name, v) in enumerate(shades.items()) for i in range(2) for j in range(2)]
    px = spark.createDataFrame(rows, "tile int, i int, j int, label string, r int, g int, b int")
    tissue = px.filter("label <> 'd'").select("tile", "i", "j")
    merged = {r["label"]: r["merged"] for r in labels.merge_tissue(px, "tile", tissue, 0.04).collect()}
    assert merged == {"a": "a", "b": "a", "c": "a"}
    # b and c differ by 0.024 and a and b by 0.021; once a and b are one, they differ from c by 0.034.
    assert {r["label"]: r["merged"] for r in labels.merge_tissue(px, "tile", tissue, 0.03).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_steps_refuse_tiles_that_they_are_not_made_for(spark):
    step("only_fluor", needs={"stain": "Fluor"})(lambda df: df)
    step("only_he", batch=True, needs={"stain": "HE"})(lambda frame: frame)
    tiles = spark.createDataFrame([(1, "Fluor")], "tile int, stain string")
    assert Step("only_fluor")(tiles).count() == 1
    with pytest.raises(Exception, match="only_fluor needs stain Fluor"):
        Step("only_fluor")(tiles.withColumn("stain", F.lit("HE"))).collect()
    with pytest.raises(ValueError, match="only_he needs stain HE"):
        Step("only_he")(tiles.toPandas())


def test_two_touching_nuclei_are_told_apart(spark):
    side = 40
    i, j = np.mgrid[:side, :side]
    left, right = ((i - 20) ** 2 + (j - c) ** 2 <= 81 for c in (12, 28))
    nucleus = left | right
    h = np.where(left & (j <= 20), (j - 12) / 9, np.where(right, (j - 28) / 9, 0.0))
    v = np.where(nucleus, (i - 20) / 9, 0.0)
    rows = [(0, int(a), int(b), -4.0, 4.0 if nucleus[a, b] else -8.0, float(h[a, b]), float(v[a, b])) for a in range(side) for b in range(side)]
    px = spark.createDataFrame(rows, "tile int, i int, j int, n0 double, n1 double, h double, v double")
    out = array(segment.hovernet(px, "tile", 10, 5, k=0.3), (side, side), "label")
    assert (out[~nucleus] == 0).all() and out[20, 12] != out[20, 28] and out[20, 12] > 0 < out[20, 28]
    distance = np.maximum(9 - np.hypot(i - 20, j - 12), 9 - np.hypot(i - 20, j - 28)) / 9
    cells = spark.createDataFrame([(0, int(a), int(b), float(max(distance[a, b], 0)), float(nucleus[a, b])) for a in range(side) for b in range(side)], "tile int, i int, j int, maxima double, interior double")
    for how in ("h_maxima", "peak_local_max"):
        out = array(segment.deep_watershed(cells, "tile", radius=4, maxima_threshold=0.2, interior_threshold=0.3, small_objects=15, fill_holes=15, expansion=1, how=how), (side, side), "label")
        assert sorted(set(out.ravel())) == [0, 1, 2] and out[20, 12] != out[20, 28]
    both = cells.select("tile", "i", "j", F.array(F.array("maxima"), F.array(F.lit(0.0), F.col("interior")), F.array("maxima"), F.array(F.lit(0.0), F.col("interior"))).alias("outputs"))
    how = {"radius": 4, "maxima_threshold": 0.2, "interior_threshold": 0.3}
    found = segment.mesmer(both, "tile", how, how).agg(F.max("cell_segmentation"), F.max("nuclear_segmentation")).first()
    assert tuple(found) == (2, 2)


def test_kinds_that_do_not_fit_are_refused(spark):
    px = spark.createDataFrame([(0, i, j, 1, 0, 0) for i in range(5) for j in range(5)], "tile int, i int, j int, v int, z int, t int")
    with pytest.raises(Exception, match="do not fit exactly"):
        grid.extract_tiles(px, ("tile",), 4, 2).count()
    with pytest.raises(ValueError):
        point.squeeze(px.union(px.withColumn("z", F.lit(1))))
    with pytest.raises(Exception, match="needs stain Fluor"):
        grid.require(px.withColumn("stain", F.lit("HE")), "stain", "Fluor", "quantification").collect()
    with pytest.raises(Exception, match="3 or 5 axes"):
        datasets.channels_first(F.col("image"), F.col("shape"))
        spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("image"), F.array(F.lit(2)).alias("shape")).select(*datasets.channels_first(F.col("image"), F.col("shape"))).collect()
    one = spark.range(1).select(F.create_map(F.lit("a"), F.struct(F.array(F.lit(2)).alias("shape"), F.array(F.lit(1)).alias("data"))).alias("masks"))
    value = F.struct(F.array(F.lit(3)).alias("shape"), F.array(F.lit(1)).alias("data"))
    for wrong in (store.add_mask("masks", "a", value), store.update_mask("masks", "a", value), store.update_mask("masks", "b", value)):
        with pytest.raises(Exception, match="there is"):
            one.select(wrong.alias("m")).collect()


def test_axes_of_volumes_come_in_the_order_for_batches(spark):
    image = np.arange(2 * 3 * 4 * 2 * 5).reshape(2, 3, 4, 2, 5)
    df = spark.createDataFrame([(image.ravel().tolist(), list(image.shape))], "image array<int>, shape array<int>")
    flat, shape = df.select(*datasets.channels_first(F.col("image"), F.col("shape"))).first()
    assert flat == image.transpose(4, 3, 2, 1, 0).ravel().tolist() and shape == [5, 2, 4, 3, 2]


def test_node_values_settle(spark):
    edges = spark.createDataFrame([(0, a, (a + d) % 12) for a in range(12) for d in (1, 3)], "graph_id int, src int, dst int")
    nodes = edges.select("graph_id", F.col("src").alias("node")).distinct()
    found = graph.features(nodes, edges).first()
    assert len(found) == 48 and found["hubs_sum"] == pytest.approx(1) and found["personalized_pgrank_sum"] == pytest.approx(1) and found["degree_mean"] == 4
