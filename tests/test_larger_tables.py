"""What only larger tables show: sizes that the planner cannot see, and figures that grow faster than the input."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselon.lineage import cut
from tesselon.operators import graph, grid, labels, quantify, tiles
from tesselon.streaming import arrivals


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def rectangles(spark, n=400, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        top, left = r.randrange(-40, 90), r.randrange(-40, 90)
        rows.append((k % 7, f"m{k % 5}", top, left, top + r.randrange(0, 60), left + r.randrange(0, 60)))
    return rows, spark.createDataFrame(rows, "slide_id long, name string, top int, left int, bottom int, right int")


@pytest.mark.parametrize(("stride", "pad"), [(None, False), ((7, 5), False), ((16, 16), True), ((7, 5), True)])
def test_masks_of_a_grid_without_its_tiles(spark, stride, pad):
    rows, masks = rectangles(spark)
    slides = spark.createDataFrame([(k, 30 + 9 * k, 80 - 10 * k, f"s{k}") for k in range(8)] + [(3, 57, 50, "s3"), (None, 20, 20, "none")], "slide_id long, height int, width int, label string")
    tiles = [tuple(t) for t in grid.tile_grid(slides.distinct(), (10, 12), stride, pad).collect()]
    cut = lambda t, m: (min(t[4] + 10, m[4]) - max(t[4], m[2]), min(t[5] + 12, m[5]) - max(t[5], m[3]))
    hits = [(t, m, *cut(t, m)) for t in tiles for m in rows if t[0] == m[0] and m[4] > m[2] and m[5] > m[3] and min(cut(t, m)) > 0]
    found = grid.grid_masks(slides.distinct(), masks, (10, 12), stride, pad)
    assert "Broadcast" not in plan(found)
    assert sorted(map(tuple, found.select("slide_id", "tile_i", "tile_j", "name", "top", "left", "rows", "columns").collect())) == sorted((t[0], t[4], t[5], *m[1:4], a, b) for t, m, a, b in hits)
    held = {tuple(t)[:6]: [] for t in tiles}
    for t, m, a, b in hits:
        held[t].append((m[1], max(m[2] - t[4], 0), max(m[3] - t[5], 0), a, b))
    got = grid.tiles_with_masks(slides, masks, (10, 12), stride, pad).collect()
    assert len(got) == len(held)
    assert {tuple(r)[:6]: [tuple(x) for x in r["masks"]] for r in got} == {t: sorted(x) for t, x in held.items()}


def test_tiles_are_not_shuffled_or_broadcast(spark):
    """Tiles and cells were broadcast by the size of the slides that they are made of."""
    _, masks = rectangles(spark)
    slides = spark.range(20).select(F.col("id").alias("slide_id"), F.lit(60).alias("height"), F.lit(60).alias("width"))
    assert "Broadcast" not in plan(grid.slice_masks(grid.tile_grid(slides, (10, 10)), masks, (10, 10)))
    text = grid.tiles_with_masks(slides, masks, (10, 10))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and "hashpartitioning(slide_id" in text and "tile_i" not in "".join(x for x in text.splitlines() if "Exchange" in x)


def test_cut_tables_look_as_large_as_they_are(spark):
    """Dictionaries made millions of rows with repeated keys look small enough for a broadcast."""
    rows = 300_000
    table = cut(spark.range(rows).select(F.lit("slide 1A").alias("name"), (F.col("id") % 7).alias("label")))
    path = spark._jvm.org.apache.hadoop.fs.Path(table._cut)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    assert files > rows * 16


def test_neighbours_in_clusters_among_copies_and_far_away(spark):
    r = random.Random(5)
    rows = [(1, n, 100 + r.randrange(6), 100 + r.randrange(6)) for n in range(300)] + [(1, 1000, 10**6, -(10**6)), (1, 1001, 10**6, -(10**6))]
    rows += [(2, n, 5, 5) for n in range(4)] + [(3, 7, 0, 0)] + [(4, n, 3 * n * n, -n) for n in range(40)]
    brute = set()
    for g, n, x, y in rows:
        near = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, m) for h, m, a, b in rows if h == g and m != n)[:5]
        brute |= {(g, n, m, d) for d, m in near}
    found = graph.knn_graph(spark.createDataFrame([*rows, (1, 5000, None, 3)], "graph_id long, node long, x long, y long"), 5).collect()
    assert len(found) == len(brute) and set(map(tuple, found)) == brute


def test_neighbours_among_many_copies(spark):
    """Every pair of points in a cell was a row that was sorted: here there are 3.6 thousand million."""
    points = spark.range(60_000).select(F.lit(1).alias("graph_id"), F.col("id").alias("node"), (F.col("id") % 3).alias("x"), F.lit(0).alias("y"))
    found = graph.knn_graph(points, 5)
    first = found.filter("src <> dst").groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"), F.max("dst").alias("top"))
    assert {(r["n"], r["d"]) for r in first.select("n", "d").distinct().collect()} == {(5, 0.0)}
    assert first.agg(F.max("top")).first()[0] == 17


def test_points_at_one_place_are_in_the_order_of_their_nodes(spark):
    rows = [(0, (7 * n) % 40, n % 3, n % 2) for n in range(40)]
    ranked = quantify.clockwise(spark.createDataFrame(rows, "graph_id long, node long, x long, y long").repartition(3), ("graph_id",)).orderBy("rank").collect()
    for place in {(r["x"], r["y"]) for r in ranked}:
        nodes = [r["node"] for r in ranked if (r["x"], r["y"]) == place]
        assert nodes == sorted(nodes) and len(nodes) > 1


def test_tiles_are_merged_without_a_frame_each(spark):
    rows = [(t, i, j, f"{i // 2}:{j // 2}", 250 * (i // 2) + t, 60, 200 - 3 * j) for t in range(5) for i in range(4) for j in range(4)]
    found = labels.merge_by_color(spark.createDataFrame(rows, "tile long, i int, j int, label string, r long, g long, b long"), "tile", 0.1)
    assert "InPandas" not in plan(found)
    got = {(r["tile"], r["label"]): r["merged"] for r in found.collect()}
    assert got == {(t, f"{a}:{b}"): f"{a}:0" for t in range(5) for a in (0, 1) for b in (0, 1)}


def test_a_stream_asks_its_state_once_for_each_place():
    asked, kept = [], {}

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

    class Places:
        containsKey = lambda self, k: asked.append(k) or k in kept

    class Handle:
        registerTimer = deleteTimer = lambda self, t: None

    class Timer:
        getCurrentWatermarkInMs = lambda self: 0

    Places.updateValue = lambda self, k, v: kept.__setitem__(k, v)
    slide = arrivals._Slide()
    slide.handle, slide.places, slide.about, slide.done = Handle(), Places(), Value(), Value()
    part = pd.DataFrame({"tile_i": [0, 1, 0, 1] * 50, "tile_j": 0, "expected": [None, 4] * 100, "at": pd.to_datetime(range(5, 205), unit="ms")})
    assert list(slide.handleInputRows((7,), iter([part, part]), Timer())) == []
    assert sorted(asked) == [(0, 0), (1, 0)] and slide.about.held == (2, 4, 5, 204, 204)


def spread(cells, near):
    """The connected sets of cells (i, j), by a plain search."""
    left, sets = set(cells), []
    while left:
        front = [left.pop()]
        for i, j in front:
            beside = {(i + a, j + b) for a, b in near} & left
            left -= beside
            front += beside
        sets.append(set(front))
    return sets


def test_foreground_is_dealt_by_rows(spark, monkeypatch):
    """Partitions were put together by their compressed size: at 6 GB a task would have sorted 4005 MB of pixels."""
    monkeypatch.setattr(tiles, "ROWS", 150, raising=False)
    r, side = random.Random(8), 13
    value = {(k, i, j): r.choice([0, 0, 1, None] if k % 2 else [0, 1, 1]) for k in range(9) for i in range(side) for j in range(side) if k < 6 or r.random() < 0.9}
    df = spark.createDataFrame([(*p, v) for p, v in value.items()], "k long, i int, j int, v int")
    four, expected = [(0, 1), (1, 0), (0, -1), (-1, 0)], set()
    for k in range(9):
        places = {(i, j) for m, i, j in value if m == k}
        regions = spread({p for p in places if value[(k, *p)]}, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        kept = set().union(*(x for x in regions if len(x) >= 6))
        holes = [x for x in spread(places - kept, four) if len(x) <= 3 and not any({0, side - 1} & {*p} for p in x)]
        expected |= {(k, *p) for p in kept.union(*holes)}
    for size in (256, 4):
        found = labels.foreground(df, "k", side, side, 6, 3, size)
        assert sorted(map(tuple, found.collect())) == sorted(expected)
        assert size == 4 or found.rdd.getNumPartitions() > len(value) // 150
    assert labels.label_regions(df.filter("v > 0"), "k").count() == sum(bool(v) for v in value.values())
