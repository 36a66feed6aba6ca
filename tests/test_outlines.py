"""Floods, reconstructions, contours and instances over tiles against plain versions of the same."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.functions import raster
from tesselon.operators import contours, labels, segment


def plain_flood(height, marker, mask):
    """All places look at their four neighbours at once, round after round."""
    shape = height.shape
    own = {p: (height[p], 0, int(marker[p])) for p in np.ndindex(shape) if marker[p] > 0 and mask[p]}
    while True:
        new = dict(own)
        for i, j in np.ndindex(shape):
            near = [own[q] for q in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if q in own]
            if near and mask[i, j]:
                cost, steps, held = min(near)
                found = (max(cost, height[i, j]), steps + 1, held)
                if (i, j) not in own or found < own[i, j]:
                    new[i, j] = found
        if new == own:
            return np.array([[own.get((i, j), (0, 0, 0))[2] for j in range(shape[1])] for i in range(shape[0])])
        own = new


@pytest.mark.parametrize("few", [0, 4, 10**6])
def test_flood_equals_rounds_over_the_whole_tile(monkeypatch, few):
    monkeypatch.setattr(raster, "_FEW", few)
    rng = np.random.default_rng(few)
    for _ in range(30):
        shape = tuple(rng.integers(1, 12, 2))
        height = rng.integers(0, rng.choice([2, 6, 1000]), shape).astype(float)
        marker = np.where(rng.random(shape) < rng.choice([0.05, 0.3]), rng.integers(1, 9, shape), 0)
        mask = rng.random(shape) < rng.choice([0.6, 1.0])
        assert (raster.flood(height, marker, mask) == plain_flood(height, marker, mask)).all()


def maze(n):
    """Lines that are joined at one end each, so that the path through all of them is half the tile long."""
    walls = np.zeros((n, n), bool)
    walls[1::2] = True
    walls[1::4, -1] = walls[3::4, 0] = False
    return walls


def test_floods_take_time_by_the_pixels_and_not_by_the_path():
    def seconds(n, winding):
        marker, walls = np.zeros((n, n), np.int64), maze(n)
        marker[0, 0] = 1
        begin = time.monotonic()
        found = raster.flood(walls * 1.0, marker, ~walls if winding else np.ones((n, n), bool))
        assert (found[~walls] == 1).all()
        return time.monotonic() - begin

    for winding in (False, True):
        small, large = seconds(256, winding), seconds(1024, winding)
        assert large < 20 and large < 64 * max(small, 0.05), (winding, small, large)


@pytest.mark.parametrize("square", [8, 64])
def test_reconstruction_equals_rounds_of_dilation(monkeypatch, square):
    monkeypatch.setattr(raster, "_SQUARE", square)
    rng = np.random.default_rng(square)
    for _ in range(12):
        limit, radius = rng.random(tuple(rng.integers(1, 60, 2))).round(2), int(rng.integers(0, 9))
        disk = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
        grown = limit - 0.2
        while True:
            new = np.minimum(limit, np.max([raster.moved(grown, a, b, -np.inf) for a, b in disk], axis=0))
            if (new == grown).all():
                break
            grown = new
        assert (raster.reconstructed(limit - 0.2, limit, radius) == grown).all()


def plain_contours(mask):
    """Each ring of sides as its pixels, from a walk over a set of sides."""
    on = set(map(tuple, np.argwhere(mask)))
    beyond, along = ((-1, 0), (0, 1), (1, 0), (0, -1)), ((0, 1), (1, 0), (0, -1), (-1, 0))
    todo = {(i, j, s) for i, j in on for s in range(4) if (i + beyond[s][0], j + beyond[s][1]) not in on}
    out = []
    while todo:
        at, ring = min(todo), []
        while at in todo:
            todo.remove(at)
            i, j, s = at
            ring.append((i, j))
            ahead = (i + along[s][0], j + along[s][1])
            turn = (ahead[0] + beyond[s][0], ahead[1] + beyond[s][1])
            at = (*turn, (s + 3) % 4) if turn in on else (*ahead, s) if ahead in on else (i, j, (s + 1) % 4)
        own = [p for k, p in enumerate(ring) if p != ring[k - 1]] or ring[:1]
        out.append(own)
    return out


def shoelace(ring):
    return sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def turned(ring):
    """A ring from its smallest way of writing it on."""
    return min(tuple(ring[k:] + ring[:k]) for k in range(len(ring)) if ring[k] == min(ring))


def pixels(spark, image, name="v"):
    return spark.createDataFrame([(1, int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(image)], f"image int, i int, j int, {name} int")


@pytest.mark.parametrize("size", [4, 7, 64])
def test_contours_equal_a_plain_walk(spark, size):
    rng = np.random.default_rng(size)
    image = (rng.random((26, 31)) < 0.55).astype(int)
    image[3:20, 5:25] = 1
    image[6:12, 8:15] = 0
    image[8:10, 10:12] = 1
    expected = plain_contours(image > 0)
    found, vertices = contours.trace(pixels(spark, image).filter("v > 0"), "image", size)
    assert sorted((r["vertices"], r["area"]) for r in found.collect()) == sorted((len(r), abs(shoelace(r))) for r in expected)
    rings = {}
    for r in vertices.orderBy("place").collect():
        rings.setdefault(r["contour"], []).append(((r["i"], r["j"]), r["place"]))
    assert all([p for _, p in ring] == list(range(len(ring))) for ring in rings.values())
    assert sorted(turned([v for v, _ in ring]) for ring in rings.values()) == sorted(map(turned, expected))
    tree = contours.hierarchy(pixels(spark, image).filter("v > 0"), "image", size).collect()
    outer = {r["contour"]: r for r in tree if not r["hole"]}
    assert len({(r["ri"], r["rj"]) for r in tree}) == len(outer)
    assert all((outer[r["parent"]]["ri"], outer[r["parent"]]["rj"]) == (r["ri"], r["rj"]) for r in tree if r["hole"])


def test_foreground_by_the_area_of_contours(spark):
    image = np.zeros((30, 40), int)
    image[1:4, 1:4] = 1  # three by three pixels: an area of 4
    image[1:5, 8:12] = 1  # four by four: 9
    image[8:28, 8:28] = 1
    image[10:12, 10:12] = 0  # a hole of two by two, around which the contour's area is 7
    image[15:25, 15:25] = 0  # a large one, with an island in it that has a hole itself
    image[17:22, 17:22] = 1
    image[19, 19] = 0
    px = pixels(spark, image)
    kept = lambda **how: {(r["i"], r["j"]) for r in contours.foreground(px, "image", how.pop("least", 9), size=8, **how).collect()}
    on = {tuple(map(int, p)) for p in np.argwhere(image)}
    box = lambda a, b, c, d: {(i, j) for i in range(a, b) for j in range(c, d)}
    large = on - box(1, 4, 1, 4) - box(1, 5, 8, 12)
    assert kept(max_hole=0) == large
    assert kept(max_hole=7) == large | box(10, 12, 10, 12) | {(19, 19)}
    assert kept(max_hole=1) == large and kept(max_hole=2) == large | {(19, 19)}
    assert kept(max_hole=0, least=8) == on - box(1, 4, 1, 4)
    assert kept(max_hole=0, least=16) == large - box(17, 22, 17, 22)
    assert kept(max_hole=0, least=16, outer_only=True) == box(8, 28, 8, 28) == kept(max_hole=10_000, least=16)


def test_nuclei_over_the_edges_of_tiles_equal_those_of_the_whole(spark):
    side, centres = 64, [(12, 12), (15, 33), (31, 31), (32, 50), (50, 15), (48, 48)]
    i, j = np.mgrid[:side, :side]
    h, v, nucleus = np.zeros((side, side)), np.zeros((side, side)), np.zeros((side, side), bool)
    for a, b in centres:
        own = (i - a) ** 2 + (j - b) ** 2 <= 49
        nucleus |= own
        h[own], v[own] = (j[own] - b) / 7, (i[own] - a) / 7
    rows = [(1, int(a), int(b), -4.0, 4.0 if nucleus[a, b] else -8.0, float(h[a, b]), float(v[a, b])) for a in range(side) for b in range(side)]
    px = spark.createDataFrame(rows, "image int, i int, j int, n0 double, n1 double, h double, v double")
    whole = {}
    for r in segment.hovernet(px, "image", 10, 5, k=0.3).filter("label > 0").collect():
        whole.setdefault(r["label"], set()).add((r["i"], r["j"]))
    assert len(whole) == len(centres)
    for size, halo in ((16, 16), (32, 16), (64, 0)):
        tiled = {}
        found = segment.across_tiles(px, "image", size, halo, lambda p, keys: segment.hovernet(p, keys, 10, 5, k=0.3))
        for r in found.collect():
            tiled.setdefault((r["ri"], r["rj"]), set()).add((r["i"], r["j"]))
        assert sorted(map(sorted, tiled.values())) == sorted(map(sorted, whole.values())), (size, halo)
        assert all(min(own) == name for name, own in tiled.items())


def test_regions_of_tiles_are_joined_and_empty_images_stay_empty(spark):
    image = np.zeros((20, 20), int)
    image[3, :] = image[:, 7] = image[15, 2:9] = 1
    image[18:, 18:] = 1
    mask = pixels(spark, image).filter("v > 0").drop("v")
    found = segment.across_tiles(mask, "image", 5, 1, labels.tile_regions, 0.0).groupBy("ri", "rj").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, found.collect())) == [(0, 7, int(image.sum()) - 4), (18, 18, 4)]
    none = mask.limit(0)
    assert segment.across_tiles(none, "image", 5, 1, labels.tile_regions).count() == 0
    assert [df.count() for df in contours.trace(none, "image")] == [0, 0]
