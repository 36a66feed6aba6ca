"""Contours of regions: border following per tile, joined at the tiles' edges.

A border is a ring of directed sides between a region's pixel and one outside, the region on the right.
Each side has one successor, found from the pixels ahead (regions are connected over diagonals). Tiles
follow their own sides in numpy; chains that leave a tile name the side they go on with, which is the
first of another tile's chain. Chains are joined by rounds of pointer doubling, so a ring of any length
takes rounds by the logarithm of the tiles it runs through, and no task holds a ring.

Vertices are the centres of the pixels met, each once in a row, as native contour finders give them: a
pixel by itself is one vertex and has no area. A hole's contour runs through the region's pixels around it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.lineage import cut
from tesselon.operators import labels, tiles

# The sides of a pixel in the order in which they are followed - top, right, bottom, left -, each with
# the step to the pixel beyond it and the step along it.
_BEYOND, _ALONG = ((-1, 0), (0, 1), (1, 0), (0, -1)), ((0, 1), (1, 0), (0, -1), (-1, 0))
#: Bits of a column in the number of a side.
_WIDE = 30


def _number(i, j, side):
    return ((i << _WIDE | j) << 2) | side


def _ranked(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first side of each side's chain and its distance from it; rings begin at their smallest side.

    ``follows`` is the place of the side before, -1 for none.
    """
    n = len(follows)
    low, jump = np.arange(n), follows.copy()
    for _ in range(max(1, n.bit_length())):
        ahead = np.where(jump >= 0, jump, np.arange(n))
        low, jump = np.minimum(low, low[ahead]), np.where(jump >= 0, jump[ahead], -1)
    # What still points on lies on a ring, and has seen all of it.
    before = np.where((jump >= 0) & (low == np.arange(n)), -1, follows)
    first, distance, jump = np.arange(n), (before >= 0).astype(np.int64), before.copy()
    for _ in range(max(1, n.bit_length())):
        ahead = np.where(jump >= 0, jump, np.arange(n))
        first, distance, jump = np.where(jump >= 0, first[ahead], first), distance + np.where(jump >= 0, distance[ahead], 0), np.where(jump >= 0, jump[ahead], -1)
    return first, distance


def _chains(tile: tiles.Tile, own: np.ndarray) -> dict[str, np.ndarray]:
    """For the sides of the tile's own pixels: chain, place in it, the side after its last one, vertex or not, and area."""
    there = np.pad(tile.present(), 1)
    at = lambda i, j: there[i + 1, j + 1]
    i, j = np.nonzero(own)
    parts = []
    for side, (di, dj) in enumerate(_BEYOND):
        out = ~at(i + di, j + dj)
        parts.append((i[out], j[out], np.full(out.sum(), side)))
    i, j, side = (np.concatenate(x) for x in zip(*parts, strict=True))
    along, beyond = np.array(_ALONG)[side], np.array(_BEYOND)[side]
    ahead, over = (i + along[:, 0], j + along[:, 1]), (i + along[:, 0] + beyond[:, 0], j + along[:, 1] + beyond[:, 1])
    turn, straight = at(*over), at(*ahead)
    to_i, to_j = np.where(turn, over[0], np.where(straight, ahead[0], i)), np.where(turn, over[1], np.where(straight, ahead[1], j))
    to = np.where(turn, (side + 3) % 4, np.where(straight, side, (side + 1) % 4))
    name, after = _number(i + tile.top, j + tile.left, side), _number(to_i + tile.top, to_j + tile.left, to)
    order = np.argsort(name)
    i, j, name, after, to_i, to_j = (x[order] for x in (i, j, name, after, to_i, to_j))
    place = np.searchsorted(name, after)
    inside = (place < len(name)) & (name[np.minimum(place, len(name) - 1)] == after)
    follows = np.full(len(name), -1)
    follows[place[inside]] = np.flatnonzero(inside)
    first, distance = _ranked(follows)
    moved = (i != to_i) | (j != to_j)
    area = (j + tile.left) * (to_i + tile.top) - (to_j + tile.left) * (i + tile.top)
    # With rows growing downwards a ring followed with the region on its right has a positive sum.
    return {"i": (i + tile.top).astype(np.int32), "j": (j + tile.left).astype(np.int32), "name": name, "chain": name[first], "place": distance, "after": after, "moved": moved, "area": area}


def _sides(mask: DataFrame, key: str, size: int) -> DataFrame:
    """(key, name, chain, place, i, j, after, moved, area): the sides of all regions, followed within tiles."""

    return tiles.per_tile_rows(mask.select(key, "i", "j"), (key,), (), _chains, "name long, chain long, place long, i int, j int, after long, moved boolean, area long", size, 1)


def _joined(chains: DataFrame, key: str) -> DataFrame:
    """(key, chain, ring, before): the ring of each chain, named by its smallest side, and how many vertices of the ring come before it.

    ``chains`` are (key, chain, least, after, n): the first side, the smallest, the side after the last
    one, and the number of vertices.
    """
    state = cut(chains.select(key, "chain", F.col("after").alias("to"), F.struct("least", "chain").alias("low"), "n"))
    while True:
        ahead = state.select(key, F.col("chain").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"))
        new = cut(state.join(ahead, [key, "to"]).select(key, "chain", F.col("far").alias("to"), F.least("low", "far_low").alias("low"), "n", (F.col("far_low") < F.col("low")).alias("_moved")))
        done = new.filter("_moved").isEmpty()
        state = new.drop("_moved")
        if done:
            break
    ring = state.select(key, "chain", F.col("low.least").alias("ring"), F.col("low.chain").alias("_start"), "n")
    # Cut before the chain with the smallest side, each chain adds up the vertices from itself to the ring's end.
    after = chains.select(key, "chain", F.col("after").alias("to"))
    rank = cut(ring.join(after, [key, "chain"]).select(key, "chain", "ring", "n", F.when(F.col("to") != F.col("_start"), F.col("to")).alias("to"), F.col("n").alias("rest")))
    while not rank.filter("to IS NOT NULL").isEmpty():
        ahead = rank.select(key, F.col("chain").alias("to"), F.col("to").alias("far"), F.col("rest").alias("far_rest"))
        rank = cut(rank.join(ahead, [key, "to"], "left").select(key, "chain", "ring", "n", F.col("far").alias("to"), (F.col("rest") + F.coalesce("far_rest", F.lit(0))).alias("rest")), rank)
    total = rank.groupBy(key, "ring").agg(F.max("rest").alias("all"))
    return rank.join(total, [key, "ring"]).select(key, "chain", "ring", (F.col("all") - F.col("rest")).alias("before"))


def trace(mask: DataFrame, key: str, size: int = tiles.SIZE) -> tuple[DataFrame, DataFrame]:
    """Contours (key, contour, vertices, area) and their vertices (key, contour, place, i, j).

    ``mask`` holds the pixels (key, i, j) of the regions, all i and j at least 0. ``area`` is that of the
    polygon through the pixels' centres, at least 0; ``place`` counts from 0 around the contour.
    """
    sides = cut(_sides(mask, key, size))
    last = F.max_by(F.struct("after", "i", "j"), "place")
    chains = cut(sides.groupBy(key, "chain").agg(F.min("name").alias("least"), last["after"].alias("after"), F.sum(F.col("moved").cast("long")).alias("n"), F.sum("area").alias("area")))
    rings = cut(_joined(chains, key))
    found = chains.join(rings, [key, "chain"]).groupBy(key, F.col("ring").alias("contour")).agg(F.sum("n").alias("n"), F.sum("area").alias("twice"))
    # A ring around one pixel never moves. Holes are followed the other way round, their sums are negative.
    contours = cut(found.select(key, "contour", F.greatest("n", F.lit(1)).alias("vertices"), (F.abs("twice") / 2).alias("area"), "n"))
    within = Window.partitionBy(key, "chain").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # Such a ring is one chain, and that begins at its smallest side.
    alone = contours.filter("n = 0").select(key, F.col("contour").alias("chain"), F.lit(True).alias("_alone"))
    numbered = sides.withColumn("_k", F.coalesce(F.sum(F.col("moved").cast("long")).over(within), F.lit(0))).join(alone, [key, "chain"], "left").filter(F.col("moved") | (F.col("_alone") & (F.col("place") == 0)))
    vertices = numbered.join(rings, [key, "chain"]).select(key, F.col("ring").alias("contour"), (F.col("before") + F.col("_k")).alias("place"), "i", "j")
    return contours.drop("n"), vertices


def first_pixel(contour: str) -> tuple[Column, Column]:
    """Row and column of the pixel at which a contour is named."""
    at = F.shiftright(contour, 2)
    return F.shiftright(at, _WIDE).cast("int"), at.bitwiseAND(F.lit((1 << _WIDE) - 1)).cast("int")


def hierarchy(mask: DataFrame, key: str, size: int = tiles.SIZE) -> DataFrame:
    """(key, contour, vertices, area, hole, parent, ri, rj) of the regions of ``mask`` (key, i, j): a hole's parent is the outer contour of its region, named (ri, rj).

    A region's outer contour is the one that holds the top side of its first pixel, which is its
    smallest side; the others are its holes.
    """
    contours, _ = trace(mask, key, size)
    return _with_parents(contours, labels.label_regions(mask, key, size=size), key)


def _with_parents(contours: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    i, j = first_pixel("contour")
    named = contours.withColumns({"i": i, "j": j}).join(regions.select(key, "i", "j", "ri", "rj"), [key, "i", "j"])
    outer = (F.col("ri").cast("long") * (1 << _WIDE) + F.col("rj")) * 4
    return named.select(key, "contour", "vertices", "area", (F.col("contour") != outer).alias("hole"), F.when(F.col("contour") != outer, outer).alias("parent"), "ri", "rj")


def foreground(pixels: DataFrame, key: str, min_region: float, max_hole: float, outer_only: bool = False, size: int = tiles.SIZE) -> DataFrame:
    """(key, i, j): the regions of v > 0 whose outer contour's area exceeds ``min_region``, but for their holes whose contour's area exceeds ``max_hole``.

    ``pixels`` (key, i, j, v) are all pixels of the images. Smaller holes are filled, with ``outer_only``
    all are, and so is what lies in a filled hole: regions there are kept whatever their size, and the
    holes of those are filled too. This goes on in rounds, as many as regions are nested in holes.
    """
    mask = pixels.filter("v > 0").select(key, "i", "j")
    regions = cut(labels.label_regions(mask, key, size=size))
    outside = cut(labels.label_regions(pixels.filter("v <= 0").select(key, "i", "j"), key, diagonal=False, size=size))
    found = _with_parents(trace(mask, key, size)[0], regions, key)
    i, j = first_pixel("contour")
    side = F.col("contour").bitwiseAND(F.lit(3))
    beyond = [F.element_at(F.array(*(F.lit(step[k]) for step in _BEYOND)), (side + 1).cast("int")) for k in (0, 1)]
    place = outside.select(key, F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("ri").alias("hi"), F.col("rj").alias("hj"))
    rings = cut(found.withColumns({"_i": i + beyond[0], "_j": j + beyond[1]}).join(place, [key, "_i", "_j"], "left").select(key, "ri", "rj", "hole", "area", "hi", "hj"))
    on = front = cut(rings.filter(~F.col("hole") & (F.col("area") > min_region)).select(key, "ri", "rj", F.lit(True).alias("_kept")))
    filled = []
    while not front.isEmpty():
        fills = F.lit(True) if outer_only else ~F.col("_kept") | (F.col("area") <= max_hole)
        closed = cut(rings.filter("hole").join(front, [key, "ri", "rj"]).filter(fills).select(key, "hi", "hj"))
        filled.append(closed)
        inner = rings.filter("NOT hole").join(closed, [key, "hi", "hj"]).select(key, "ri", "rj", F.lit(False).alias("_kept"))
        front = cut(inner.join(on.select(key, "ri", "rj"), [key, "ri", "rj"], "left_anti"))
        on = cut(on.unionAll(front))
    out = regions.join(on.select(key, "ri", "rj"), [key, "ri", "rj"]).select(key, "i", "j")
    for closed in filled:
        out = out.unionAll(outside.join(closed.select(key, F.col("hi").alias("ri"), F.col("hj").alias("rj")), [key, "ri", "rj"]).select(key, "i", "j"))
    return out
