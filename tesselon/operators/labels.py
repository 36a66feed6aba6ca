"""Connected regions of pixel masks and what follows from them: small objects, holes, watersheds, superpixels."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions import raster
from tesselon.lineage import cut
from tesselon.operators import tiles
from tesselon.operators.graph import connected_components

_EIGHT = ((0, 1), (1, -1), (1, 0), (1, 1))
_FOUR = ((0, 1), (1, 0))


def _beside(offsets):
    return F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets)))


def label_regions(mask: DataFrame, key: str, diagonal: bool = True, size: int = tiles.SIZE) -> DataFrame:
    """(key, i, j, ri, rj): connected regions of a mask's pixels; a region is named by its first pixel (ri, rj).

    Regions are found in each tile of ``size`` by ``size`` pixels; those of different tiles that touch at
    the tiles' edges are then joined, so the rounds of joins see edge pixels only. Pixels are counted
    first, so a task holds a bounded number.
    """

    def local(tile: tiles.Tile) -> dict:
        root = raster.regions(tile.present(), diagonal)[tile.at]
        return {"ri": (root // tile.shape[1] + tile.top).astype(np.int32), "rj": (root % tile.shape[1] + tile.left).astype(np.int32)}

    found = cut(tiles.per_tile(mask.select(key, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")), (key,), (), local, "ri int, rj int", size, parts=tiles.parts(mask)))
    on_edge = lambda c: F.pmod(c, F.lit(size)).isin(0, size - 1)
    edge = found.filter(on_edge("i") | on_edge("j"))
    at = edge.select(F.struct(key, F.col("ri").alias("i"), F.col("rj").alias("j")).alias("p"), key, "i", "j")
    sent = at.withColumn("_o", _beside(_EIGHT if diagonal else _FOUR)).select(key, (F.col("i") + F.col("_o.a")).alias("i"), (F.col("j") + F.col("_o.b")).alias("j"), F.col("p").alias("q"))
    links = cut(at.join(sent, [key, "i", "j"]).filter("p <> q").select(F.col("q").alias("src"), F.col("p").alias("dst")).distinct())
    if links.isEmpty():
        return found
    merged = connected_components(links).select(f"node.{key}", F.col("node.i").alias("ri"), F.col("node.j").alias("rj"), F.col("label.i").alias("_i"), F.col("label.j").alias("_j"))
    return found.join(merged, [key, "ri", "rj"], "left").select(key, "i", "j", F.coalesce("_i", "ri").alias("ri"), F.coalesce("_j", "rj").alias("rj"))


def tile_regions(mask: DataFrame, keys: tuple[str, ...], diagonal: bool = True) -> DataFrame:
    """(keys, i, j, label): the connected regions of each image on its own, which must be a tile, numbered from 1 by their first pixels' places."""

    def local(tile: tiles.Tile) -> dict:
        return {"label": raster.regions(tile.present(), diagonal)[tile.at] + 1}

    return tiles.per_tile(mask.select(*keys, "i", "j"), keys, (), local, "label long")


def _of_regions(regions: DataFrame, key: str, wanted: Column, *more: Column, size: int = tiles.SIZE) -> DataFrame:
    """The pixels of the regions that are ``wanted`` by their number of pixels ``n`` and the greatest of ``more``.

    Pixels are counted and dealt by region and tile, so a large region is not one task's.
    """
    place = [key, "_ti", "_tj", "ri", "rj"]
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    own = tiles.dealt(regions.withColumn("_ti", tile("i")).withColumn("_tj", tile("j")), *place, parts=tiles.parts(regions))
    names = [f"_m{k}" for k in range(len(more))]
    part = own.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), *(F.max(c).alias(m) for c, m in zip(more, names, strict=True)))
    whole = part.groupBy(key, "ri", "rj").agg(F.sum("n").alias("n"), *(F.max(m).alias(m) for m in names)).filter(wanted)
    return own.join(part.select(*place).join(whole.select(key, "ri", "rj"), [key, "ri", "rj"], "left_semi"), place, "left_semi").select(key, "i", "j", "ri", "rj")


def remove_small(mask: DataFrame, key: str, least: int) -> DataFrame:
    """(key, i, j, ri, rj): the regions with at least ``least`` pixels."""
    return _of_regions(label_regions(mask, key), key, F.col("n") >= least)


def fill_holes(pixels: DataFrame, key: str, height: int, width: int, most: int) -> DataFrame:
    """(key, i, j): the mask (v > 0) with background regions of at most ``most`` pixels off the border filled."""
    edge = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == height - 1) | (F.col("j") == width - 1)
    holes = _of_regions(label_regions(pixels.filter("v <= 0"), key, diagonal=False), key, (F.col("n") <= most) & (F.col("_m0") == 0), edge.cast("int"))
    return pixels.filter("v > 0").select(key, "i", "j").unionAll(holes.select(key, "i", "j"))


def foreground(pixels: DataFrame, key: str, height: int, width: int, min_region: int, max_hole: int, size: int = tiles.SIZE) -> DataFrame:
    """(key, i, j): regions of at least ``min_region`` pixels, holes of at most ``max_hole`` filled.

    Images of at most ``size`` by ``size`` pixels are tiles, and their pixels are dealt once.
    """
    if max(height, width) <= size:
        return _foreground_of_tiles(pixels, key, height, width, min_region, max_hole)
    kept = remove_small(pixels.filter("v > 0"), key, min_region).select(key, "i", "j").withColumn("v", F.lit(1))
    # Every pixel as background, and those kept once more: the greater counts, without a join.
    every = pixels.select(key, "i", "j").withColumn("v", F.lit(0)).unionAll(kept)
    cleaned = tiles.dealt(every, key, "i", "j", parts=tiles.parts(pixels)).groupBy(key, "i", "j").agg(F.max("v").alias("v"))
    return fill_holes(cut(cleaned), key, height, width, max_hole)


def _foreground_of_tiles(pixels: DataFrame, key: str, height: int, width: int, min_region: int, max_hole: int) -> DataFrame:
    def local(tile: tiles.Tile) -> dict:
        mask, present = np.zeros(tile.shape, bool), tile.present()
        mask[tile.at] = tile.rows.column("on").to_numpy(zero_copy_only=False)
        mask = raster.without_small(raster.regions(mask), min_region) >= 0
        root = raster.regions(present & ~mask, eight=False)[tile.at]
        behind, size = root >= 0, np.bincount(root[root >= 0], minlength=present.size)
        outer = np.zeros(present.size, bool)
        outer[root[behind & ((tile.i == 0) | (tile.j == 0) | (tile.i == height - 1) | (tile.j == width - 1))]] = True
        return {"on": np.where(behind, ~outer[root] & (size[root] <= max_hole), True)}

    on = pixels.select(key, "i", "j", F.coalesce(F.col("v") > 0, F.lit(False)).alias("on"))
    return tiles.per_tile(on, (key,), ("on",), local, "on boolean", parts=tiles.parts(pixels)).filter("on").select(key, "i", "j")


def watershed(pixels: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """(key, i, j, marker): each pixel goes to the marker that reaches it over the lowest pass.

    ``pixels`` (key, i, j, v) are the heights to flood, ``markers`` (key, i, j, marker) the sources, whose
    numbers are above 0. The cost of a path is its greatest height; ties go to the shorter path, then to
    the smaller marker. The key names one tile: each is flooded as a whole in one task, and one of more
    than ``tiles.MOST`` pixels is refused.
    """
    both = pixels.join(markers, [key, "i", "j"], "left").select(key, "i", "j", "v", F.coalesce("marker", F.lit(0)).cast("long").alias("marker"))

    def flood(tile: tiles.Tile) -> dict:
        found = raster.flood(tile.grid("v", np.inf), tile.grid("marker", 0), tile.present())
        return {"marker": found[tile.at]}

    kind = markers.schema["marker"].dataType
    flooded = tiles.per_tile(both, (key,), ("v", "marker"), flood, "marker long")
    return flooded.filter("marker > 0").withColumn("marker", F.col("marker").cast(kind))


def superpixels(pixels: DataFrame, key: str, step: int, compactness: float, rounds: int, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """(key, i, j, label): clusters by colour and place, grown from a lattice of ``step`` pixels.

    A pixel compares the centres that started in the lattice cells around its own. Labels are the
    cells' row and column, so results do not depend on task order.
    """
    cell = lambda c: F.floor(F.col(c) / step).cast("int")
    pixels = pixels.select(key, "i", "j", *channels).withColumns({"ci": cell("i"), "cj": cell("j")})
    means = [F.avg(c).alias(f"m_{c}") for c in ("i", "j", *channels)]
    centres = pixels.groupBy(key, F.struct("ci", "cj").alias("label")).agg(*means)
    around = _beside([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    place = (F.col("i") - F.col("m_i")) * (F.col("i") - F.col("m_i")) + (F.col("j") - F.col("m_j")) * (F.col("j") - F.col("m_j"))
    colour = sum(((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in channels), F.lit(0.0))
    for _ in range(rounds):
        sent = centres.withColumn("_o", around).withColumn("ci", F.col("label.ci") + F.col("_o.a")).withColumn("cj", F.col("label.cj") + F.col("_o.b")).drop("_o")
        near = pixels.join(sent, [key, "ci", "cj"]).withColumn("_d", F.round(colour + place * (compactness / step) ** 2, 6))
        labelled = cut(near.groupBy(key, "i", "j", *channels, "ci", "cj").agg(F.min(F.struct("_d", "label")).alias("b")).select(key, "i", "j", *channels, "ci", "cj", F.col("b.label").alias("label")))
        centres = labelled.groupBy(key, "label").agg(*means)
    return labelled.select(key, "i", "j", F.concat_ws(":", "label.ci", "label.cj").alias("label"))


def merge_superpixels(pixels: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, label, merged): superpixels that touch and differ by less than ``threshold`` in mean colour become one.

    ``pixels`` are (key, i, j, label, v). Similar neighbours are linked and each connected set is named
    by its smallest label.
    """
    means = pixels.groupBy(key, "label").agg(F.avg("v").alias("m"))
    sent = pixels.withColumn("_o", _beside(_FOUR)).select(key, (F.col("i") + F.col("_o.a")).alias("i"), (F.col("j") + F.col("_o.b")).alias("j"), F.col("label").alias("other"))
    touch = pixels.join(sent, [key, "i", "j"]).filter("label <> other").select(key, "label", "other").distinct()
    left, right = means.select(key, "label", F.col("m").alias("m1")), means.select(key, F.col("label").alias("other"), F.col("m").alias("m2"))
    alike = touch.join(left, [key, "label"]).join(right, [key, "other"]).filter(F.abs(F.col("m1") - F.col("m2")) < threshold)
    node = lambda c: F.struct(key, F.col(c).alias("label"))
    sets = connected_components(alike.select(node("label").alias("src"), node("other").alias("dst"))).select(f"node.{key}", "node.label", F.col("label.label").alias("merged"))
    return means.select(key, "label").join(sets, [key, "label"], "left").select(key, "label", F.coalesce("merged", "label").alias("merged"))


def stitch(tiles: DataFrame, height: int, width: int, key: str = "slide_id") -> DataFrame:
    """(key, i, j, v): pixels (key, tile_i, tile_j, i, j, v) in the slide's frame, cropped; where tiles overlap the last one in order wins."""
    moved = tiles.withColumn("y", F.col("tile_i") + F.col("i")).withColumn("x", F.col("tile_j") + F.col("j")).filter((F.col("y") < height) & (F.col("x") < width))
    return moved.groupBy(key, F.col("y").alias("i"), F.col("x").alias("j")).agg(F.max_by("v", F.struct("tile_i", "tile_j")).alias("v"))


def local_maxima(pixels: DataFrame, keys: tuple[str, ...], size: int, least: float) -> DataFrame:
    """(keys, i, j): pixels of at least ``least`` that no pixel of their box exceeds."""
    half = size // 2
    top = pixels.withColumn("_m", F.max("v").over(Window.partitionBy(*keys, "i").orderBy("j").rangeBetween(-half, half)))
    top = top.withColumn("_m", F.max("_m").over(Window.partitionBy(*keys, "j").orderBy("i").rangeBetween(-half, half)))
    return top.filter((F.col("v") >= least) & (F.col("v") == F.col("_m"))).select(*keys, "i", "j")


def instance_map(tiles: DataFrame, height: int, width: int, level: float, key: str = "slide_id") -> DataFrame:
    """(key, ri, rj, area, cx, cy): the regions above ``level`` of a slide put together from tiles, with rounded centroids."""
    whole = cut(stitch(tiles, height, width, key))
    found = label_regions(whole.filter(F.col("v") > level), key)
    middle = lambda c: F.rint(F.avg(c)).cast("long")
    return found.groupBy(key, "ri", "rj").agg(F.count(F.lit(1)).alias("area"), middle("j").alias("cx"), middle("i").alias("cy"))


def without_background(pixels: DataFrame, key: str, tissue: DataFrame, least: float = 0.1) -> DataFrame:
    """The pixels (key, i, j, label, ...) of superpixels of which at least a share lies in ``tissue`` (key, i, j)."""
    inside = tissue.select(key, "i", "j").withColumn("_in", F.lit(1))
    share = pixels.join(inside, [key, "i", "j"], "left").groupBy(key, "label").agg(F.avg(F.coalesce("_in", F.lit(0))).alias("_share"))
    return pixels.join(share.filter(F.col("_share") >= least).select(key, "label"), [key, "label"])


def merge_tissue(pixels: DataFrame, key: str, tissue: DataFrame, threshold: float, least: float = 0.1) -> DataFrame:
    """(key, label, merged): the superpixels of which at least a share lies in ``tissue``, merged hierarchically by mean colour.

    ``pixels`` are (key, i, j, label, r, g, b). As long as two that touch differ by less than
    ``threshold``, the two that differ least become one and are compared anew.
    """
    return merge_by_color(without_background(pixels, key, tissue, least), key, threshold, 0.0, 1.0)


#: Equal parts of 0..255 whose shares describe a superpixel's channel.
COLOR_BINS = 4


def merge_by_color(pixels: DataFrame, key: str, threshold: float, hist_weight: float = 0.5, mean_weight: float = 0.5) -> DataFrame:
    """(key, label, merged): superpixels merged as long as two that touch differ by less than ``threshold``.

    ``pixels`` are (key, i, j, label, r, g, b). Two superpixels differ by half the distance of their
    unit mean colours and by half that of their unit histograms, averaged over the channels. The two
    that differ least are merged first, and what they are together is compared with its neighbours. A
    tile's superpixels, of which there are few, are merged in one task; pixels are aggregated before.
    """
    channels = ("r", "g", "b")
    bins = [F.count(F.when(F.floor(F.col(c) * COLOR_BINS / 256) == k, 1)).cast("double") for c in channels for k in range(COLOR_BINS)]
    parts = pixels.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(c).cast("double") for c in channels)).alias("total"), F.array(*bins).alias("hist"))
    sent = pixels.withColumn("_o", _beside(_EIGHT)).select(key, (F.col("i") + F.col("_o.a")).alias("i"), (F.col("j") + F.col("_o.b")).alias("j"), F.col("label").alias("other"))
    touch = pixels.select(key, "i", "j", "label").join(sent, [key, "i", "j"]).filter("label <> other").select(key, F.least("label", "other").alias("label"), F.greatest("label", "other").alias("other")).distinct()
    near = touch.groupBy(key, "label").agg(F.array_sort(F.collect_set("other")).alias("near"))
    kinds = {f.name: f.dataType.simpleString() for f in pixels.select(key, "label").schema}
    table = parts.join(near, [key, "label"], "left")
    one = F.sort_array(F.collect_list(F.struct("label", "total", "hist", "near"))).alias("parts")
    kind = f"array<struct<label:{kinds['label']},merged:{kinds['label']}>>"
    merged = table.groupBy(key).agg(one).mapInArrow(lambda it: _merge_tiles(it, threshold, hist_weight, mean_weight), f"{key} {kinds[key]}, found {kind}")
    return merged.select(key, F.explode("found").alias("_f")).select(key, "_f.*")


def _merge_tiles(batches: Iterator[pa.RecordBatch], threshold: float, hist_weight: float, mean_weight: float) -> Iterator[pa.RecordBatch]:
    """One row a tile: (key, parts) to (key, found)."""
    for batch in batches:
        label = batch.schema.field("parts").type.value_type.field("label").type
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [_merged(tile, threshold, hist_weight, mean_weight) for tile in part.column("parts").to_pylist()]
            kind = pa.list_(pa.struct([("label", label), ("merged", label)]))
            yield pa.record_batch([part.column(0), pa.array(found, kind)], [batch.schema.names[0], "found"])


def _unit(values: list[float]) -> list[float]:
    length = max(math.sqrt(sum(v * v for v in values)), 1e-12)
    return [v / length for v in values]


def _merged(parts: list[dict], threshold: float, hist_weight: float, mean_weight: float) -> list[dict]:
    """The superpixels of one tile, sorted by label, and the label of what each is merged into; unit vectors are made once for each."""
    at = {part["label"]: k for k, part in enumerate(parts)}
    total, hist = [part["total"] for part in parts], [part["hist"] for part in parts]
    near: list[set[int]] = [set() for _ in parts]
    for k, part in enumerate(parts):
        for o in part["near"] or []:
            near[k].add(at[o])
            near[at[o]].add(k)
    shares = lambda h: [_unit(h[c : c + COLOR_BINS]) for c in range(0, 3 * COLOR_BINS, COLOR_BINS)]
    mean, shape = [_unit(t) for t in total], [shares(h) for h in hist]

    def differ(a: int, b: int) -> float:
        far = math.dist(mean[a], mean[b]) / 2
        other = sum(math.dist(x, y) / 2 for x, y in zip(shape[a], shape[b], strict=True)) / 3
        return round(hist_weight * other + mean_weight * far, 9)

    agenda = [(differ(a, b), a, b, 0, 0) for a in range(len(near)) for b in near[a] if a < b]
    heapq.heapify(agenda)
    into, age = list(range(len(near))), [0] * len(near)
    while agenda and agenda[0][0] < threshold:
        _, a, b, age_a, age_b = heapq.heappop(agenda)
        if into[a] != a or into[b] != b or (age[a], age[b]) != (age_a, age_b):
            continue
        into[b] = a
        total[a] = [x + y for x, y in zip(total[a], total[b], strict=True)]
        hist[a] = [x + y for x, y in zip(hist[a], hist[b], strict=True)]
        mean[a], shape[a] = _unit(total[a]), shares(hist[a])
        near[a] = {o for o in near[a] | near[b] if o not in (a, b)}
        age[a] += 1
        for o in near[a]:
            near[o] = (near[o] - {b}) | {a}
            x, y = min(a, o), max(a, o)
            heapq.heappush(agenda, (differ(x, y), x, y, age[x], age[y]))
    root = lambda k: k if into[k] == k else root(into[k])
    return [{"label": part["label"], "merged": parts[root(k)]["label"]} for k, part in enumerate(parts)]
