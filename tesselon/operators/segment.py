"""Instances from the outputs of segmentation models: markers, watersheds and what cleans them up.

Outputs are pixel rows whose key names one tile; each tile is worked on as a whole in one task. Heights
of watersheds are rounded to nine digits, so that places which are equal but for the order of sums tie.
Labels are numbered from 1 in the order of their first pixels' places (or of their markers').
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions import raster
from tesselon.lineage import cut
from tesselon.operators import stencil, threshold, tiles
from tesselon.operators.graph import connected_components
from tesselon.operators.point import rescale_intensity


def binomial(n: int) -> np.ndarray:
    row = np.ones(1)
    for _ in range(n - 1):
        row = np.convolve(row, [1.0, 1.0])
    return row


def derivative_kernels(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Smoothing and first derivative of width ``size``: binomial weights, and their differences."""
    return binomial(size), np.convolve(binomial(size - 2), [-1.0, 0.0, 1.0])


def _lines(a: np.ndarray, kernel: np.ndarray, axis: int, mode: str) -> np.ndarray:
    half, n = len(kernel) // 2, a.shape[axis]
    wide = np.pad(a, [(half, half) if k == axis else (0, 0) for k in range(2)], mode=mode)
    return sum(w * np.take(wide, range(k, k + n), axis) for k, w in enumerate(kernel))


def _numbered(found: np.ndarray) -> np.ndarray:
    """Labels (0: none) renumbered 1, 2, ... in their order."""
    own = np.unique(found[found > 0])
    return np.where(found > 0, np.searchsorted(own, found) + 1, 0)


def _kept(labels: np.ndarray, least: int) -> np.ndarray:
    size = np.bincount(labels.ravel())
    return np.where(size[labels] >= least, labels, 0)


def _keys(key: str | tuple[str, ...]) -> tuple[str, ...]:
    return (key,) if isinstance(key, str) else tuple(key)


def hovernet(pixels: DataFrame, key: str | tuple[str, ...], least: int = 10, size: int = 21, h: float = 0.5, k: float = 0.5) -> DataFrame:
    """(key, i, j, label) of nuclei from logits and distance maps: ``pixels`` are (key, i, j, n0, n1, h, v).

    Pixels whose probability (softmax of n0, n1) reaches ``h`` form the mask, without regions of fewer
    than ``least`` pixels. The distance maps and then their derivatives are stretched to 0..1 over the
    tile; where both derivatives are small the energy is high. Regions of energies from ``k`` on, holes
    filled and small ones dropped, are the markers, from which the smoothed energy is flooded inside the
    mask. Borders are mirrored at the outer pixels. Label 0 is background.
    """
    smooth, slope = derivative_kernels(size)

    def run(tile: tiles.Tile) -> dict:
        grid = {c: tile.grid(c, 0.0) for c in ("n0", "n1", "h", "v")}
        likely = 1 / (1 + np.exp(np.clip(grid["n0"] - grid["n1"], -700, 700)))
        mask = raster.without_small(raster.regions((likely >= h) & tile.present()), least) >= 0
        steep = []
        for c, axis in (("h", 1), ("v", 0)):
            own = _lines(_lines(raster.stretched(grid[c]), slope, axis, "reflect"), smooth, 1 - axis, "reflect")
            steep.append(1 - raster.stretched(own))
        energy = np.where(mask, 1 - np.maximum(*steep), 0.0)
        hills = np.round(energy, 9) >= k
        hills |= raster.holes(hills)
        root = raster.without_small(raster.regions(hills), least)
        soft = np.array([0.25, 0.5, 0.25])
        height = 1 - _lines(_lines(energy, soft, 0, "reflect"), soft, 1, "reflect")
        return {"label": _numbered(raster.flood(np.round(height * 1e9), root + 1, mask))[tile.at]}

    return tiles.per_tile(pixels, _keys(key), ("n0", "n1", "h", "v"), run, "label long")


def across_tiles(pixels: DataFrame, key: str, size: int, halo: int, segmented: Callable[[DataFrame, tuple[str, ...]], DataFrame], share: float = 0.5) -> DataFrame:
    """(key, i, j, ri, rj): the instances of whole images that are segmented in tiles, each named by its first pixel.

    Tiles of ``size`` are widened by ``halo`` on each side. ``segmented`` labels their pixels: from pixels
    and the columns that name a tile to (those columns, i, j, label), 0 for background. Instances of
    two tiles are the same where, among the pixels that both tiles hold, they have at least ``share`` of
    the smaller one's pixels in common; what is the same as another goes on over any number of tiles. A
    pixel belongs to the instance that its own tile gave it.
    """
    names = (key, "_ti", "_tj")
    found = cut(segmented(tiles.overlapping(pixels, size, halo), names).select(*names, "i", "j", "label"))
    node = F.struct("_ti", "_tj", "label")
    # Only pixels near a tile's edge lie in several tiles.
    near = lambda c: (F.pmod(F.col(c), F.lit(size)) < halo) | (F.pmod(F.col(c), F.lit(size)) >= size - halo)
    strip = found.filter(near("i") | near("j")).select(key, "i", "j", "_ti", "_tj", "label")
    other = strip.select(key, "i", "j", F.col("_ti").alias("_ui"), F.col("_tj").alias("_uj"), F.col("label").alias("_other"))
    pairs = strip.join(other, [key, "i", "j"]).filter((F.struct("_ti", "_tj") < F.struct("_ui", "_uj")) & ((F.col("label") > 0) | (F.col("_other") > 0)))
    counts = cut(pairs.groupBy(key, "_ti", "_tj", "label", "_ui", "_uj", "_other").agg(F.count(F.lit(1)).alias("n")))
    both = [key, "_ti", "_tj", "_ui", "_uj"]
    left = counts.filter("label > 0").groupBy(*both, "label").agg(F.sum("n").alias("_left"))
    right = counts.filter("_other > 0").groupBy(*both, "_other").agg(F.sum("n").alias("_right"))
    met = counts.filter("label > 0 AND _other > 0").join(left, [*both, "label"]).join(right, [*both, "_other"]).filter(F.col("n") >= share * F.least("_left", "_right"))
    end = lambda i, j, label: F.struct(key, F.struct(F.col(i).alias("_ti"), F.col(j).alias("_tj"), F.col(label).alias("label")).alias("at"))
    same = cut(met.select(end("_ti", "_tj", "label").alias("src"), end("_ui", "_uj", "_other").alias("dst")))
    own = found.filter((F.col("label") > 0) & (F.floor(F.col("i") / size) == F.col("_ti")) & (F.floor(F.col("j") / size) == F.col("_tj"))).select(key, "i", "j", node.alias("at"))
    if not same.isEmpty():
        merged = connected_components(same).select(f"node.{key}", "node.at", F.col("label.at").alias("_to"))
        own = own.join(merged, [key, "at"], "left").select(key, "i", "j", F.coalesce("_to", "at").alias("at"))
    first = own.groupBy(key, "at").agg(F.min(F.struct("i", "j")).alias("f"))
    return own.join(first, [key, "at"]).select(key, "i", "j", F.col("f.i").alias("ri"), F.col("f.j").alias("rj"))


def _dilated(a: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    out = a
    for di, dj in offsets:
        out = np.maximum(out, raster.moved(a, di, dj, -np.inf))
    return out


def _box(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]


def _peaks(maxima: np.ndarray, how: str, radius: int, level: float) -> np.ndarray:
    if how == "peak_local_max":
        return (maxima == _dilated(maxima, _box(radius))) & (maxima > level)
    return np.round(maxima - raster.reconstructed(maxima - level, maxima, radius), 9) >= level


def _smoothed(a: np.ndarray, sigma: float) -> np.ndarray:
    if not sigma:
        return a
    half = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return _lines(_lines(a, kernel, 0, "symmetric"), kernel, 1, "symmetric")


def _holes_within_labels(labels: np.ndarray, most: int) -> np.ndarray:
    """Background regions of at most ``most`` pixels take the one label around them, if there is one."""
    root = np.where(raster.holes(labels > 0, most), raster.regions(labels == 0, eight=False), -1)
    low, high = np.full(root.size, np.iinfo(np.int64).max), np.zeros(root.size, np.int64)
    for di, dj in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        beside = raster.moved(labels, di, dj, 0)
        at = (root >= 0) & (beside > 0)
        np.minimum.at(low, root[at], beside[at])
        np.maximum.at(high, root[at], beside[at])
    return np.where((root >= 0) & (low[root] == high[root]), high[root], labels)


def deep_watershed(
    pixels: DataFrame,
    key: str,
    radius: int = 10,
    maxima_threshold: float = 0.1,
    interior_threshold: float = 0.01,
    maxima_smooth: float = 0,
    interior_smooth: float = 1,
    label_erosion: int = 0,
    small_objects: int = 0,
    fill_holes: int = 0,
    expansion: int = 0,
    how: str = "h_maxima",
) -> DataFrame:
    """(key, i, j, label) of cells: ``pixels`` (key, i, j, maxima, interior) are the two outputs of a model.

    Both are smoothed and the interior is widened by ``expansion``. Peaks of the maxima, by height over
    their surroundings (``h_maxima``) or as the highest of their box (``peak_local_max``), are the
    markers, from which the interior is flooded from high to low where it exceeds its threshold. Then
    labels are eroded, those of fewer than ``small_objects`` pixels dropped, holes of at most
    ``fill_holes`` pixels filled, and labels numbered anew. Label 0 is background.
    """
    if how not in ("h_maxima", "peak_local_max"):
        raise ValueError(f"{how}: peaks are found by h_maxima or peak_local_max")

    def run(tile: tiles.Tile) -> dict:
        maxima, interior = _smoothed(tile.grid("maxima", 0.0), maxima_smooth), _smoothed(tile.grid("interior", 0.0), interior_smooth)
        if expansion:
            interior = _dilated(interior, _box(expansion))
        marker = raster.regions(_peaks(maxima, how, radius, maxima_threshold) & tile.present()) + 1
        label = raster.flood(np.round(-interior * 1e9), marker, (interior > interior_threshold) & tile.present())
        for _ in range(label_erosion):
            gone = np.zeros(label.shape, bool)
            for di, dj in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                beside = raster.moved(label, di, dj, -1)
                gone |= (beside >= 0) & (beside != label)
            label = np.where(gone, 0, label)
        if small_objects:
            label = _kept(label, small_objects)
        if fill_holes:
            label = _holes_within_labels(label, fill_holes)
        return {"label": _numbered(label)[tile.at]}

    return tiles.per_tile(pixels, (key,), ("maxima", "interior"), run, "label long")


def histogram_normalization(pixels: DataFrame, keys: tuple[str, ...], block: int = 128, clip: float = 0.01, bins: int = 256, value: str = "v") -> DataFrame:
    """Each channel stretched to 0..1 and equalised adaptively; a constant channel becomes 0.

    ``keys`` name a tile's channel; ``clip`` is a share of a block's pixels, as limit of one bin.
    """
    stretched = rescale_intensity(pixels, keys, 0.0, 255.0, value)
    flat = pixels.groupBy(*keys).agg((F.min(value) == F.max(value)).alias("_flat"))
    even = threshold.adaptive_equalize(stretched, keys, block, clip * bins, bins, value)
    return even.join(flat, list(keys)).withColumn(value, F.when(F.col("_flat"), 0.0).otherwise(F.col("cdf"))).drop("cdf", "_flat")


def mesmer_preprocess(pixels: DataFrame, keys: tuple[str, ...], percentile: float = 0.999, block: int = 128, clip: float = 0.01, bins: int = 256) -> DataFrame:
    """Values of each channel cut at a percentile of those that are not 0, then normalised."""
    cut = threshold.clip_percentile(pixels, keys, percentile, "v").drop("cap")
    return histogram_normalization(cut, keys, block, clip, bins)


def mesmer_outputs(outputs: Column) -> tuple[Column, Column]:
    """(maxima, interior) of whole cells and of nuclei as structs, from an array of a pixel's four outputs, each an array of channels.

    Null unless there are exactly four.
    """
    four = F.size(outputs) == 4
    pair = lambda k: F.when(four, F.struct(outputs[k][0].alias("maxima"), outputs[k + 1][1].alias("interior")))
    return pair(0), pair(2)


def mesmer(outputs: DataFrame, key: str, cell: dict | None = None, nucleus: dict | None = None) -> DataFrame:
    """(key, i, j, cell_segmentation, nuclear_segmentation) from pixels (key, i, j, outputs)."""
    both = []
    for name, found, how in zip(("cell_segmentation", "nuclear_segmentation"), mesmer_outputs(F.col("outputs")), (cell, nucleus), strict=True):
        pixels = outputs.select(key, "i", "j", found.alias("o")).select(key, "i", "j", "o.maxima", "o.interior")
        both.append(deep_watershed(pixels, key, **(how or {})).withColumnRenamed("label", name))
    return both[0].join(both[1], [key, "i", "j"])


def filled_area(pixels: DataFrame, key: str) -> DataFrame:
    """(key, label, filled_area): pixels of each label together with the holes inside it."""

    def run(tile: tiles.Tile) -> dict:
        label = tile.grid("label", 0)
        inside = np.zeros(int(label.max()) + 1, np.int64)
        order = np.argsort(label.ravel(), kind="stable")
        own, first = np.unique(label.ravel()[order], return_index=True)
        for n, places in zip(own.tolist(), np.split(order, first[1:]), strict=True):
            if n > 0:
                i, j = np.unravel_index(places, label.shape)
                box = np.pad(label[i.min() : i.max() + 1, j.min() : j.max() + 1] == n, 1)
                inside[n] = raster.holes(box).sum()
        return {"label": label[tile.at], "_holes": inside[label][tile.at]}

    found = tiles.per_tile(pixels, (key,), ("label",), run, "label long, _holes long").filter("label > 0")
    return found.groupBy(key, "label").agg((F.count(F.lit(1)) + F.max("_holes")).alias("filled_area"))


def hv_gradient_loss(pixels: DataFrame, key: str, size: int = 5) -> DataFrame:
    """(key, grad): squared differences of both maps' derivatives, averaged over the nuclei's pixels and added.

    ``pixels`` are (key, i, j, h, v, th, tv, mask): predicted and true maps. Outside the tile counts as zero.
    """
    def slopes(name: str, kind: str, out: str) -> DataFrame:
        return stencil.sobel(pixels.select(key, "i", "j", F.col(name).alias("v")), (key,), size).select(key, "i", "j", F.col(kind).alias(out))

    joined = pixels.filter("mask = 1").select(key, "i", "j")
    for name, kind in (("h", "gh"), ("th", "gh"), ("v", "gv"), ("tv", "gv")):
        joined = joined.join(slopes(name, kind, f"_{name}"), [key, "i", "j"])
    square = lambda a, b: F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    return joined.groupBy(key).agg((square("_h", "_th") + square("_v", "_tv")).alias("grad"))
