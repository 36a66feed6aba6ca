"""Neighbourhood operators over pixel tables (keys, i, j, v).

Separable filters run as two window passes, one along the rows and one along the columns; a window is
partitioned by image and line, so no task needs a whole image. Other stencils work on tiles with a halo.
"""

from __future__ import annotations

from math import exp

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions import raster
from tesselon.operators import tiles


def _line(keys: tuple[str, ...], along: str):
    return Window.partitionBy(*keys, "i" if along == "j" else "j").orderBy(along)


def _separable(pixels: DataFrame, keys: tuple[str, ...], size: int, function, value: str = "v") -> DataFrame:
    half = size // 2
    for along in ("j", "i"):
        pixels = pixels.withColumn(value, function(value).over(_line(keys, along).rowsBetween(-half, size - 1 - half)))
    return pixels


def box_blur(pixels: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """Mean of the ``size`` by ``size`` box, of those pixels that lie inside the image."""
    half = size // 2
    for along in ("j", "i"):
        w = _line(keys, along).rowsBetween(-half, size - 1 - half)
        sums = F.sum("v").over(w), (F.count(F.lit(1)).over(w) if along == "j" else F.sum("_n").over(w))
        pixels = pixels.withColumns({"_s": sums[0], "_m": sums[1]}).withColumns({"v": F.col("_s"), "_n": F.col("_m")})
    return pixels.withColumn("v", F.col("v") / F.col("_n")).drop("_s", "_m", "_n")


def gaussian_blur(pixels: DataFrame, keys: tuple[str, ...], size: int, sigma: float) -> DataFrame:
    """Gaussian mean of the ``size`` by ``size`` box, weights renormalised at the border."""
    half = range(-(size // 2), size - size // 2)
    weights = [(di, dj, exp(-(di * di + dj * dj) / (2 * sigma * sigma))) for di in half for dj in half]

    def blur(tile: tiles.Tile) -> dict:
        own = raster.correlate(tile.grid("v", 0.0), weights) / raster.correlate(tile.present().astype(float), weights)
        return {"v": own[tile.at]}

    return tiles.per_tile(pixels, keys, ("v",), blur, "v double", tiles.SIZE, size // 2)


def median_blur(pixels: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """Median of the ``size`` by ``size`` box, of those pixels that lie inside the image."""
    blur = lambda tile: {"v": raster.median(tile.grid("v"), size // 2, size - 1 - size // 2)[tile.at]}
    return tiles.per_tile(pixels, keys, ("v",), blur, "v double", tiles.SIZE, size // 2)


def erode(pixels: DataFrame, keys: tuple[str, ...], size: int, times: int = 1) -> DataFrame:
    for _ in range(times):
        pixels = _separable(pixels, keys, size, F.min)
    return pixels


def dilate(pixels: DataFrame, keys: tuple[str, ...], size: int, times: int = 1) -> DataFrame:
    for _ in range(times):
        pixels = _separable(pixels, keys, size, F.max)
    return pixels


def morph_open(pixels: DataFrame, keys: tuple[str, ...], size: int, times: int = 1) -> DataFrame:
    """``times`` erosions, then as many dilations."""
    return dilate(erode(pixels, keys, size, times), keys, size, times)


def morph_close(pixels: DataFrame, keys: tuple[str, ...], size: int, times: int = 1) -> DataFrame:
    """``times`` dilations, then as many erosions."""
    return erode(dilate(pixels, keys, size, times), keys, size, times)


def sobel_weights(size: int) -> list[tuple[int, int, float, float]]:
    """(di, dj, horizontal, vertical) of gradient kernels that fall off with the squared distance."""
    half = range(-(size // 2), size // 2 + 1)
    return [(di, dj, dj / (di * di + dj * dj + 1e-5), di / (di * di + dj * dj + 1e-5)) for di in half for dj in half]


def sobel(pixels: DataFrame, keys: tuple[str, ...], size: int = 5) -> DataFrame:
    """Columns gh and gv: correlation with the gradient kernels, zero outside the image."""
    kernels = {n: [(di, dj, w[k]) for di, dj, *w in sobel_weights(size)] for k, n in enumerate(("gh", "gv"))}

    def gradient(tile: tiles.Tile) -> dict:
        v = tile.grid("v", 0.0)
        return {n: raster.correlate(v, w)[tile.at] for n, w in kernels.items()}

    return tiles.per_tile(pixels, keys, ("v",), gradient, "gh double, gv double", tiles.SIZE, size // 2)


def boundary_outside(mask: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pixels outside a mask (rows are its pixels) that touch it, diagonals included."""
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)))
    around = mask.withColumn("_o", near).select(*keys, (F.col("i") + F.col("_o.a")).alias("i"), (F.col("j") + F.col("_o.b")).alias("j")).distinct()
    return around.join(mask.select(*keys, "i", "j"), [*keys, "i", "j"], "left_anti")


def erode_edges(labels: DataFrame, keys: tuple[str, ...], width: int, label: str = "label") -> DataFrame:
    """(keys, i, j, label) without, ``width`` times, the pixels of each object that touch another label or the background inside the image."""

    def erode_tile(tile: tiles.Tile) -> dict:
        own, there = tile.grid(label, 0), tile.present()
        for _ in range(width):
            gone = np.zeros(own.shape, bool)
            for di, dj in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                gone |= raster.moved(there, di, dj, False) & (raster.moved(own, di, dj, 0) != own)
            own = np.where(gone, 0, own)
        return {label: own[tile.at]}

    kind = labels.schema[label].dataType.simpleString()
    found = tiles.per_tile(labels.withColumn(label, F.col(label).cast("long")), keys, (label,), erode_tile, f"{label} long", tiles.SIZE, width)
    return found.withColumn(label, F.col(label).cast(kind))


#: How an image goes on beyond its sides: mirrored at its outer pixels, or with these repeated.
BORDERS = {"reflect": "reflect", "replicate": "edge"}


def _beyond(tile: tiles.Tile, size: int, half: int, border: str) -> tuple[np.ndarray, tuple]:
    """The tile's values with ``half`` pixels around it, and where its rows' own pixels lie; beyond the image as ``border`` says."""
    grid, pads, at = tile.grid("v"), [], []
    for start, n, place, name in ((tile.top, tile.shape[0], tile.at[0], "_ti"), (tile.left, tile.shape[1], tile.at[1], "_tj")):
        own = tile.rows.column(name)[0].as_py() * size
        before, after = half - (own - start), half - max(0, start + n - own - size)
        pads.append((before, after))
        at.append(place + before)
    return np.pad(grid, pads, mode=BORDERS[border]), tuple(at)


def blur_within(pixels: DataFrame, keys: tuple[str, ...], kind: str, size: int, sigma: float = 1.0, border: str = "reflect") -> DataFrame:
    """A ``box``, ``gaussian`` or ``median`` blur with images going on beyond their sides as native libraries let them.

    ``border`` is ``reflect``, mirrored without repeating the outer pixels, or ``replicate``. ``size`` is
    odd. Images are whole rectangles.
    """
    if kind not in ("box", "gaussian", "median") or border not in BORDERS or size % 2 == 0:
        raise ValueError(f"{kind}, {border}, {size}: kinds are box, gaussian and median, borders {', '.join(BORDERS)}, sizes odd")
    half, side = size // 2, max(tiles.SIZE, size)
    line = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma)) if kind == "gaussian" else np.ones(size)
    line = line / line.sum()

    def run(tile: tiles.Tile) -> dict:
        wide, at = _beyond(tile, side, half, border)
        if kind == "median":
            out = np.median(np.lib.stride_tricks.sliding_window_view(wide, (size, size)), axis=(2, 3))
        else:
            out = np.apply_along_axis(np.convolve, 0, np.apply_along_axis(np.convolve, 1, wide, line, "valid"), line, "valid")
        # Pixels near the tile have no whole box; they are another tile's.
        inside = tuple(np.clip(a - half, 0, n - 1) for a, n in zip(at, out.shape, strict=True))
        return {"v": out[inside]}

    return tiles.per_tile(pixels.withColumn("v", F.col("v").cast("double")), keys, ("v",), run, "v double", side, half)
