"""Images of another size by cubic splines, one axis after the other, each over whole lines.

A line's spline goes through its pixels: its coefficients solve a system with 1/6, 4/6, 1/6 on three
diagonals, mirrored at the ends, by one elimination along the line and back. The new pixels lie evenly
from the line's first to its last pixel. Lines are dealt over the cluster; a task solves as many at a
time as have the same length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coefficients(lines: np.ndarray) -> np.ndarray:
    """The coefficients of the splines through lines (lines, pixels)."""
    n = lines.shape[1]
    if n < 2:
        return lines.astype(float)
    below, above, right = np.ones(n), np.ones(n), 6.0 * lines
    below[-1] = above[0] = 2.0  # the neighbour beyond an end is the one before it
    ratio, out = np.zeros(n), np.empty(lines.shape)
    ratio[0], out[:, 0] = above[0] / 4, right[:, 0] / 4
    for k in range(1, n):
        left = 4 - below[k] * ratio[k - 1]
        ratio[k] = above[k] / left
        out[:, k] = (right[:, k] - below[k] * out[:, k - 1]) / left
    for k in range(n - 2, -1, -1):
        out[:, k] -= ratio[k] * out[:, k + 1]
    return out


def sampled(coefficient: np.ndarray, size: int) -> np.ndarray:
    """The splines at ``size`` places from the first pixel to the last."""
    n = coefficient.shape[1]
    place = np.arange(size) * ((n - 1) / (size - 1) if size > 1 else 0.0)
    first = np.minimum(np.floor(place).astype(np.int64), max(n - 2, 0))
    t = place - first
    weights = ((1 - t) ** 3, 4 - 6 * t**2 + 3 * t**3, 1 + 3 * t + 3 * t**2 - 3 * t**3, t**3)
    out = np.zeros((len(coefficient), size))
    for d, w in enumerate(weights, -1):
        at = np.abs(first + d)
        at = np.where(at > n - 1, 2 * (n - 1) - at, at) if n > 1 else np.zeros(size, np.int64)
        out += coefficient[:, at] * (w / 6)
    return out


def _along(pixels: DataFrame, keys: tuple[str, ...], line: str, axis: str, size: int, value: str) -> DataFrame:
    """Each line of pixels resampled to ``size``; ``line`` tells lines apart, ``axis`` counts along them."""
    by = [*keys, line]
    kinds = {f.name: f.dataType.simpleString() for f in pixels.select(*by).schema}
    rows = pixels.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(axis, F.col(value).cast("double").alias("v")))).alias("_line")).select(*by, F.transform("_line", lambda s: s["v"]).alias("_line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column("_line")
            lengths = np.diff(lines.offsets.to_numpy())
            out = np.empty((batch.num_rows, size))
            for n in np.unique(lengths):
                own = np.flatnonzero(lengths == n)
                flat = lines.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), n)
                out[own] = sampled(coefficients(flat), size)
            columns = [batch.column(c).take(pa.array(np.repeat(np.arange(batch.num_rows), size))) for c in by]
            yield pa.record_batch([*columns, pa.array(np.tile(np.arange(size, dtype=np.int32), batch.num_rows)), pa.array(out.ravel())], [*by, axis, value])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), f"{axis} int, {value} double"]))


def zoom(pixels: DataFrame, keys: tuple[str, ...], size: tuple[int, int], value: str = "v") -> DataFrame:
    """(keys, i, j, value): whole images (keys, i, j, value) as ones of ``size``, by cubic splines.

    The corners' pixels stay what they are. A line must fit into a task's memory, an image need not.
    """
    wide = _along(pixels, keys, "i", "j", size[1], value)
    return _along(wide, keys, "j", "i", size[0], value).select(*keys, "i", "j", value)
