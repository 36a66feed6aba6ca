"""Work on whole tiles of pixel rows, in numpy inside Arrow batches.

Pixels (keys, i, j, values) are dealt by tile and sorted, so each tile comes to its task as one run of
rows; a task holds one tile at a time. With a halo, pixels near a tile's edge also go to its neighbours.
Steps that reach farther than a halo, such as connected regions, join the tiles' results at their edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256
#: Pixels of an image that is worked on as a whole.
MOST = 1 << 24
#: Pixel rows that a task is dealt; a tile is never divided.
ROWS = 1 << 20


class Tile:
    """The pixels of one tile: their places, and grids of their values from the tile's corner on."""

    def __init__(self, rows: pa.RecordBatch):
        column = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        self.rows, self.i, self.j = rows, column("i").astype(np.int64), column("j").astype(np.int64)
        self.top, self.left = self.i.min(), self.j.min()
        self.shape = int(self.i.max() - self.top + 1), int(self.j.max() - self.left + 1)
        if self.shape[0] * self.shape[1] > MOST:
            raise ValueError(f"an image of {self.shape[0]} by {self.shape[1]} pixels must be tiled first")
        self.at = self.i - self.top, self.j - self.left

    def grid(self, name: str, fill=np.nan) -> np.ndarray:
        out = np.full(self.shape, fill, np.result_type(type(fill), np.float64) if isinstance(fill, float) else np.int64)
        values = self.rows.column(name).to_numpy(zero_copy_only=False)
        out[self.at] = np.where(values != values, fill, values) if values.dtype.kind == "f" else values
        return out

    def present(self) -> np.ndarray:
        out = np.zeros(self.shape, bool)
        out[self.at] = True
        return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one tile after the other; batches are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
            if held:
                change[0] |= bool(held[-1].column(k)[-1] != batch.column(k)[0])
        at = 0
        for stop in np.flatnonzero(change).tolist():
            if stop > at:
                held.append(batch.slice(at, stop - at))
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, at = [], stop
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def overlapping(pixels: DataFrame, size: int, halo: int) -> DataFrame:
    """``pixels`` with the tile (_ti, _tj) of each, those within ``halo`` of another tile also with that one's."""
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)))
    return pixels.withColumn("_ti", near("i")).withColumn("_tj", near("j"))


def dealt(pixels: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """``pixels`` dealt by columns to ``parts`` partitions, or as Spark finds best."""
    return pixels.repartition(parts, *by) if parts else pixels.repartition(*by)


def parts(pixels: DataFrame) -> int | None:
    """Partitions to which ``pixels`` are dealt so that none holds many more than ``ROWS``; None for few pixels.

    Pixel rows are compressed to a small part of their size, and Spark puts partitions together by that
    size, so that a task would hold ever more rows.
    """
    spark, rows = pixels.sparkSession, pixels.count()
    if rows <= ROWS * spark.sparkContext.defaultParallelism:
        return None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // ROWS)


def _own(rows: pa.RecordBatch, size: int | None) -> np.ndarray:
    """Which of a tile's pixels lie in it and not only near it."""
    if not size:
        return np.ones(rows.num_rows, bool)
    return np.logical_and(*(rows.column(c).to_numpy() // size == rows.column(t)[0].as_py() for c, t in (("i", "_ti"), ("j", "_tj"))))


def per_tile_rows(pixels: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], function: Callable[[Tile, np.ndarray], dict[str, np.ndarray]], schema: str, size: int, halo: int = 0) -> DataFrame:
    """(keys, ...): any number of rows from each tile and the pixels within ``halo`` of it.

    ``function`` also gets a grid of which places are the tile's own pixels.
    """
    by, kinds = [*keys, "_ti", "_tj"], {f.name: f.dataType.simpleString() for f in pixels.select(*keys).schema}
    new = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, by):
            own = _own(rows, size)
            if not own.any():
                continue
            tile = Tile(rows)
            grid = np.zeros(tile.shape, bool)
            grid[tile.at] = own
            found = function(tile, grid)
            n = len(found[new[0]])
            columns = [*(pa.array([rows.column(k)[0].as_py()] * n, rows.schema.field(k).type) for k in keys), *(pa.array(found[c]) for c in new)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *new])

    ordered = overlapping(pixels.select(*keys, "i", "j", *values), size, halo).repartition(*by).sortWithinPartitions(*by)
    return ordered.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keys), schema]))


def per_tile(pixels: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], function: Callable[[Tile], dict[str, np.ndarray]], schema: str, size: int | None = None, halo: int = 0, parts: int | None = None) -> DataFrame:
    """(keys, i, j, ...): new values of every pixel from the tile that it lies in.

    ``function`` gives one array a new column, in the order of the tile's pixels; ``schema`` names them
    and their types. Without a ``size`` an image is one tile. Keys must not be null. ``parts`` are the
    partitions to which tiles are dealt.
    """
    names = [*keys, "i", "j"]
    sent, by = pixels.select(*names, *values), list(keys)
    if size:
        sent, by = overlapping(sent, size, halo), [*keys, "_ti", "_tj"]
    kinds = {f.name: f.dataType.simpleString() for f in pixels.select(*names).schema}
    new = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, by):
            own = _own(rows, size)
            if not own.any():
                continue
            found = function(Tile(rows))
            columns = [*(rows.column(c) for c in names), *(pa.array(found[c]) for c in new)]
            out = pa.RecordBatch.from_arrays(columns, [*names, *new])
            yield out if own.all() else out.filter(pa.array(own))

    ordered = dealt(sent, *by, parts=parts).sortWithinPartitions(*by)
    return ordered.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), schema]))
