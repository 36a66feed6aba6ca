"""Image files as tables: headers by column expressions over ``binaryFile``, tiles by a batch reader."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content) of the files below ``path``, found recursively."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def is_tiff(content: Column) -> Column:
    """Little- or big-endian TIFF or BigTIFF by the first four bytes."""
    return F.hex(F.substring(content, 1, 4)).isin("49492A00", "4D4D002A", "49492B00", "4D4D002B")


def placement(x: Column, x_resolution: Column, y: Column, y_resolution: Column) -> tuple[Column, Column]:
    """Pixel offsets of a region from its physical position and resolution."""
    return F.rint(x * x_resolution).cast("long"), F.rint(y * y_resolution).cast("long")


def intact(content: Column, digest: Column) -> Column:
    return F.md5(content) == digest


def tissue_of(path: Column) -> Column:
    """The third part, between underscores, of a file's stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.get(F.split(stem, "_"), 2)


def _directory(raw: bytes) -> tuple[str, dict[int, tuple[int, ...]]]:
    order = "<" if raw[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", raw, 4)
    (n,) = struct.unpack_from(order + "H", raw, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        size, code = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}.get(kind, (0, ""))
        if code:
            place = at + 10 + 12 * k if size * count <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", raw, place)
    return order, tags


def tiff_tiles(found: DataFrame, size: int) -> DataFrame:
    """(path, tile_i, tile_j, height, width, channels, image) of uncompressed 8-bit striped TIFF files.

    Each file is cut into tiles of at most ``size`` by ``size``; what hangs over the edge is left out.
    Files of another kind give no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                if raw is None or bytes(raw[:4]) not in (b"II*\0", b"MM\0*"):
                    continue
                _, tags = _directory(raw)
                if tags.get(259, (1,))[0] != 1 or set(tags.get(258, (8,))) != {8}:
                    continue
                width, height, channels = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
                pixels = b"".join(raw[a : a + n] for a, n in zip(tags[273], tags[279], strict=True))
                image = np.frombuffer(pixels, np.uint8)[: height * width * channels].reshape(height, width, channels)
                for i in range(0, height, size):
                    for j in range(0, width, size):
                        part = image[i : i + size, j : j + size]
                        rows.append((path, i, j, part.shape[0], part.shape[1], channels, part.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "tile_i", "tile_j", "height", "width", "channels", "image"])

    return found.filter(is_tiff(F.col("content"))).select("path", "content").mapInPandas(run, "path string, tile_i int, tile_j int, height int, width int, channels int, image binary")


def pixels(tiles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, i, j, c, v) of 8-bit tiles (height, width, channels, image), without leaving the JVM.

    If there is a column ``held``, with a byte for each pixel or null, pixels with zero there are none.
    """
    n = F.col("height") * F.col("width") * F.col("channels")
    held = [c for c in ("held",) if c in tiles.columns]
    at = tiles.select(*keys, "height", "width", "channels", "image", *held, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("k"))
    if held:
        at = at.filter(F.expr("held IS NULL OR substring(held, k div channels + 1, 1) <> X'00'"))
    value = F.conv(F.hex(F.expr("substring(image, k + 1, 1)")), 16, 10).cast("int")
    row = F.col("width") * F.col("channels")
    return at.select(*keys, F.floor(F.col("k") / row).cast("int").alias("i"), F.floor((F.col("k") % row) / F.col("channels")).cast("int").alias("j"), (F.col("k") % F.col("channels")).alias("c"), value.alias("v"))
