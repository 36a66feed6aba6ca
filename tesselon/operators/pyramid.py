"""Image pyramids: tiles of all levels by rolling up quads, stored along a space-filling curve.

A tile is a row (slide_id, level, ti, tj, z, height, width, channels, image, held): ``ti`` and ``tj`` number
the tiles of a level, ``image`` holds bytes, row by row. A pixel of a level is the rounded mean of the up to
four pixels of the level below. ``held`` has a byte for each pixel, 1 if there is any below it, and is null
where no tile is missing. ``z`` interleaves the bits of ti and tj, so that all tiles below one tile
of a higher level are neighbours in its order: a task that gets them can roll up several levels at once,
and a region of a slide is a few ranges of z, by which readers skip the row groups of a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.lineage import cut

COLUMNS = ("slide_id", "level", "ti", "tj", "z", "height", "width", "channels", "image", "held")
#: Levels that are rolled up in one pass; a task holds the tiles below one tile so many levels up.
DEPTH = 4
#: Steps that spread the lower 31 bits of a number over the even bits (fixed values).
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def curve(ti: Column, tj: Column) -> Column:
    """The place of a tile on the curve, for ti and tj from 0 to 2^31 - 1."""

    def spread(x: Column) -> Column:
        x = x.cast("long")
        for by, kept in _SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(kept).cast("long"))
        return x

    return F.shiftleft(spread(ti), 1).bitwiseOR(spread(tj))


def _half(image: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An image of half the size, means rounded half up, and where it has pixels.

    What hangs over an edge or lies beside missing pixels, which are zero, is the mean of fewer pixels.
    """
    h, w, c = image.shape
    wide = np.zeros((h + h % 2, w + w % 2, c), np.int64)
    wide[:h, :w] = image
    n = np.zeros((h + h % 2, w + w % 2, 1), np.int64)
    n[:h, :w, 0] = held
    quads = lambda a: a.reshape(a.shape[0] // 2, 2, a.shape[1] // 2, 2, -1).sum(axis=(1, 3))
    total, count = quads(wide), quads(n)
    return ((2 * total + count) // (2 * np.maximum(count, 1))).astype(np.uint8), count[:, :, 0] > 0


Tiles = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def _above(tiles: Tiles, size: tuple[int, int] | None) -> Tiles:
    """The tiles of the next level, images and where they have pixels: up to four tiles side by side, halved."""
    out = {}
    for ti, tj in sorted({(i // 2, j // 2) for i, j in tiles}):
        own = {(a, b): tiles[2 * ti + a, 2 * tj + b] for a in (0, 1) for b in (0, 1) if (2 * ti + a, 2 * tj + b) in tiles}
        if size is None and (0, 0) not in own:
            raise ValueError(f"the tile at {2 * ti}, {2 * tj} is missing, from which the next level begins")
        # Holes make tiles smaller; what follows on one begins where a whole one ends.
        high, wide = ([max((t[0].shape[axis] for at, t in own.items() if at[axis] == k), default=0) for k in (0, 1)] for axis in (0, 1))
        top, left = (side[0] if size is None or not side[1] else max(side[0], size[axis]) for axis, side in enumerate((high, wide)))
        both = np.zeros((top + high[1], left + wide[1], next(iter(own.values()))[0].shape[2]), np.uint8)
        held = np.zeros(both.shape[:2], bool)
        for (a, b), (image, has) in own.items():
            place = slice(a * top, a * top + image.shape[0]), slice(b * left, b * left + image.shape[1])
            both[place], held[place] = image, has
        out[ti, tj] = _half(both, held)
    return out


def _rolled(base: DataFrame, level: int, depth: int, size: tuple[int, int] | None) -> DataFrame:
    """The tiles of the ``depth`` levels above those of ``level``."""
    kind = base.schema["slide_id"].dataType.simpleString()
    names = ["slide_id", "level", "ti", "tj", "height", "width", "channels", "image", "held"]

    def rows(slide, tiles: dict, slide_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for up in range(1, depth + 1):
            tiles = _above(tiles, size)
            own = [(slide, level + up, i, j, *t.shape, t.tobytes(), None if has.all() else has.tobytes()) for (i, j), (t, has) in tiles.items()]
            types = [slide_type, *[pa.int32()] * 6, pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*own, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tiles, slide_type = None, {}, None
        for batch in batches:
            slide_type = batch.schema.field("slide_id").type
            for r in batch.to_pylist():
                if (r["slide_id"], r["_root"]) != at and tiles:
                    yield from rows(at[0], tiles, slide_type)
                    tiles = {}
                at = r["slide_id"], r["_root"]
                shape = r["height"], r["width"]
                has = np.ones(shape, bool) if r["held"] is None else np.frombuffer(r["held"], bool).reshape(shape)
                tiles[r["ti"], r["tj"]] = np.frombuffer(r["image"], np.uint8).reshape(*shape, r["channels"]), has
        if tiles:
            yield from rows(at[0], tiles, slide_type)

    dealt = base.withColumn("_root", F.shiftright("z", 2 * depth)).select("slide_id", "_root", "ti", "tj", "height", "width", "channels", "image", "held", "z")
    sorted_ = dealt.repartition("slide_id", "_root").sortWithinPartitions("slide_id", "_root", "z").drop("z")
    found = sorted_.mapInArrow(run, f"slide_id {kind}, level int, ti int, tj int, height int, width int, channels int, image binary, held binary")
    return found.withColumn("z", curve(F.col("ti"), F.col("tj"))).select(*COLUMNS)


def levels(tiles: DataFrame, count: int, depth: int = DEPTH, size: tuple[int, int] | None = None) -> DataFrame:
    """The tiles of level 0, (slide_id, ti, tj, height, width, channels, image), and of ``count`` levels above.

    Tiles of a row have the same height, those of a column the same width, and all but the last ones an
    even number of pixels at every level but the highest. Levels beyond the one with a single tile go on
    halving it. Each pass over ``depth`` levels shuffles only the highest level so far.

    Tiles may be missing, if all whole ones have the height and width ``size``. Without it each row and column
    of tiles before the last ones needs a tile in every quad that it goes through, and each quad its first tile.
    """
    if depth < 1:
        raise ValueError("a pass rolls up one level at least")
    base = tiles.withColumns({"level": F.lit(0), "z": curve(F.col("ti"), F.col("tj")), "held": F.lit(None).cast("binary")}).select(*COLUMNS)
    out, done = [base], 0
    while done < count:
        some = min(depth, count - done)
        above = cut(_rolled(base, done, some, size))
        done += some
        out.append(above)
        base = above.filter(F.col("level") == done)
    return reduce(DataFrame.unionByName, out)


def write(pyramid: DataFrame, path: str, row_group_bytes: int = 8 << 20, mode: str = "errorifexists") -> None:
    """Tiles in the order of slide, level and curve, in row groups of about ``row_group_bytes``."""
    order = ["slide_id", "level", "z"]
    pyramid.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("parquet.block.size", row_group_bytes).parquet(path)


def ranges(top: int, left: int, bottom: int, right: int, most: int = 32) -> list[tuple[int, int]]:
    """Ranges of the curve that hold all tiles from (top, left) to (bottom, right), both inclusive.

    Quads that lie in the region are one range each, those that overlap it are looked into; once there
    are ``most`` ranges, the ones with the least between them become one.
    """
    if top > bottom or left > right:
        return []
    out: list[list[int]] = []
    bits = max(1, max(bottom, right).bit_length())
    queue = [(0, 0, bits)]
    while queue:
        i, j, k = queue.pop()
        size = 1 << k
        if i > bottom or j > right or i + size <= top or j + size <= left:
            continue
        if (top <= i and i + size - 1 <= bottom and left <= j and j + size - 1 <= right) or k == 0:
            z = sum(((i >> b & 1) << (2 * b + 1)) | ((j >> b & 1) << (2 * b)) for b in range(bits))
            if out and out[-1][1] + 1 == z:
                out[-1][1] = z + size * size - 1
            else:
                out.append([z, z + size * size - 1])
            continue
        half = size // 2
        # The last pushed comes first: quads in the order of the curve.
        queue += [(i + a * half, j + b * half, k - 1) for a, b in ((1, 1), (1, 0), (0, 1), (0, 0))]
    while len(out) > most:
        at = min(range(len(out) - 1), key=lambda n: out[n + 1][0] - out[n][1])
        out[at : at + 2] = [[out[at][0], out[at + 1][1]]]
    return [tuple(r) for r in out]


def region(spark: SparkSession, path: str, slide, level: int, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """The tiles (ti from ``top`` to ``bottom``, tj from ``left`` to ``right``) of a stored pyramid; other row groups are skipped."""
    found = spark.read.parquet(path).filter((F.col("slide_id") == slide) & (F.col("level") == level))
    on_curve = reduce(lambda a, b: a | b, (F.col("z").between(*r) for r in ranges(top, left, bottom, right)), F.lit(False))
    return found.filter(on_curve).filter(F.col("ti").between(top, bottom) & F.col("tj").between(left, right))
