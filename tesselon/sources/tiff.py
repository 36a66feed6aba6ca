"""TIFF and BigTIFF files as tables: all pages, strips or tiles, one row for each, decoded where they lie.

The directories are walked where a file is read; each strip or tile becomes a row with its own bytes of the
file, still compressed. Those rows are dealt over the cluster and only then decoded. Compressed kinds are none, PackBits and deflate, with
or without horizontal differences; pixels are whole numbers of 8, 16 or 32 bits or numbers of 32 or 64.
What is of another kind is given out as such, with what it is.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.sources.images import is_tiff

# Tags, and sizes and codes of the kinds of their values (fixed values of the format).
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _CHANNELS, _ROWS, _STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
_PLANAR, _PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _FORMAT = 284, 317, 322, 323, 324, 325, 339
_KINDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 8, 32946, 32773
#: Pages of a file and numbers of one tag at most, so that a damaged file ends.
MOST_PAGES, MOST_VALUES = 100_000, 1 << 24
#: Bytes and rows that are given on at a time.
STEP_BYTES, STEP_ROWS = 16 << 20, 10_000
_PART = "page int, part int, ti int, tj int, i int, j int, height int, width int, channels int, plane int, stored_height int, stored_width int, dtype string, compression int, predictor int, at long, size long, problem string"
_FIELDS = [c.split()[0] for c in _PART.split(", ")]


class _Reader:
    def __init__(self, raw: memoryview):
        self.raw = raw
        self.order = "<" if raw[:2] == b"II" else ">"
        (version,) = self._read("H", 2)
        self.big = version == 43
        self.first = self._read("Q", 8)[0] if self.big else self._read("I", 4)[0]

    def _read(self, code: str, at: int) -> tuple:
        return struct.unpack_from(self.order + code, self.raw, at)

    def pages(self) -> Iterator[dict[int, tuple]]:
        """The tags of each directory of the chain; a chain that comes back to itself ends there."""
        at, seen = self.first, set()
        head, entry, inline = ("Q", 20, 8) if self.big else ("H", 12, 4)
        while at and at not in seen and len(seen) < MOST_PAGES:
            seen.add(at)
            (n,), start = self._read(head, at), at + struct.calcsize("<" + head)
            tags = {}
            for k in range(n):
                place = start + entry * k
                tag, kind, count = self._read("HHQ" if self.big else "HHI", place)
                code = _KINDS.get(kind)
                if code is None or count > MOST_VALUES:
                    continue
                size, value = struct.calcsize("<" + code) * count, place + entry - inline
                if size > inline:
                    (value,) = self._read("Q" if self.big else "I", value)
                tags[tag] = self._read(f"{count}{code}", value)
            yield tags
            (at,) = self._read("Q" if self.big else "I", start + entry * n)


def _kind(tags: dict[int, tuple]) -> tuple[str, str | None]:
    """numpy's name of a pixel's kind, and what cannot be read."""
    bits, form = set(tags.get(_BITS, (1,))), set(tags.get(_FORMAT, (1,)))
    names = {(8, 1): "uint8", (16, 1): "uint16", (32, 1): "uint32", (8, 2): "int8", (16, 2): "int16", (32, 2): "int32", (32, 3): "float32", (64, 3): "float64"}
    name = names.get((*bits, *form)) if len(bits) == len(form) == 1 else None
    compression, predictor = tags.get(_COMPRESSION, (NONE,))[0], tags.get(_PREDICTOR, (1,))[0]
    if name is None:
        return "", f"pixels of {sorted(bits)} bits, format {sorted(form)}"
    if compression not in (NONE, DEFLATE, OLD_DEFLATE, PACKBITS):
        return name, f"compression {compression}"
    if predictor not in (1, 2) or (predictor == 2 and name.startswith("float")):
        return name, f"predictor {predictor}"
    return name, None


def _page(page: int, tags: dict[int, tuple], order: str) -> Iterator[tuple]:
    """A row for each strip or tile of a page, or one that says why there are none."""
    none = [None] * len(_FIELDS)
    missing = [str(t) for t in (_WIDTH, _HEIGHT) if t not in tags]
    tiled = _TILES in tags
    places, sizes = tags.get(_TILES if tiled else _STRIPS), tags.get(_TILE_BYTES if tiled else _STRIP_BYTES)
    dtype, problem = _kind(tags)
    if missing or places is None or sizes is None or len(places) != len(sizes):
        problem = "no size" if missing else "no strips or tiles"
    if problem:
        yield (page, *none[1:-1], problem)
        return
    width, height, channels = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_CHANNELS, (1,))[0]
    planes = channels if tags.get(_PLANAR, (1,))[0] == 2 else 1
    wide, high = (tags[_TILE_WIDTH][0], tags[_TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(_ROWS, (height,))[0]))
    if min(width, height, wide, high) < 1:
        yield (page, *none[1:-1], "no pixels")
        return
    across, down = -(-width // wide), -(-height // high)
    if len(places) < across * down * planes:
        yield (page, *none[1:-1], "too few strips or tiles")
        return
    name = order + np.dtype(dtype).str[1:]
    for part in range(across * down * planes):
        plane, (ti, tj) = part // (across * down), divmod(part % (across * down), across)
        i, j = ti * high, tj * wide
        stored = high if tiled else min(high, height - i)
        yield page, part, ti, tj, i, j, min(high, height - i), min(wide, width - j), channels // planes, plane, stored, wide, name, tags.get(_COMPRESSION, (NONE,))[0], tags.get(_PREDICTOR, (1,))[0], places[part], sizes[part], None


def parts(found: DataFrame) -> DataFrame:
    """(path, page, part, ti, tj, i, j, height, width, channels, plane, ..., at, size, problem) of the TIFF files (path, content).

    One row a strip or tile: where it lies in its page and in the file. Pages that cannot be read have one
    row with a ``problem``, as have files whose directories are damaged.
    """

    return _walked(found, False)


def _rows_of(path: str, raw: bytes) -> Iterator[tuple]:
    page = 0
    try:
        reader = _Reader(raw)
        for page, tags in enumerate(reader.pages()):
            for row in _page(page, tags, reader.order):
                yield path, *row
    except (struct.error, OverflowError, MemoryError):
        yield path, page, *[None] * (len(_FIELDS) - 2), "damaged directory"


def _walked(found: DataFrame, with_bytes: bool) -> DataFrame:
    """The rows of ``parts``; ``with_bytes`` each with its bytes of the file in ``raw``."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    types = [pa.string(), *(kinds[c.split()[1]] for c in _PART.split(", ")), *[pa.binary()] * with_bytes]
    names, at = ["path", *_FIELDS, *["raw"] * with_bytes], _FIELDS.index("at") + 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw, rows, held = memoryview(content.as_buffer()), [], 0
                for row in _rows_of(path, raw):
                    own = ()
                    if with_bytes:
                        own = (None if row[at] is None else bytes(raw[row[at] : row[at] + row[at + 1]]),)
                        held += len(own[0] or b"")
                    rows.append((*row, *own))
                    if held > STEP_BYTES or len(rows) >= STEP_ROWS:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return found.filter(is_tiff(F.col("content"))).select("path", "content").mapInArrow(run, f"path string, {_PART}{', raw binary' * with_bytes}")


def unpacked(raw: bytes) -> bytes:
    """PackBits: a count and that many bytes as they are, or one byte that is repeated."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def decoded(raw: bytes, r: dict[str, Any]) -> np.ndarray:
    """The pixels (height, width, channels) of a strip or tile; what is stored beyond the page's edge is left out."""
    data = {NONE: bytes, PACKBITS: unpacked}.get(r["compression"], zlib.decompress)(raw)
    shape, kind = (r["stored_height"], r["stored_width"], r["channels"]), np.dtype(r["dtype"])
    n = int(np.prod(shape))
    if len(data) < n * kind.itemsize:
        raise ValueError("fewer bytes than pixels")
    image = np.frombuffer(data, kind, n).reshape(shape)
    if r["predictor"] == 2:
        image = np.add.accumulate(image, axis=1, dtype=kind.newbyteorder("="))
    return np.ascontiguousarray(image[: r["height"], : r["width"]]).astype(kind.newbyteorder("<"))


def tiles(found: DataFrame) -> DataFrame:
    """(path, page, plane, ti, tj, i, j, height, width, channels, dtype, image, problem): the decoded strips and tiles of TIFF files.

    ``image`` holds little-endian numbers row by row. Damaged strips and tiles, and pages that cannot be
    read, have a ``problem`` and no image.
    """
    names = ["path", "page", "plane", "ti", "tj", "i", "j", "height", "width", "channels", "dtype", "image", "problem"]
    dealt = _walked(found, True).repartition("path", "page", "part")
    schema = "path string, page int, plane int, ti int, tj int, i int, j int, height int, width int, channels int, dtype string, image binary, problem string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, images, problems = [], [], []
            for r in batch.to_pylist():
                try:
                    image = None if r["problem"] else decoded(r["raw"], r)
                    own = (image.dtype.name, image.tobytes(), None) if image is not None else (None, None, r["problem"])
                except (ValueError, zlib.error) as e:
                    own = None, None, str(e) or "damaged"
                for held, value in zip((kinds, images, problems), own, strict=True):
                    held.append(value)
            yield pa.record_batch([*(batch.column(c) for c in names[:10]), pa.array(kinds, pa.string()), pa.array(images, pa.binary()), pa.array(problems, pa.string())], names)

    return dealt.mapInArrow(run, schema)
