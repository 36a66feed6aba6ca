"""Pyramids against numpy, and TIFF files of many kinds written here by hand."""

import struct
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesselon.operators import pyramid
from tesselon.plans import catalog
from tesselon.sources import images, tiff


def halved(image):
    h, w, c = image.shape
    out = np.zeros(((h + 1) // 2, (w + 1) // 2, c), np.uint8)
    for i, j, k in np.ndindex(out.shape):
        own = image[2 * i : 2 * i + 2, 2 * j : 2 * j + 2, k].astype(int)
        out[i, j, k] = (2 * own.sum() + own.size) // (2 * own.size)
    return out


def tiled(spark, slides, size):
    rows = []
    for name, image in slides.items():
        for i in range(0, image.shape[0], size):
            for j in range(0, image.shape[1], size):
                part = image[i : i + size, j : j + size]
                rows.append((name, i // size, j // size, *part.shape, bytearray(part.tobytes())))
    return spark.createDataFrame(rows, "slide_id string, ti int, tj int, height int, width int, channels int, image binary")


def together(rows):
    rows = sorted(rows, key=lambda r: (r["ti"], r["tj"]))
    arrays = {}
    for r in rows:
        arrays.setdefault(r["ti"], []).append(np.frombuffer(r["image"], np.uint8).reshape(r["height"], r["width"], r["channels"]))
    return np.concatenate([np.concatenate(line, axis=1) for line in arrays.values()])


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_levels_equal_halving_the_whole(spark, depth):
    rng = np.random.default_rng(depth)
    slides = {"a": rng.integers(0, 256, (53, 70, 3)), "b": rng.integers(0, 256, (16, 16, 1)), "c": rng.integers(0, 256, (5, 90, 2))}
    found = pyramid.levels(tiled(spark, {k: v.astype(np.uint8) for k, v in slides.items()}, 16), 4, depth).collect()
    for name, image in slides.items():
        image = image.astype(np.uint8)
        for level in range(5):
            own = [r for r in found if r["slide_id"] == name and r["level"] == level]
            assert np.array_equal(together(own), image), (name, level)
            image = halved(image)


@pytest.mark.parametrize("depth", [1, 3])
def test_missing_tiles_are_no_pixels(spark, depth):
    rng = np.random.default_rng(9)
    image, tiles = rng.integers(0, 256, (29, 32)), {}
    gone = {"last": [(1, 3), (3, 1), (3, 2), (3, 3)], "first": [(0, 0), (2, 2), (2, 3)], "lines": [*((1, j) for j in range(4)), *((i, 2) for i in range(4)), (0, 0), (0, 1)]}
    rows, expected = [], set()
    for name, holes in gone.items():
        for i, j in [(i, j) for i in range(4) for j in range(4) if (i, j) not in holes]:
            part = image[8 * i : 8 * i + 8, 8 * j : 8 * j + 8].astype(np.uint8)
            rows.append((name, i, j, *part.shape, 1, bytearray(part.tobytes())))
            tiles.update({(name, 8 * i + y, 8 * j + x): int(v) for (y, x), v in np.ndenumerate(part)})
    for level in range(4):
        expected |= {(name, level, y, x, v) for (name, y, x), v in tiles.items()}
        below = {}
        for (name, y, x), v in tiles.items():
            below.setdefault((name, y // 2, x // 2), []).append(v)
        tiles = {at: (2 * sum(own) + len(own)) // (2 * len(own)) for at, own in below.items()}
    base = spark.createDataFrame(rows, "slide_id string, ti int, tj int, height int, width int, channels int, image binary")
    found = images.pixels(pyramid.levels(base, 3, depth, (8, 8)), ("slide_id", "level", "ti", "tj")).selectExpr("slide_id", "level", "ti * 8 + i", "tj * 8 + j", "v").collect()
    assert len(found) == len(expected) and set(map(tuple, found)) == expected
    # A hole beside tiles that say where it is needs no size.
    alone = images.pixels(pyramid.levels(base.filter("slide_id = 'last'"), 3, depth), ("slide_id", "level", "ti", "tj")).selectExpr("slide_id", "level", "ti * 8 + i", "tj * 8 + j", "v").collect()
    assert set(map(tuple, alone)) == {r for r in expected if r[0] == "last"}


@pytest.mark.parametrize("first,last", [(0, 22), (5, 30)])
def test_the_query_over_slides_with_holes_equals_its_sql(spark, tmp_path, first, last):
    rng = np.random.default_rng(first)
    rows = [(n, [float(x) for x in rng.uniform(-1, 1, 64)]) for n in range(first, last)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    expected = sorted(con.execute(catalog.ORACLE_SQL["pyramid_levels"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["pyramid_levels"](spark, str(tmp_path)).collect())) == expected


def test_the_curve_and_its_ranges(spark):
    z = {(r["i"], r["j"]): r["z"] for r in spark.range(64).selectExpr("cast(id div 8 AS int) AS i", "cast(id % 8 AS int) AS j").withColumn("z", pyramid.curve(F.col("i"), F.col("j"))).collect()}
    assert sorted(z.values()) == list(range(64)) and z[1, 0] == 2 and z[0, 1] == 1 and z[7, 7] == 63
    far = spark.range(1).select(pyramid.curve(F.lit(2**31 - 1), F.lit(0)).alias("z")).first()["z"]
    assert far == sum(1 << (2 * b + 1) for b in range(31))
    for box in ((0, 0, 7, 7), (1, 2, 4, 6), (3, 3, 3, 3), (0, 5, 7, 5), (2, 0, 1, 7)):
        inside = {v for (i, j), v in z.items() if box[0] <= i <= box[2] and box[1] <= j <= box[3]}
        exact = pyramid.ranges(*box, most=1000)
        assert {n for a, b in exact for n in range(a, b + 1) if n < 64} == inside
        few = pyramid.ranges(*box, most=2)
        assert len(few) <= 2 and inside <= {n for a, b in few for n in range(a, b + 1)}


def test_a_region_reads_a_part_of_the_row_groups(spark, tmp_path):
    path = str(tmp_path / "pyramid")
    tiles = spark.range(4096).selectExpr("'s' AS slide_id", "cast(id div 64 AS int) AS ti", "cast(id % 64 AS int) AS tj", "8 AS height", "8 AS width", "3 AS channels").withColumn("image", F.expr("cast(repeat(substring(md5(cast(ti * 64 + tj AS string)), 1, 4), 48) AS binary)"))
    pyramid.write(pyramid.levels(tiles, 2), path, 4096)
    got = pyramid.region(spark, path, "s", 0, 8, 16, 15, 23)
    assert sorted((r["ti"], r["tj"]) for r in got.collect()) == [(i, j) for i in range(8, 16) for j in range(16, 24)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    assert "GreaterThanOrEqual(z," in pyramid.region(spark, path, "s", 0, 8, 16, 15, 23)._jdf.queryExecution().toString().split("PushedFilters: [")[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    (low, high), total, met = pyramid.ranges(8, 16, 15, 23)[0], 0, 0
    for f in (tmp_path / "pyramid").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(c).name: c for c in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            stats = {n: meta.row_group(g).column(at[n]).statistics for n in ("z", "level")}
            total += 1
            met += stats["z"].min <= high and stats["z"].max >= low and stats["level"].min <= 0 <= stats["level"].max
    assert total > 8 and met <= total / 4, (met, total)


def packbits(raw):
    """Runs of three and more as runs, the rest as it is, and a byte that does nothing."""
    out, at = bytearray([128]), 0
    while at < len(raw):
        run = 1
        while at + run < len(raw) and run < 128 and raw[at + run] == raw[at]:
            run += 1
        if run > 2:
            out += bytes([257 - run, raw[at]])
        else:
            run = min(5, len(raw) - at)
            out += bytes([run - 1]) + raw[at : at + run]
        at += run
    return bytes(out)


def write_tiff(pages, order="<", big=False):
    """Pages are (image, how): how may name compression, predictor, tile, rows and planar."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HHQ", 8, 0, 16) if big else struct.pack(order + "I", 8)))
    link = 8 if big else 4
    for image, how in pages:
        compression, predictor, planar = how.get("compression", 1), how.get("predictor", 1), how.get("planar", 1)
        h, w, c = image.shape
        high, wide = how.get("tile", (how.get("rows", h), w))
        places, sizes = [], []
        for plane in [image[:, :, k : k + 1] for k in range(c)] if planar == 2 else [image]:
            for i in range(0, h, high):
                for j in range(0, w, wide):
                    part = plane[i : i + high, j : j + wide]
                    if "tile" in how:
                        part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.concatenate([part[:, :1], np.diff(part.astype(np.int64), axis=1).astype(part.dtype)], axis=1)
                    raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                    raw = {8: zlib.compress, 32946: zlib.compress, 32773: packbits}.get(compression, bytes)(raw)
                    places.append(len(out))
                    sizes.append(len(raw))
                    out += raw
        form = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
        tags = {256: [w], 257: [h], 258: [image.dtype.itemsize * 8] * c, 259: [compression], 277: [c], 284: [planar], 317: [predictor], 339: [form] * c}
        tags |= {322: [wide], 323: [high], 324: places, 325: sizes} if "tile" in how else {273: places, 278: [high], 279: sizes}
        entries, code, size = [], ("Q", 8) if big else ("I", 4), 8 if big else 4
        for tag, values in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{code[0]}", *values)
            if len(raw) > size:
                at = len(out)
                out += raw
                raw = struct.pack(order + code[0], at)
            entries.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, 16 if big else 4, len(values)) + raw)
        struct.pack_into(order + code[0], out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + code[0], 0)
    return bytes(out)


def kinds(rng):
    pick = lambda kind, *shape: (rng.integers(0, 200, shape) // 40).astype(kind) if kind[0] != "f" else rng.random(shape).astype(kind)
    yield [(pick("uint8", 11, 13, 3), {"rows": 4})], "<", False
    yield [(pick("uint16", 20, 33, 1), {"tile": (16, 16), "compression": 8, "predictor": 2}), (pick("uint8", 7, 5, 3), {"compression": 32773, "rows": 3})], ">", False
    yield [(pick("int32", 9, 9, 2), {"planar": 2, "compression": 32946}), (pick("float64", 6, 4, 1), {}), (pick("float32", 18, 18, 2), {"tile": (16, 32)})], "<", True
    yield [(pick("int16", 33, 17, 4), {"tile": (16, 16), "compression": 32773, "predictor": 2})], ">", True


def test_files_of_many_kinds_come_back(spark, tmp_path):
    written = {}
    for k, (pages, order, big) in enumerate(kinds(np.random.default_rng(3))):
        (tmp_path / f"{k}.tif").write_bytes(write_tiff(pages, order, big))
        written |= {(f"{k}.tif", n): image for n, (image, _) in enumerate(pages)}
    (tmp_path / "text.tif").write_bytes(b"no image")
    rows = tiff.tiles(images.files(spark, str(tmp_path), "*.tif")).collect()
    assert all(r["problem"] is None for r in rows)
    found = {}
    for r in rows:
        name = r["path"].rsplit("/", 1)[1], r["page"]
        image = written[name]
        own = found.setdefault(name, np.zeros_like(image))
        part = np.frombuffer(r["image"], r["dtype"]).reshape(r["height"], r["width"], r["channels"])
        own[r["i"] : r["i"] + r["height"], r["j"] : r["j"] + r["width"], r["plane"] : r["plane"] + r["channels"]] = part
        assert r["dtype"] == image.dtype.name
    assert found.keys() == written.keys() and all(np.array_equal(found[k], written[k]) for k in written)


def test_what_cannot_be_read_is_told(spark, tmp_path):
    image = np.arange(64, dtype=np.uint8).reshape(8, 8, 1)
    lzw = write_tiff([(image, {"compression": 5}), (image, {})])
    short = bytearray(write_tiff([(image, {"rows": 4, "compression": 8})]))
    short[8:12] = b"\xff" * 4
    ring = bytearray(write_tiff([(image, {})]))
    ring[-4:] = ring[4:8]
    for name, raw in (("lzw", lzw), ("short", bytes(short)), ("cut", lzw[:20]), ("ring", bytes(ring)), ("none", b"II*\0" + bytes(4))):
        (tmp_path / f"{name}.tif").write_bytes(raw)
    found = {}
    for r in tiff.tiles(images.files(spark, str(tmp_path), "*.tif")).collect():
        found.setdefault(r["path"].rsplit("/", 1)[1][:-4], []).append((r["page"], r["problem"]))
    assert sorted(found["lzw"]) == [(0, "compression 5"), (1, None)]
    assert len(found["short"]) == 2 and sum(p is None for _, p in found["short"]) == 1
    assert found["cut"] == [(0, "damaged directory")] and found["ring"] == [(0, None)] and "none" not in found
    walked = tiff.parts(images.files(spark, str(tmp_path), "lzw.tif")).orderBy("page").collect()
    assert [(r["page"], r["part"], r["height"], r["problem"]) for r in walked] == [(0, None, None, "compression 5"), (1, 0, 8, None)]
