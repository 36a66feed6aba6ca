"""Tile grids over slides, frame indices, regions, thumbnails and slide masks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File suffixes and the reader that each is given to, first match wins (fixed values).
BACKENDS = {
    "h5path": ".h5 .h5path",
    "bioformats": """
        .1sc .2fl .acff .afi .afm .aim .al3d .ali .am .amiramesh .apl .arf .avi .bif .bin .bip .bmp .c01 .cfg .ch5 .cif .cr2 .crw .cxd .czi .dat .db
        .dib .dm2 .dm3 .dm4 .dti .dv .eps .epsi .exp .fdf .fff .ffr .fits .fli .frm .gel .grey .hdr .hed .his .htd .hx .i2i .ics .ids .im3 .img .ims
        .inr .ipl .ipm .ipw .j2k .jp2 .jpf .jpk .jpx .klb .l2d .labels .lei .lif .liff .lim .lms .lsm .map .mdb .mnc .mng .mod .mov .mrc .mrcs .mrw
        .msr .mtb .mvd2 .naf .nd .nef .nhdr .nii .nii.gz .nrrd .obf .obsep .oib .oif .oir .ome .ome.btf .ome.tf2 .ome.tf8 .ome.tif .ome.tiff
        .ome.xml .par .pbm .pcoraw .pcx .pds .pgm .pic .pict .png .pnl .ppm .pr3 .ps .psd .qptiff .r3d .raw .rcpnl .rec .scn .sdt .seq .sif .sld
        .sm2 .sm3 .spc .spe .spi .st .stk .stp .sxm .tfr .tga .tif .tiff .tnb .top .vff .vsi .vws .wat .wlz .wpi .xdce .xml .xqd .xqf .xv .xys .zfp
        .zfr .zvi
    """,
    "openslide": ".bif .mrxs .ndpi .scn .svs .svslide .tif .tiff .vms .vmu",
    "dicom": ".dcm .dicom",
}


def infer_backend(path: Column, backends: dict[str, str] = BACKENDS) -> Column:
    """The reader of a file by its suffix, case-sensitive; null where none fits."""
    out = F.lit(None).cast("string")
    for name, suffixes in reversed(backends.items()):
        out = F.when(path.rlike(f"(?:{'|'.join(map(re.escape, suffixes.split()))})\\z"), F.lit(name)).otherwise(out)
    return out


def steps(size: Column, shape: int, stride: int, pad: bool) -> Column:
    """How many tiles of ``shape`` a side of ``size`` gets; with ``pad`` a rest gets a tile of its own."""
    full = F.floor((size - shape) / stride) + 1
    if pad:
        full = F.when(size % stride != 0, F.floor(size / stride) + 1).otherwise(full)
    return F.greatest(full, F.lit(0)).cast("int")


def tile_grid(slides: DataFrame, shape: tuple[int, int], stride: tuple[int, int] | None = None, pad: bool = False, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """One row a tile: the slides' columns with tile_i and tile_j, row by row.

    ``box`` (top, left, bottom, right) bounds the tiles' corners; the bounds go into the sequences, so
    tiles outside it are never made.
    """
    stride = stride or shape
    top, left, bottom, right = box or (0, 0, None, None)

    def corners(size: str, k: int, low: int, high: int | None) -> Column:
        n = steps(F.col(size), shape[k], stride[k], pad)
        first = -(-low // stride[k])
        last = n - 1 if high is None else F.least(n - 1, F.lit((high - 1) // stride[k]))
        indices = F.when(last >= first, F.sequence(F.lit(first), last.cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.explode(F.transform(indices, lambda x: x * stride[k]))

    return slides.withColumn("tile_i", corners("height", 0, top, bottom)).withColumn("tile_j", corners("width", 1, left, right))


def frame_coords(index: Column, columns: Column, height: int, width: int) -> tuple[Column, Column]:
    """Top-left corner of a frame by its index in row-major order."""
    return (F.floor(index / columns) * height).cast("long"), (F.pmod(index, columns) * width).cast("long")


def frame_index(i: Column, j: Column, columns: Column, height: int, width: int) -> Column:
    """The index of the frame with this corner; null if no frame begins there."""
    return F.when((i % height == 0) & (j % width == 0), F.floor(i / height).cast("long") * columns + F.floor(j / width).cast("long"))


def region(pixels: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """The pixels of a box, with coordinates relative to it."""
    inside = pixels.filter((F.col("i") >= top) & (F.col("i") < top + height) & (F.col("j") >= left) & (F.col("j") < left + width))
    return inside.withColumn("i", F.col("i") - top).withColumn("j", F.col("j") - left)


def thumbnail(pixels: DataFrame, factor: int, keys: tuple[str, ...], value: str = "v") -> DataFrame:
    """Mean value of each block of ``factor`` by ``factor`` pixels."""
    small = pixels.withColumn("i", F.floor(F.col("i") / factor).cast("int")).withColumn("j", F.floor(F.col("j") / factor).cast("int"))
    return small.groupBy(*keys, "i", "j").agg(F.avg(value).alias(value))


def slice_masks(tiles: DataFrame, masks: DataFrame, shape: tuple[int, int], key: str = "slide_id") -> DataFrame:
    """Tiles with the mask rectangles (top, left, bottom, right) that they overlap, cut to the tile.

    A range join as an equi-join: tiles and rectangles meet in the cells of a lattice as wide as a
    tile. A pair that shares several cells is kept only in the first of them. Tiles of any place may be
    given; for those of a grid ``grid_masks`` needs none. Neither side is broadcast: both are made by
    sequences, which the estimate of their size does not see.
    """
    h, w = shape

    def cells(df: DataFrame, top: Column, left: Column, bottom: Column, right: Column) -> DataFrame:
        span = lambda a, b, n: F.explode(F.sequence(F.floor(a / n).cast("int"), F.floor((b - 1) / n).cast("int")))
        return df.withColumn("_ci", span(top, bottom, h)).withColumn("_cj", span(left, right, w))

    t = cells(tiles, F.col("tile_i"), F.col("tile_j"), F.col("tile_i") + h, F.col("tile_j") + w)
    m = cells(masks.filter("bottom > top AND right > left"), F.col("top"), F.col("left"), F.col("bottom"), F.col("right"))
    both = t.hint("merge").join(m, [key, "_ci", "_cj"])
    top, left = F.greatest("tile_i", "top"), F.greatest("tile_j", "left")
    bottom, right = F.least(F.col("tile_i") + h, F.col("bottom")), F.least(F.col("tile_j") + w, F.col("right"))
    hit = both.filter((bottom > top) & (right > left) & (F.col("_ci") == F.floor(top / h)) & (F.col("_cj") == F.floor(left / w)))
    return hit.withColumn("rows", bottom - top).withColumn("columns", right - left).drop("_ci", "_cj")


def _met(slides: DataFrame, masks: DataFrame, shape: tuple[int, int], stride: tuple[int, int] | None, pad: bool, key: str) -> DataFrame:
    """(slides' columns, _m, tile_i, tile_j): the tiles of a grid that each rectangle ``_m`` meets; a null ``_m`` meets all.

    Slides and rectangles are dealt by slide, and the places follow from the numbers of both, so no tile
    is shuffled or broadcast.
    """
    stride = stride or shape

    def corners(size: str, k: int, low: str, high: str) -> Column:
        n = steps(F.col(size), shape[k], stride[k], pad)
        first = F.greatest(F.lit(0), F.floor((F.col(f"_m.{low}") - shape[k]) / stride[k]) + 1)
        last = F.least(n - 1, F.floor((F.col(f"_m.{high}") - 1) / stride[k]))
        first, last = F.coalesce(first, F.lit(0)).cast("int"), F.when(F.col("_m").isNull(), n - 1).otherwise(last).cast("int")
        indices = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.explode(F.transform(indices, lambda x: x * stride[k]))

    both = slides.hint("merge").join(masks, key)
    return both.withColumn("tile_i", corners("height", 0, "top", "bottom")).withColumn("tile_j", corners("width", 1, "left", "right"))


def _cut(shape: tuple[int, int]) -> tuple[Column, Column]:
    """Rows and columns of a rectangle ``_m`` within its tile."""
    h, w = shape
    rows = F.least(F.col("tile_i") + h, F.col("_m.bottom")) - F.greatest("tile_i", "_m.top")
    return rows, F.least(F.col("tile_j") + w, F.col("_m.right")) - F.greatest("tile_j", "_m.left")


def grid_masks(slides: DataFrame, masks: DataFrame, shape: tuple[int, int], stride: tuple[int, int] | None = None, pad: bool = False, key: str = "slide_id") -> DataFrame:
    """(key, tile_i, tile_j, masks' columns, rows, columns): ``slice_masks`` for the tiles of ``tile_grid``."""
    own = masks.filter("bottom > top AND right > left")
    rest = [c for c in masks.columns if c != key]
    found = _met(slides.select(key, "height", "width"), own.select(key, F.struct(*rest).alias("_m")), shape, stride, pad, key)
    rows, columns = _cut(shape)
    return found.select(key, "tile_i", "tile_j", "_m.*", rows.alias("rows"), columns.alias("columns"))


def tiles_with_masks(slides: DataFrame, masks: DataFrame, shape: tuple[int, int], stride: tuple[int, int] | None = None, pad: bool = False, key: str = "slide_id") -> DataFrame:
    """(slides' columns, tile_i, tile_j, masks): the tiles of all slides with what they overlap of each mask, and their slide's labels.

    ``masks`` are rectangles (key, name, top, left, bottom, right). A tile's ``masks`` are structs (name,
    top, left, rows, columns), in the tile's own frame and in the order of names and places; a tile
    without any has an empty array. Labels and other columns of ``slides`` are inherited; a slide given
    twice with the same columns counts once.

    Each slide comes among its rectangles as a null one, which meets all tiles. What tiles hold is then
    collected where the slide already is, without another shuffle.
    """
    columns, slides = slides.columns, slides.distinct()
    rectangle = F.struct("name", "top", "left", "bottom", "right")
    own = masks.filter("bottom > top AND right > left").select(key, rectangle.alias("_m"))
    kind = own.schema["_m"].dataType
    found = _met(slides, own.unionAll(slides.select(key).distinct().withColumn("_m", F.lit(None).cast(kind))), shape, stride, pad, key)
    rows, columns_held = _cut(shape)
    held = F.struct(
        F.col("_m.name").alias("name"),
        F.greatest(F.col("_m.top") - F.col("tile_i"), F.lit(0)).alias("top"),
        F.greatest(F.col("_m.left") - F.col("tile_j"), F.lit(0)).alias("left"),
        rows.alias("rows"),
        columns_held.alias("columns"),
    )
    collected = F.array_sort(F.collect_list(F.when(F.col("_m").isNotNull(), held))).alias("masks")
    out = found.groupBy(*columns, "tile_i", "tile_j").agg(collected)
    nameless = tile_grid(slides.filter(F.col(key).isNull()), shape, stride, pad)
    return out.unionAll(nameless.withColumn("masks", F.array().cast(out.schema["masks"].dataType)))


def uniform_tiles(tiles: DataFrame, key: str = "slide_id") -> DataFrame:
    """Slides whose tiles differ in height, width or slide type; none if the store is sound."""
    return tiles.groupBy(key).agg(F.countDistinct("height", "width").alias("shapes"), F.countDistinct("slide_type").alias("types")).filter("shapes > 1 OR types > 1")


def parse_file_size(size: Column) -> Column:
    """Bytes of a size such as "1.5 MB" in decimal units; null for an unknown unit."""
    number, unit = F.split(F.trim(size), r"\s+").getItem(0), F.upper(F.split(F.trim(size), r"\s+").getItem(1))
    factor = F.lit(None).cast("double")
    for k, name in enumerate(("B", "KB", "MB", "GB", "TB")):
        factor = F.when(unit == name, F.lit(1000.0**k)).otherwise(factor)
    return F.floor(F.try_multiply(number.try_cast("double"), factor)).cast("long")


def dicom_tiles(slides: DataFrame, height: int, width: int, pad: bool = False) -> DataFrame:
    """The slides' columns with frame, tile_i and tile_j: one row a frame of ``n_frames`` in ``n_cols`` columns.

    Frames may be filled up at the last row and column, so without ``pad`` those are left out, whether
    complete or not.
    """
    frames = slides.withColumn("frame", F.explode(F.when(F.col("n_frames") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1))))
    if not pad:
        frames = frames.filter((F.col("frame") % F.col("n_cols") < F.col("n_cols") - 1) & (F.col("frame") < F.col("n_frames") - F.col("n_cols")))
    i, j = frame_coords(F.col("frame"), F.col("n_cols"), height, width)
    return frames.withColumns({"tile_i": i, "tile_j": j})


def extract_tiles(pixels: DataFrame, keys: tuple[str, ...], size: int, stride: int | None = None) -> DataFrame:
    """Pixels (keys, tile_i, tile_j, i, j, ...) of all tiles of an image, i and j from the tile's corner.

    The tiles must fit exactly; an image where they do not is an error.
    """
    stride = stride or size
    rest = [c for c in pixels.columns if c not in (*keys, "i", "j")]
    sides = pixels.groupBy(*keys).agg(*((F.max(c) + 1).alias(f"_{c}") for c in "ij"))
    fits = F.lit(True)
    for c in "ij":
        fits = fits & (F.col(f"_{c}") >= size) & (F.pmod(F.col(f"_{c}") - size, F.lit(stride)) == 0)
    checked = sides.withColumn("_fits", F.when(fits, True).otherwise(F.raise_error(F.lit(f"tiles of {size} at a stride of {stride} do not fit exactly")).cast("boolean"))).filter("_fits")
    first = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride))
    last = lambda c: F.least(F.floor(F.col(c) / stride), F.floor((F.col(f"_{c}") - size) / stride))
    dealt = pixels.join(checked, list(keys))
    for c in "ij":
        dealt = dealt.withColumn(f"_n{c}", F.explode(F.when(last(c) >= first(c), F.sequence(first(c), last(c)))))
    corner = lambda c: (F.col(f"_n{c}") * stride).cast("int")
    return dealt.select(*keys, *(corner(c).alias(f"tile_{c}") for c in "ij"), *((F.col(c) - corner(c)).cast("int").alias(c) for c in "ij"), *rest)


def padded_tiles(pixels: DataFrame, keys: tuple[str, ...], size: int, value: str = "v") -> DataFrame:
    """Pixels (keys, tile_i, tile_j, i, j, value) of tiles side by side; what hangs over the edge is 0, of the same type."""
    corner = lambda c: (F.floor(F.col(c) / size) * size).cast("int")
    own = pixels.select(*keys, corner("i").alias("tile_i"), corner("j").alias("tile_j"), F.pmod("i", F.lit(size)).alias("i"), F.pmod("j", F.lit(size)).alias("j"), value)
    side = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    every = own.select(*keys, "tile_i", "tile_j").distinct().withColumn("i", side).withColumn("j", side)
    return every.join(own, [*keys, "tile_i", "tile_j", "i", "j"], "left").withColumn(value, F.coalesce(value, F.lit(0).cast(pixels.schema[value].dataType)))


def level_shape(height: Column, width: Column, downsample: Column) -> tuple[Column, Column]:
    """Height and width at a level of a pyramid, rounded down."""
    return F.floor(height / downsample).cast("int"), F.floor(width / downsample).cast("int")


def region_at_level(levels: DataFrame, downsamples: dict[int, float], location: tuple[int, int], size: tuple[int, int], level: int) -> DataFrame:
    """Pixels of one level whose place, in the frame of level 0, begins at ``location``; i and j from there.

    ``levels`` are pixels with a column ``level``. Places are scaled by the whole part of the level's
    downsample, as in the frame of level 0 a region begins at whole pixels of its level.
    """
    factor = int(downsamples[level])
    return region(levels.filter(F.col("level") == level).drop("level"), location[0] // factor, location[1] // factor, *size)


def thumbnail_of(pixels: DataFrame, keys: tuple[str, ...], size: tuple[int, int], height: int, width: int, value: str = "v") -> DataFrame:
    """(keys, i, j, value): an image of ``size``, each pixel the mean of those that fall on it."""
    at = lambda c, n, side: F.floor(F.col(c) * n / side).cast("int").alias(c)
    return pixels.groupBy(*keys, at("i", size[0], height), at("j", size[1], width)).agg(F.avg(value).alias(value))


#: Pixels of an image that graphs are built for, at least and at most (fixed values).
GRAPH_PIXELS = (50_000, 50_000_000)


def fit_for_graphs(slides: DataFrame, least: int = GRAPH_PIXELS[0], most: int = GRAPH_PIXELS[1]) -> DataFrame:
    """The slides whose area lies within the bounds."""
    return slides.filter((F.col("height").cast("long") * F.col("width")).between(least, most))


def require(tiles: DataFrame, column: str, allowed: str, what: str) -> DataFrame:
    """``tiles`` as they are; one whose ``column`` is not ``allowed`` is an error that names ``what``."""
    message = F.concat(F.lit(f"{what} needs {column} {allowed}, not "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    good = F.when(F.col(column) == allowed, True).otherwise(F.raise_error(message).cast("boolean"))
    return tiles.filter(good)
