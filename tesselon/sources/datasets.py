"""Data sets for models, as DataFrames: tiles, entity graphs, and the folds and files of published sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of each fold of the focus data set, first and last (fixed values): train, validation, test.
FOCUS_FOLDS = {1: (0, 163_199), 2: (163_200, 183_599), 3: (183_600, 203_999)}
FOCUS_ROWS = 204_000


def _strides(shape: Column, order: list[int]) -> list[Column]:
    """For axes in a new order, how far apart neighbours lie in the old flat array."""
    n = len(order)
    return [reduce(lambda a, k: a * k, (shape[k] for k in range(axis + 1, n)), F.lit(1)) for axis in order]


def channels_first(image: Column, shape: Column) -> tuple[Column, Column]:
    """A flat image and its shape with axes H, W, C as C, H, W, or X, Y, Z, C, T as T, C, Z, Y, X; another rank is an error."""

    def moved(order: list[int]) -> Column:
        sides, steps = [shape[k] for k in order], _strides(shape, order)

        def at(p: Column) -> Column:
            place, left = F.lit(0), p
            for side, step in zip(reversed(sides), reversed(steps), strict=True):
                place, left = place + left % side * step, F.floor(left / side).cast("int")
            return image[place.cast("int")]

        return F.transform(F.sequence(F.lit(0), F.size(image) - 1), at)

    wrong = F.raise_error(F.concat(F.lit("a tile has 3 or 5 axes, not "), F.size(shape).cast("string")))
    three, five = F.size(shape) == 3, F.size(shape) == 5
    return F.when(three, moved([2, 0, 1])).when(five, moved([4, 3, 2, 1, 0])).otherwise(wrong), F.when(three, F.array(shape[2], shape[0], shape[1])).when(five, F.reverse(shape))


def tile_dataset(tiles: DataFrame, slides: DataFrame, key: str = "slide_id") -> DataFrame:
    """(key, tile_i, tile_j, image, shape, masks, labels, slide_labels): one row a tile, channels first.

    ``tiles`` hold flat images with their shape, masks by name as flat arrays, and labels; masks are
    stacked in the order of their names, null where there are none.
    """
    image, shape = channels_first(F.col("image"), F.col("shape"))
    stacked = F.when(F.size("masks") > 0, F.transform(F.array_sort(F.map_keys("masks")), lambda k: F.col("masks")[k]))
    known = slides.select(key, F.map_filter("labels", lambda _, v: v.isNotNull()).alias("slide_labels"))
    return tiles.select(key, "tile_i", "tile_j", image.alias("image"), shape.alias("shape"), stacked.alias("masks"), "labels").join(known, key, "left")


def stem(path: Column) -> Column:
    """A file's name without its folders and its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def entity_dataset(cells: DataFrame | None = None, tissues: DataFrame | None = None, assignments: DataFrame | None = None) -> DataFrame:
    """(name, cell, tissue, assignment, target): graphs and assignments of the same image, joined by the stems of their files.

    Each table is (path, graph) or (path, graph, target); the tissue graph's target goes before the
    cell graph's, and of an assignment (a pair of rows) the second row stays. What is not given is null.
    """
    given = {"cell": cells, "tissue": tissues, "assignment": assignments}
    parts = []
    for kind, table in given.items():
        if table is not None:
            value = F.col("graph")[1] if kind == "assignment" else F.col("graph")
            target = F.col("target") if "target" in table.columns else F.lit(None).cast("string")
            parts.append(table.select(stem(F.col("path")).alias("name"), value.alias(kind), *([] if kind == "assignment" else [target.alias(f"_{kind}")])))
    joined = reduce(lambda a, b: a.join(b, "name"), parts)
    targets = [F.col(f"_{k}") for k in ("tissue", "cell") if given[k] is not None]
    columns = [F.col(k) if given[k] is not None else F.lit(None).alias(k) for k in given]
    return joined.select("name", *columns, (F.coalesce(*targets) if targets else F.lit(None).cast("string")).alias("target"))


def pannuke_files(folds: DataFrame) -> DataFrame:
    """(fold, k, tissue, image_file, mask_file): one file an image from batches (fold, types), a type for each image."""
    one = folds.select("fold", F.posexplode("types").alias("k", "type")).withColumn("tissue", F.regexp_replace("type", "_", "-"))
    name = F.concat_ws("_", F.concat(F.lit("fold"), F.col("fold")), "k", "tissue")
    return one.select("fold", "k", "tissue", F.concat(F.lit("images/"), name, F.lit(".png")).alias("image_file"), F.concat(F.lit("masks/"), name, F.lit(".npy")).alias("mask_file"))


# For each split the folds for training, validation and testing (fixed values of the data set's protocol).
PANNUKE_SPLITS = {1: (1, 2, 3), 2: (2, 1, 3), 3: (3, 2, 1)}
ROLES = ("train", "valid", "test")


def pannuke_split(files: DataFrame, split: int | None) -> DataFrame:
    """The files (fold, ...) with their ``role`` in a split; without one all are for training."""
    if split is None:
        return files.withColumn("role", F.lit(ROLES[0]))
    if split not in PANNUKE_SPLITS:
        raise ValueError(f"split {split}: there are {', '.join(map(str, PANNUKE_SPLITS))}")
    role = F.lit(None).cast("string")
    for fold, name in zip(PANNUKE_SPLITS[split], ROLES, strict=True):
        role = F.when(F.col("fold") == fold, name).otherwise(role)
    return files.withColumn("role", role)


def pannuke_masks(masks: DataFrame, channels: int) -> DataFrame:
    """Flat masks with axes H, W, C as C, H, W."""
    n = F.size("mask") / channels
    return masks.withColumn("mask", F.transform(F.sequence(F.lit(0), F.size("mask") - 1), lambda p: F.col("mask")[((p % n) * channels + F.floor(p / n)).cast("int")]))


def focus_fold(rows: DataFrame, fold: int | None, index: str = "idx") -> DataFrame:
    """The rows of one fold of the focus data set, or all; each row is in one fold."""
    if fold is None:
        return rows
    return rows.filter(F.col(index).between(*FOCUS_FOLDS[fold]))
