"""Operators that map pixels one by one or move them: intensity, shape and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rescale_intensity(pixels: DataFrame, keys: tuple[str, ...], low: float = 0.0, high: float = 255.0, value: str = "v", in_range: tuple[float, float] | None = None) -> DataFrame:
    """Stretch each image's own range, or ``in_range``, to ``low``..``high``; values outside it are held at the ends.

    A constant image becomes ``low``. The range is one aggregate an image, joined back.
    """
    if in_range:
        least, most = F.lit(float(in_range[0])), F.lit(float(in_range[1]))
        pixels = pixels.withColumn(value, F.least(F.greatest(F.col(value).cast("double"), least), most))
    else:
        least, most = F.col("_least"), F.col("_most")
        pixels = pixels.join(pixels.groupBy(*keys).agg(F.min(value).alias("_least"), F.max(value).alias("_most")), list(keys))
    share = F.coalesce(F.try_divide((F.col(value) - least).cast("double"), (most - least).cast("double")), F.lit(0.0))
    return pixels.withColumn(value, share * (high - low) + low).drop("_least", "_most")


def collapse_runs(pixels: DataFrame, z: int, times: int) -> DataFrame:
    """5-D pixels (x, y, z, c, t) at plane ``z`` with one channel c * times + t."""
    return pixels.filter(F.col("z") == z).select(*[c for c in pixels.columns if c not in ("z", "c", "t")], (F.col("c") * times + F.col("t")).alias("ch"))


def upsample(pixels: DataFrame, factor: int) -> DataFrame:
    """Each pixel as a block of ``factor`` by ``factor``."""
    offsets = F.sequence(F.lit(0), F.lit(factor - 1))
    wide = pixels.withColumn("_a", F.explode(offsets)).withColumn("_b", F.explode(offsets))
    return wide.withColumn("i", F.col("i") * factor + F.col("_a")).withColumn("j", F.col("j") * factor + F.col("_b")).drop("_a", "_b")


def pad_or_crop(pixels: DataFrame, keys: tuple[str, ...], size: tuple[int, int], target: tuple[int, int], value: str = "v") -> DataFrame:
    """Centre images of ``size`` in ``target``; an odd remainder goes to the end, new pixels are 0."""
    before = [(t - s) // 2 if t >= s else -((s - t) // 2) for s, t in zip(size, target, strict=True)]
    moved = pixels.select(*keys, (F.col("i") + before[0]).alias("i"), (F.col("j") + before[1]).alias("j"), value)
    inside = moved.filter((F.col("i") >= 0) & (F.col("i") < target[0]) & (F.col("j") >= 0) & (F.col("j") < target[1]))
    sides = [F.explode(F.sequence(F.lit(0), F.lit(t - 1))) for t in target]
    grid = pixels.select(*keys).distinct().withColumn("i", sides[0]).withColumn("j", sides[1])
    return grid.join(inside, [*keys, "i", "j"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def normalize_lines(pixels: DataFrame, keys: tuple[str, ...], line: str, value: str = "v") -> DataFrame:
    """Divide by the Euclidean norm of the row (``line`` i) or column (j); zero lines stay zero."""
    norm = F.sqrt(F.sum(F.col(value).cast("double") * F.col(value)).over(Window.partitionBy(*keys, line)))
    return pixels.withColumn(value, F.coalesce(F.try_divide(F.col(value).cast("double"), norm), F.lit(0.0)))


def nucleus_mask(pixels: DataFrame, keys: tuple[str, ...], channels: int) -> DataFrame:
    """Sum of all class channels but the last, which is background."""
    return pixels.filter(F.col("c") < channels - 1).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def narrow(value: Column, bytes_per_value: int) -> Column:
    """Unsigned integers of several bytes to 0..255 by their upper byte."""
    return F.floor(value / float(1 << (8 * (bytes_per_value - 1)))).cast("int")


def centre_crop(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """The central ``target`` of images of ``size``, coordinates shifted."""
    top, left = ((s - t) // 2 for s, t in zip(size, target, strict=True))
    inside = pixels.filter((F.col("i") >= top) & (F.col("i") < top + target[0]) & (F.col("j") >= left) & (F.col("j") < left + target[1]))
    return inside.withColumn("i", F.col("i") - top).withColumn("j", F.col("j") - left)


def drop_alpha(pixels: DataFrame) -> DataFrame:
    """RGBA pixels without the last channel."""
    return pixels.drop("a")


def squeeze(pixels: DataFrame, axes: tuple[str, ...] = ("z", "t")) -> DataFrame:
    """Pixels without the axes along which there is one plane only; an axis with more is an error."""
    several = pixels.agg(*(F.count_distinct(a).alias(a) for a in axes)).first()
    left = [a for a in axes if several[a] > 1]
    if left:
        raise ValueError(f"axes {', '.join(left)} have several planes")
    return pixels.drop(*axes)


def foreground_of_classes(pixels: DataFrame, channels: int) -> DataFrame:
    """(keys, i, j, v): one minus the last class channel, which is background."""
    return pixels.filter(F.col("c") == channels - 1).drop("c").withColumn("v", 1 - F.col("v"))
