"""Thresholds, histograms and the tile labels that derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.color import grey, hsi
from tesselon.lineage import cut


def otsu(pixels: DataFrame, keys: tuple[str, ...], value: str = "v") -> DataFrame:
    """(keys, threshold): the value that maximises the variance between it and below, and above.

    Works on each image's histogram, whose size is that of the value range, not of the image. Ties go
    to the smaller value; an image of one value gets that value.
    """
    hist = pixels.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    mass = F.col("n") * F.col(value)
    sums = hist.select(*keys, value, F.sum("n").over(up).alias("n0"), F.sum(mass).over(up).alias("s0"), F.sum("n").over(every).alias("n_all"), F.sum(mass).over(every).alias("s_all"))
    n1 = F.col("n_all") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - F.try_divide(F.col("s_all") - F.col("s0"), n1)
    between = F.coalesce(F.col("n0").cast("double") * n1 * gap * gap, F.lit(-1.0))
    return sums.withColumn("_b", F.round(between, 6)).groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_b"), F.col(value))).alias("threshold"))


def binary_threshold(pixels: DataFrame, keys: tuple[str, ...], threshold: float | None = None, inverse: bool = False, value: str = "v") -> DataFrame:
    """255 above the threshold, else 0, or the reverse; without a number each image gets Otsu's."""
    if threshold is None:
        pixels = pixels.join(otsu(pixels, keys, value), list(keys)).withColumn("_t", F.col("threshold")).drop("threshold")
    else:
        pixels = pixels.withColumn("_t", F.lit(threshold))
    above = F.col(value) > F.col("_t")
    return pixels.withColumn(value, F.when(~above if inverse else above, 255).otherwise(0)).drop("_t")


def whitespace(rgb: DataFrame, keys: tuple[str, ...], level: int = 230, share: float = 0.5) -> DataFrame:
    """(keys, white): whether more than ``share`` of a tile's grey values exceed ``level``."""
    g = grey(F.col("r"), F.col("g"), F.col("b"))
    return rgb.groupBy(*keys).agg((F.avg((g > level).cast("int")) > share).alias("white"))


def artifacts(rgb: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, artifact): tiles that are mostly white, hold pen marks, or lack tissue."""
    h, s, i = hsi(F.col("r"), F.col("g"), F.col("b"))
    white = (i >= 0.1) & (s <= 0.1)
    pen = ((h > 0.4) & (h < 0.7) & (s > 0.1)) | (i < 0.1)
    share = lambda c: F.avg(c.cast("int"))
    return rgb.groupBy(*keys).agg(((share(white) >= 0.8) | (share(pen) >= 0.05) | (share(~white & ~pen) < 0.5)).alias("artifact"))


def tiles_with_mask(mask: DataFrame, keys: tuple[str, ...], share: float, value: str = "v") -> DataFrame:
    """Keys of the tiles whose mean mask value reaches ``share``."""
    return mask.groupBy(*keys).agg(F.avg(value).alias("_m")).filter(F.col("_m") >= share).select(*keys)


def equalize(pixels: DataFrame, keys: tuple[str, ...], bins: int = 256, value: str = "v") -> DataFrame:
    """Column cdf: the share of an image's pixels in bins up to that of the pixel; values are in 0..255."""
    binned = pixels.withColumn("_bin", F.floor(F.col(value) * bins / 256).cast("int"))
    hist = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    cdf = hist.select(*keys, "_bin", (F.sum("_n").over(up) / F.sum("_n").over(Window.partitionBy(*keys))).alias("cdf"))
    return binned.join(cdf, [*keys, "_bin"]).drop("_bin")


def adaptive_equalize(pixels: DataFrame, keys: tuple[str, ...], block: int, clip: float, bins: int = 256, value: str = "v") -> DataFrame:
    """Column cdf: contrast-limited equalisation, bilinear between the blocks' clipped histograms.

    The histogram of each block of ``block`` by ``block`` pixels is clipped at ``clip`` times its mean
    bin, and what is cut off is spread evenly. A pixel mixes the four blocks whose centres surround it.
    """
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    binned = pixels.withColumn("_bin", F.floor(F.col(value) * bins / 256).cast("int"))
    hist = binned.groupBy(*keys, at("i").alias("bi"), at("j").alias("bj"), "_bin").agg(F.count(F.lit(1)).alias("n"))
    every, up = Window.partitionBy(*keys, "bi", "bj"), Window.partitionBy(*keys, "bi", "bj").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    limit = F.greatest(F.lit(1.0), F.sum("n").over(every) / bins * clip)
    clipped = hist.withColumn("c", F.least(F.col("n").cast("double"), limit)).withColumn("all", F.sum("n").over(every))
    spread = (F.col("all") - F.sum("c").over(every)) / bins
    curves = clipped.select(*keys, "bi", "bj", "_bin", ((F.sum("c").over(up) + (F.col("_bin") + 1) * spread) / F.col("all")).alias("y"), F.lead("_bin").over(Window.partitionBy(*keys, "bi", "bj").orderBy("_bin")).alias("next"), (spread / F.col("all")).alias("slope"))
    # Between two occupied bins the curve rises by the spread share alone.
    first = F.row_number().over(Window.partitionBy(*keys, "bi", "bj").orderBy("_bin"))
    filled = curves.withColumn("_first", first).withColumn(
        "_step", F.explode(F.sequence(F.when(F.col("_first") == 1, -F.col("_bin")).otherwise(F.lit(0)), F.coalesce(F.col("next"), F.lit(bins)) - F.col("_bin") - 1))
    )
    y = F.when(F.col("_step") < 0, (F.col("_bin") + F.col("_step") + 1) * F.col("slope")).otherwise(F.col("y") + F.col("_step") * F.col("slope"))
    curve = filled.select(*keys, "bi", "bj", (F.col("_bin") + F.col("_step")).alias("_bin"), y.alias("y"))
    centre = lambda c: (F.col(c) + 0.5) / block - 0.5
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    four = binned.withColumn("_o", corner).withColumn("bi", (F.floor(centre("i")) + F.col("_o.a")).cast("int")).withColumn("bj", (F.floor(centre("j")) + F.col("_o.b")).cast("int"))
    weight = (1 - F.abs(centre("i") - F.col("bi"))) * (1 - F.abs(centre("j") - F.col("bj")))
    mixed = four.withColumn("_w", weight).join(curve, [*keys, "bi", "bj", "_bin"]).groupBy(*keys, "i", "j").agg((F.sum(F.col("y") * F.col("_w")) / F.sum("_w")).alias("cdf"))
    return pixels.join(mixed, [*keys, "i", "j"])


#: Values of a group that are sorted in one row; groups with more are narrowed down first.
SORTED = 100_000


def percentile(values: DataFrame, keys: tuple[str, ...], value: str, share: float, bins: int = 4096, most: int | None = None) -> DataFrame:
    """(keys, p): the exact percentile of each group, between two values by proportion; nulls do not count.

    A group's histogram of ``bins`` equal parts tells in which of them the wanted ranks lie; only their
    values go on, into a histogram of their own, until at most ``most`` are left, which are sorted. So
    no row ever holds more than that many values, nor a task more than histograms.
    """
    most = most or SORTED
    left = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    bounds = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # The rank of the lower value, counted from 0 among those left, and how far it is to the next.
    rank = (F.col("_n") - 1) * share
    state = cut(bounds.select(*keys, "_n", "_low", "_high", F.floor(rank).alias("_k"), (rank - F.floor(rank)).alias("_f"), (F.col("_low") == F.col("_high")).alias("_done")))
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    wide = ~F.col("_done") & (F.col("_n") > most)
    while not state.filter(wide).isEmpty():
        part = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))
        held = left.join(state.filter(wide), list(keys)).filter(inside)
        hist = held.groupBy(*keys, part.alias("_b")).agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.first("_k").alias("_k"), F.first("_f").alias("_f"))
        hist = hist.withColumn("_before", F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_m"))
        wanted = hist.filter((F.col("_before") + F.col("_m") > F.col("_k")) & (F.col("_before") <= F.col("_k") + (F.col("_f") > 0).cast("int")))
        # If the two ranks lie in two parts, they are the last value of one and the first of the other.
        two = F.count(F.lit(1)) == 2
        low, high = F.when(two, F.min("_most")).otherwise(F.min("_least")), F.when(two, F.max("_least")).otherwise(F.max("_most"))
        new = wanted.groupBy(*keys).agg(F.sum("_m").alias("_n"), low.alias("_low"), high.alias("_high"), (F.first("_k") - F.min("_before")).alias("_k"), F.first("_f").alias("_f"), two.alias("_two"))
        narrowed = new.select(*keys, "_n", "_low", "_high", "_k", "_f", (F.col("_two") | (F.col("_low") == F.col("_high"))).alias("_done"))
        state = cut(state.filter(~wide).unionByName(narrowed), state)
    few = left.join(state.filter(~F.col("_done")), list(keys)).filter(inside)
    ordered = few.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_s"), F.first("_k").alias("_k"), F.first("_f").alias("_f"))
    at = lambda d: F.get("_s", (F.col("_k") + d).cast("int"))
    found = ordered.select(*keys, at(0).alias("_low"), F.coalesce(at(1), at(0)).alias("_high"), "_f").unionByName(state.filter("_done").select(*keys, "_low", "_high", "_f"))
    return found.select(*keys, (F.col("_low") + F.col("_f") * (F.col("_high") - F.col("_low"))).alias("p"))


def clip_percentile(values: DataFrame, keys: tuple[str, ...], share: float = 0.999, value: str = "value") -> DataFrame:
    """Values cut at the exact ``share`` percentile of their group's non-zero values; the percentile as ``cap``."""
    caps = percentile(values.filter(F.col(value) != 0), keys, value, share).withColumnRenamed("p", "cap")
    return values.join(caps, list(keys), "left").withColumn(value, F.least(F.col(value), F.coalesce("cap", F.col(value))))
