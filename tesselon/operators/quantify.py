"""Measurements of labelled objects: single-cell tables, shape, class votes and superpixel means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantify(pixels: DataFrame, keys: tuple[str, ...], channels: tuple[str, ...], offset: tuple[str, str] | None = None) -> DataFrame:
    """One row a label: pixel count, mean, minimum and maximum of each channel, and the centroid (y, x).

    Label 0 is background. ``offset`` names the columns of the tile's corner, which move centroids into
    the slide's frame. Labels are those of their tile, so ``keys`` includes the tile.
    """
    own = pixels.filter("label <> 0")
    y, x = (F.col("i") + F.col(offset[0]), F.col("j") + F.col(offset[1])) if offset else (F.col("i"), F.col("j"))
    stats = [f(c).alias(f"{name}_{c}") for c in channels for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return own.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("area"), F.avg(y).alias("y"), F.avg(x).alias("x"), *stats)


def euler_number(pixels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, label, euler): objects minus holes for 8-connection, from counts of 2x2 windows.

    Each pixel counts for the four windows that it is part of; windows with one pixel add a quarter,
    those with three take one, and those with two on a diagonal take a half.
    """
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(1 << (2 * a + b)).alias("bit")) for a in (0, 1) for b in (0, 1))))
    sent = pixels.filter("label <> 0").withColumn("_o", corner)
    quads = sent.groupBy(*keys, "label", (F.col("i") - F.col("_o.a")).alias("_i"), (F.col("j") - F.col("_o.b")).alias("_j")).agg(F.sum("_o.bit").alias("q"))
    one, three, diagonal = F.col("q").isin(1, 2, 4, 8), F.col("q").isin(7, 11, 13, 14), F.col("q").isin(6, 9)
    score = F.when(one, 1).when(three, -1).when(diagonal, -2).otherwise(0)
    return quads.groupBy(*keys, "label").agg(F.floor(F.sum(score) / 4).cast("long").alias("euler"))


def majority(votes: DataFrame, keys: tuple[str, ...], choice: str) -> DataFrame:
    """(keys, choice, n): the most frequent choice, ties to the smallest."""
    counts = votes.groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(choice, "n"), F.struct(-F.col("n"), F.col(choice))).alias("b")
    return counts.groupBy(*keys).agg(best).select(*keys, f"b.{choice}", "b.n")


def nuclei(pixels: DataFrame, keys: tuple[str, ...], kind: str, background=0) -> DataFrame:
    """(keys, label, y, x, area, type, prob): background pixels vote only where nothing else does."""
    own = pixels.filter("label <> 0")
    votes = own.groupBy(*keys, "label", kind).agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("si"), F.sum("j").alias("sj"))
    order = F.struct((F.col(kind) == background).alias("bg"), -F.col("n"), F.col(kind))
    out = votes.groupBy(*keys, "label").agg(F.sum("n").alias("area"), (F.sum("si") / F.sum("n")).alias("y"), (F.sum("sj") / F.sum("n")).alias("x"), F.min_by(F.struct(F.col(kind).alias("type"), "n"), order).alias("b"))
    return out.select(*keys, "label", "y", "x", "area", "b.type", (F.col("b.n") / (F.col("area") + 1e-6)).alias("prob"))


def centroids_by_type(found: DataFrame, least: float) -> DataFrame:
    """(type, centroids): the places of all nuclei of sufficient probability, in order."""
    return found.filter(F.col("prob") >= least).groupBy("type").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("centroids"))


def superpixel_mean(pixels: DataFrame, keys: tuple[str, ...], label: str = "label", value: str = "v") -> DataFrame:
    """Each pixel with the truncated mean of its superpixel; means are joined, so a large superpixel is no single task."""
    means = pixels.groupBy(*keys, label).agg(F.floor(F.avg(value)).cast("long").alias("_mean"))
    return pixels.join(means, [*keys, label]).withColumn(value, F.col("_mean")).drop("_mean")


def clockwise(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Points with their rank by angle about the centre of their bounding box; points at one place in the order of their other columns."""
    w = Window.partitionBy(*keys)
    cx, cy = ((F.min(c).over(w) + F.max(c).over(w)) / 2 for c in ("x", "y"))
    angled = points.withColumn("angle", F.round(F.atan2(F.col("x") - cx, F.col("y") - cy), 9))
    return angled.withColumn("rank", F.row_number().over(w.orderBy("angle", "x", "y", *(c for c in points.columns if c not in (*keys, "x", "y"))))).drop("angle")


def polygon(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, area, cx, cy) of closed polygons whose vertices are ordered by ``rank``: the shoelace sums."""
    w = Window.partitionBy(*keys).orderBy("rank")
    first = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = [F.coalesce(F.lead(c).over(w), F.first(c).over(first)) for c in ("x", "y")]
    sides = points.withColumns({"_x": nxt[0], "_y": nxt[1]}).withColumn("_c", F.col("x") * F.col("_y") - F.col("_x") * F.col("y"))
    area = F.sum("_c") / 2
    return sides.groupBy(*keys).agg(area.alias("area"), (F.sum((F.col("x") + F.col("_x")) * F.col("_c")) / 6 / (area + 1e-5)).alias("cx"), (F.sum((F.col("y") + F.col("_y")) * F.col("_c")) / 6 / (area + 1e-5)).alias("cy"))


def direction_map(pixels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Columns h and v: signed distance to the object's centre, each side of it scaled to 1."""
    w = Window.partitionBy(*keys, "label")
    own = pixels.filter("label <> 0").withColumns({"_y": F.floor(F.avg("i").over(w)), "_x": F.floor(F.avg("j").over(w))})
    own = own.withColumns({"h": F.col("j") - F.col("_x"), "v": F.col("i") - F.col("_y")})
    scale = lambda c: F.when(F.col(c) < 0, F.try_divide(F.col(c), -F.min(c).over(w))).otherwise(F.coalesce(F.try_divide(F.col(c), F.max(c).over(w)), F.lit(0.0))).cast("double")
    return own.select(*keys, "label", "i", "j", scale("h").alias("h"), scale("v").alias("v"))


def outer_union(*counts: DataFrame) -> DataFrame:
    """Count tables of tiles or slides on top of each other; channels that one lacks are null."""
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def quantify_mif(pixels: DataFrame, key: str, channels: tuple[str, ...], offset: tuple[str, str] | None = None) -> DataFrame:
    """``quantify`` with filled_area and euler: the single-cell table of a tile's segmentation."""
    from tesselon.operators.segment import filled_area

    cells = quantify(pixels, (key,), channels, offset)
    return cells.join(filled_area(pixels, key), [key, "label"]).join(euler_number(pixels, (key,)), [key, "label"])


def region_name(name):
    """A slide's printed name as a region: letters, digits, blanks and points, without its class's name."""
    # The characters that stay and the name that goes are fixed values: regions must be called so.
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9 \n\.]", ""), r"\n", ""), "SlideDataname", "")


def vectra_workflow(slides: DataFrame, segment, channels: int) -> DataFrame:
    """(region, label, area, mean_..., filled_area, euler): cells of all slides of two runs on top of each other.

    ``slides`` are pixels (run, name, x, y, z, c, t, v) with runs A and B; plane 0 is collapsed to
    channels, ``segment`` gives (name, i, j, label) from (name, i, j, c0, c1, ...), and what a slide's
    name says after an X is replaced by its run.
    """
    from tesselon.operators.point import collapse_runs

    named = slides.filter(F.col("run").isin("A", "B")).withColumn("name", F.concat(F.regexp_replace("name", "X.*", ""), "run"))
    flat = collapse_runs(named, 0, 1).withColumnsRenamed({"x": "i", "y": "j"})
    names = [f"c{k}" for k in range(channels)]
    wide = flat.groupBy("name", "i", "j").agg(*(F.max(F.when(F.col("ch") == k, F.col("v"))).alias(n) for k, n in enumerate(names)))
    cells = quantify_mif(wide.join(segment(wide), ["name", "i", "j"]), "name", tuple(names))
    return cells.withColumn("name", region_name("name")).withColumnRenamed("name", "region")
