"""Metrics, losses and small aggregations over predictions and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scatter_sum(rows: DataFrame, index: str, value: str, targets: DataFrame | None = None) -> DataFrame:
    """(index, total): sums by index; indices of ``targets`` without rows get 0."""
    sums = rows.groupBy(index).agg(F.sum(value).alias("total"))
    return sums if targets is None else targets.select(index).distinct().join(sums, index, "left").withColumn("total", F.coalesce("total", F.lit(0)))


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(degree, n): how many nodes have so many incoming edges, nodes without any included."""
    degrees = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").join(degrees, "node", "left").groupBy(F.coalesce("degree", F.lit(0)).alias("degree")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(rows: DataFrame, target: str) -> DataFrame:
    """(target, weight): rows / (classes x rows of the class)."""
    counts = rows.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return counts.select(target, (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def dice(prediction: Column, truth: Column) -> Column:
    """Aggregate: twice the overlap over the sum of both masks."""
    p, t = (prediction > 0).cast("int"), (truth > 0).cast("int")
    return 2 * F.sum(p * t) / (F.sum(p) + F.sum(t) + 1e-3)


def soft_dice_loss(probability: Column, truth: Column, eps: float = 1e-3) -> Column:
    """Aggregate: one minus the overlap of probabilities and a 0/1 truth."""
    return 1 - (2 * F.sum(probability * truth) + eps) / (F.sum(probability) + F.sum(truth) + eps)


def cross_entropy(probability: Column, truth: Column, eps: float = 1e-7) -> Column:
    """Aggregate: mean negative log-likelihood of a 0/1 truth."""
    p = F.least(F.greatest(probability, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(truth * F.ln(p) + (1 - truth) * F.ln(1 - p))


def squared_error(prediction: Column, truth: Column) -> Column:
    return F.avg((prediction - truth) * (prediction - truth))


def masked_squared_error(prediction: Column, truth: Column, mask: Column) -> Column:
    """Aggregate: squared error inside a mask, as for gradients of direction maps."""
    return F.sum((prediction - truth) * (prediction - truth) * mask) / (F.sum(mask) + 1e-7)


def weighted_f1(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    """(f1): per-class F1 weighted by the class's share of the truth."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by_truth = cells.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    by_guess = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("guessed"))
    f1 = 2 * F.col("hit") / (F.col("support") + F.coalesce("guessed", F.lit(0)))
    return by_truth.join(by_guess, "c", "left").agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))


def summary(value: str) -> list[Column]:
    """Mean, median, maximum, minimum, sum and population deviation."""
    return [F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("max"), F.min(value).alias("min"), F.sum(value).alias("sum"), F.stddev_pop(value).alias("std")]


def mean_pool(nodes: DataFrame, features: tuple[str, ...], graph: str = "graph_id") -> DataFrame:
    """One row a graph: the mean of each feature over its nodes."""
    return nodes.groupBy(graph).agg(*(F.avg(f).alias(f) for f in features))


def hovernet_loss(pixels: DataFrame, key: str, size: int = 5) -> DataFrame:
    """(key, loss): overlap and likelihood of the nucleus branch, error of the distance maps and twice that of their slopes.

    ``pixels`` are (key, i, j, p, mask, h, v, th, tv): probability and truth of a nucleus, predicted and
    true maps. A tile without nuclei has no slopes to compare.
    """
    from tesselon.operators.segment import hv_gradient_loss

    parts = pixels.groupBy(key).agg(
        soft_dice_loss(F.col("p"), F.col("mask")).alias("d"), cross_entropy(F.col("p"), F.col("mask")).alias("c"), squared_error(F.col("h"), F.col("th")).alias("sh"), squared_error(F.col("v"), F.col("tv")).alias("sv")
    )
    joined = parts.join(hv_gradient_loss(pixels, key, size), key, "left")
    return joined.select(key, (F.col("d") + F.col("c") + (F.col("sh") + F.col("sv")) / 2 + 2 * F.coalesce("grad", F.lit(0.0))).alias("loss"))
