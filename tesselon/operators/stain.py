"""Stain separation of brightfield pixels and the detectors built on it.

Statistics are aggregates per slide or tile. Only the eigenvectors of each group's 3x3 covariance come
from numpy, in a batch function over one row a group; everything before and after is columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions.color import grey, optical_density
from tesselon.lineage import cut
from tesselon.operators import labels, stencil, threshold

_RGB = ("r", "g", "b")
# Reference stain vectors (red, green, blue for hematoxylin, then eosin) and their 99th percentile concentrations (fixed values).
REFERENCE = ((0.5626, 0.7201, 0.4062), (0.2159, 0.8012, 0.5581))
REFERENCE_MAX = (1.9705, 1.0308)


def _densities(rgb: DataFrame) -> DataFrame:
    return rgb.withColumns({f"o{c}": optical_density(F.col(c)) for c in _RGB})


def stain_vectors(rgb: DataFrame, key: str, beta: float = 0.15, alpha: float = 1.0) -> DataFrame:
    """(key, h, e): unit stain vectors as arrays, from the extreme angles in the plane of greatest variance.

    Only pixels with a density above ``beta`` in all channels count. The signs of the eigenvectors are
    fixed so that they point along positive densities; the vector with more red is hematoxylin.
    """
    od = _densities(rgb).filter(" AND ".join(f"o{c} > {beta}" for c in _RGB))
    pairs = [(a, b) for i, a in enumerate(_RGB) for b in _RGB[i:]]
    cov = od.groupBy(key).agg(*(F.covar_samp(f"o{a}", f"o{b}").alias(f"{a}{b}") for a, b in pairs)).dropna()
    kind = rgb.schema[key].dataType.simpleString()

    def plane(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = np.empty((len(f), 3, 3))
            for a, b in pairs:
                i, j = _RGB.index(a), _RGB.index(b)
                m[:, i, j] = m[:, j, i] = f[f"{a}{b}"]
            v = np.linalg.eigh(m)[1][:, :, [2, 1]]
            v = v * np.where(v.sum(axis=1, keepdims=True) < 0, -1, 1)
            yield pd.DataFrame({key: f[key], "u": v[:, :, 0].tolist(), "w": v[:, :, 1].tolist()})

    axes = cov.mapInPandas(plane, f"{key} {kind}, u array<double>, w array<double>")
    dot = lambda v: sum((F.col(f"o{c}") * F.col(v)[k] for k, c in enumerate(_RGB)), F.lit(0.0))
    angle = F.atan2(dot("w"), dot("u"))
    axes = cut(axes)
    angles = od.join(axes, key).select(key, angle.alias("angle"))
    of = lambda share, name: threshold.percentile(angles, (key,), "angle", share).withColumnRenamed("p", name)
    ends = axes.join(of(alpha / 100, "low"), key).join(of(1 - alpha / 100, "high"), key)
    at = lambda a: F.transform(F.arrays_zip("u", "w"), lambda z: z["u"] * F.cos(a) + z["w"] * F.sin(a))
    both = ends.select(key, at(F.col("low")).alias("p"), at(F.col("high")).alias("q"))
    red = F.col("p")[0] > F.col("q")[0]
    return both.select(key, F.when(red, F.col("p")).otherwise(F.col("q")).alias("h"), F.when(red, F.col("q")).otherwise(F.col("p")).alias("e"))


def sparse_stain_vectors(rgb: DataFrame, key: str, beta: float = 0.15, penalty: float = 0.1, rounds: int = 10) -> DataFrame:
    """(key, h, e): unit stain vectors by sparse non-negative factors of the densities.

    From the reference vectors on, each round gives every pixel its best amounts of both stains under a
    ``penalty`` on their sum, in closed form, and each slide the vectors that fit these amounts best.
    What a round needs of a slide's pixels are nine sums. The vector with more red is hematoxylin.
    """
    od = _densities(rgb).filter(" AND ".join(f"o{c} > {beta}" for c in _RGB)).select(key, *(F.col(f"o{c}").alias(f"x{k}") for k, c in enumerate(_RGB)))
    axes, names = range(3), [f"{s}{k}" for s in "he" for k in range(3)]
    state = cut(rgb.select(key).distinct().select(key, *(F.lit(REFERENCE[s][k]).alias(f"{n}{k}") for s, n in enumerate("he") for k in axes)))
    dot = lambda a, b: reduce(lambda x, y: x + y, (F.col(f"{a}{k}") * F.col(f"{b}{k}") for k in axes))

    def fitted(df: DataFrame, own: str, other: str, square: str) -> DataFrame:
        """One vector from the sums and the other vector, not below 0, of unit length."""
        kept = [c for c in df.columns if c not in {f"{own}{k}" for k in axes}]
        raw = [F.when(F.col(square) > 0, F.greatest((F.col(f"b{own}{k}") - F.col("cross") * F.col(f"{other}{k}")) / F.col(square), F.lit(0.0))).otherwise(F.col(f"{own}{k}")).alias(f"{own}{k}") for k in axes]
        df = df.select(*kept, *raw)
        return df.select(*kept, *(F.coalesce(F.try_divide(F.col(f"{own}{k}"), F.sqrt(dot(own, own))), F.lit(0.0)).alias(f"{own}{k}") for k in axes))

    for _ in range(rounds):
        given = od.join(state, key).withColumns({"p": dot("h", "x") - penalty, "q": dot("e", "x") - penalty, "g": dot("h", "e")})
        det = 1 - F.col("g") * F.col("g")
        given = given.withColumns({"u": F.try_divide(F.col("p") - F.col("g") * F.col("q"), det), "v": F.try_divide(F.col("q") - F.col("g") * F.col("p"), det)})
        both, first = (F.col("u") >= 0) & (F.col("v") >= 0), F.col("p") >= F.col("q")
        given = given.withColumns({"ah": F.when(both, F.col("u")).when(first, F.greatest("p", F.lit(0.0))).otherwise(0.0), "ae": F.when(both, F.col("v")).when(first, 0.0).otherwise(F.greatest("q", F.lit(0.0)))})
        square = {"hh": ("ah", "ah"), "cross": ("ah", "ae"), "ee": ("ae", "ae")}
        sums = given.groupBy(key).agg(*(F.sum(F.col(a) * F.col(b)).alias(n) for n, (a, b) in square.items()), *(F.sum(F.col(f"x{k}") * F.col(f"a{n}")).alias(f"b{n}{k}") for n in "he" for k in axes))
        state = cut(fitted(fitted(sums.join(state, key), "h", "e", "hh"), "e", "h", "ee").select(key, *names), state)
    red = F.col("h0") > F.col("e0")
    of = lambda n: F.array(*(F.col(f"{n}{k}") for k in axes))
    return state.select(key, F.when(red, of("h")).otherwise(of("e")).alias("h"), F.when(red, of("e")).otherwise(of("h")).alias("e"))


def concentrations(rgb: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Columns ch and ce: the least-squares amounts of both stains, by the normal equations of two unknowns."""
    d = _densities(rgb).join(vectors, key)
    dot = lambda x, y: sum((x(k) * y(k) for k in range(3)), F.lit(0.0))
    h, e, o = (lambda k: F.col("h")[k]), (lambda k: F.col("e")[k]), (lambda k: F.col(f"o{_RGB[k]}"))
    hh, ee, he, ho, eo = dot(h, h), dot(e, e), dot(h, e), dot(h, o), dot(e, o)
    det = hh * ee - he * he
    out = d.withColumns({"ch": F.try_divide(ee * ho - he * eo, det), "ce": F.try_divide(hh * eo - he * ho, det)})
    return out.drop("h", "e", *(f"o{c}" for c in _RGB))


def _rebuilt(amounts: dict[str, Column], target: tuple) -> dict[str, Column]:
    total = lambda k: sum((a * target[s][k] for s, a in enumerate(amounts.values())), F.lit(0.0))
    return {c: F.floor(F.least(F.greatest(256 * F.exp(-total(k)) - 1, F.lit(0.0)), F.lit(255.0))).cast("int") for k, c in enumerate(_RGB)}


_METHODS = {"macenko": stain_vectors, "vahadane": sparse_stain_vectors}


class Target(NamedTuple):
    """Colours to normalise to: the stains' vectors and the 99th percentiles of their concentrations."""

    vectors: tuple[tuple[float, ...], tuple[float, ...]] = REFERENCE
    most: tuple[float, float] = REFERENCE_MAX


def fit_to_reference(rgb: DataFrame, method: str = "macenko", **how) -> Target:
    """The colours of one reference image (r, g, b); its statistics are four numbers a stain."""
    one = rgb.select(F.lit(0).alias("_image"), *_RGB)
    vectors = cut(_METHODS[method](one, "_image", **how))
    amounts = concentrations(one, vectors, "_image")
    found = vectors.first()
    if found is None:
        raise ValueError("the reference image has no stained pixels")
    most = tuple(threshold.percentile(amounts, ("_image",), c, 0.99).first()["p"] for c in ("ch", "ce"))
    return Target((tuple(found["h"]), tuple(found["e"])), most)


def normalize_stain(rgb: DataFrame, key: str, stain: str = "both", method: str = "macenko", target: Target = Target(), **how) -> DataFrame:
    """Pixels in a target's colours: both stains, or only ``hematoxylin`` or ``eosin``; ``method`` is macenko or vahadane.

    Concentrations are scaled so that their 99th percentile in each group meets the target's.
    """
    vectors = _METHODS[method](rgb, key, **how)
    amounts = concentrations(rgb, vectors, key)
    top = lambda c, name: threshold.percentile(amounts, (key,), c, 0.99).withColumnRenamed("p", name)
    scaled = amounts.join(top("ch", "th"), key).join(top("ce", "te"), key).withColumns({"ch": F.coalesce(F.try_divide(F.col("ch") * target.most[0], F.col("th")), F.lit(0.0)), "ce": F.coalesce(F.try_divide(F.col("ce") * target.most[1], F.col("te")), F.lit(0.0))})
    keep = {"h": F.col("ch") if stain != "eosin" else F.lit(0.0), "e": F.col("ce") if stain != "hematoxylin" else F.lit(0.0)}
    return scaled.withColumns(_rebuilt(keep, target.vectors)).drop("ch", "ce", "th", "te")


def detect_tissue(rgb: DataFrame, key: str, height: int, width: int, blur: int = 3, size: int = 3, min_region: int = 4, max_hole: int = 4, level: float | None = None) -> DataFrame:
    """(key, i, j) of tissue: dark pixels after a median, opened, closed, small regions and holes removed."""
    dark = rgb.select(key, "i", "j", (255 - grey(F.col("r"), F.col("g"), F.col("b"))).alias("v"))
    mask = threshold.binary_threshold(stencil.median_blur(dark, (key,), blur), (key,), level)
    closed = stencil.morph_close(stencil.morph_open(mask, (key,), size), (key,), size)
    return labels.foreground(cut(closed), key, height, width, min_region, max_hole)


def detect_nuclei(rgb: DataFrame, key: str, step: int = 4, compactness: float = 10.0, rounds: int = 2, method: str = "vahadane") -> DataFrame:
    """(key, i, j, v): 255 where the hematoxylin's superpixel mean is dark by Otsu's threshold, else 0."""
    stained = normalize_stain(rgb, key, "hematoxylin", method).select(key, "i", "j", grey(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    clusters = labels.superpixels(stained, key, step, compactness, rounds)
    smooth = stained.join(clusters, [key, "i", "j"])
    means = smooth.groupBy(key, "label").agg(F.floor(F.avg("v")).cast("long").alias("v"))
    flat = smooth.drop("v").join(means, [key, "label"])
    return threshold.binary_threshold(flat.select(key, "i", "j", "v"), (key,), inverse=True)
