"""Splines, borders and reference colours against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators import resample, stain, stencil, tiles


def frame(spark, images):
    rows = [(k, int(i), int(j), float(v)) for k, image in images.items() for (i, j), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "k string, i int, j int, v double")


def arrays(df, value="v"):
    rows = {}
    for r in df.collect():
        rows.setdefault(r["k"], {})[r["i"], r["j"]] = r[value]
    out = {}
    for k, held in rows.items():
        out[k] = np.full((max(i for i, _ in held) + 1, max(j for _, j in held) + 1), np.nan)
        for at, v in held.items():
            out[k][at] = v
    return out


def dense(line, size):
    """The spline's values from the inverse of its whole system."""
    n = len(line)
    if n == 1:
        return np.full(size, line[0])
    fold = lambda p: abs(p) if abs(p) <= n - 1 else 2 * (n - 1) - abs(p)
    system = np.zeros((n, n))
    for p in range(n):
        for d, w in ((-1, 1), (0, 4), (1, 1)):
            system[p, fold(p + d)] += w / 6
    c = np.linalg.solve(system, line)
    bump = lambda x: (4 - 6 * x * x + 3 * x**3) / 6 if x < 1 else (2 - x) ** 3 / 6 if x < 2 else 0.0
    places = [k * (n - 1) / (size - 1) if size > 1 else 0.0 for k in range(size)]
    return np.array([sum(c[fold(p)] * bump(abs(x - p)) for p in range(-1, n + 1)) for x in places])


def test_zoom_equals_dense_splines(spark):
    rng = np.random.default_rng(1)
    images = {"a": rng.random((9, 14)), "b": rng.random((5, 5)), "c": rng.random((1, 6)), "d": rng.random((2, 1))}
    for size in ((4, 20), (1, 1), (9, 14)):
        got = arrays(resample.zoom(frame(spark, images), ("k",), size))
        for k, image in images.items():
            wide = np.array([dense(line, size[1]) for line in image])
            expected = np.array([dense(line, size[0]) for line in wide.T]).T
            assert np.allclose(got[k], expected), (k, size)
    same = arrays(resample.zoom(frame(spark, {"a": images["a"]}), ("k",), (9, 14)))
    assert np.allclose(same["a"], images["a"])


@pytest.mark.parametrize("border,mode", [("reflect", "reflect"), ("replicate", "edge")])
def test_borders_and_tiles(spark, monkeypatch, border, mode):
    rng = np.random.default_rng(2)
    images = {"a": rng.random((13, 19)), "b": rng.random((5, 6))}
    for side in (5, 256):
        monkeypatch.setattr(tiles, "SIZE", side)
        for kind, size in (("box", 3), ("median", 5), ("gaussian", 5)):
            got = arrays(stencil.blur_within(frame(spark, images), ("k",), kind, size, 0.9, border))
            for k, image in images.items():
                half = size // 2
                views = np.lib.stride_tricks.sliding_window_view(np.pad(image, half, mode=mode), (size, size))
                line = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * 0.9**2))
                weights = np.outer(line, line) / line.sum() ** 2
                expected = {"box": views.mean(axis=(2, 3)), "median": np.median(views, axis=(2, 3)), "gaussian": (views * weights).sum(axis=(2, 3))}[kind]
                assert np.allclose(got[k], expected), (k, kind, side)
    for wrong in (("box", 4, 1.0, "reflect"), ("mean", 3, 1.0, "reflect"), ("box", 3, 1.0, "wrap")):
        with pytest.raises(ValueError):
            stencil.blur_within(frame(spark, images), ("k",), *wrong)


def test_edges_of_labels_do_not_depend_on_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    image = np.kron(rng.integers(0, 3, (4, 5)), np.ones((5, 4), int))
    df = frame(spark, {"a": image}).withColumn("label", F.col("v").cast("int")).drop("v")
    own = image.copy()
    for _ in range(2):
        wide, gone = np.pad(own, 1, constant_values=-1), np.zeros(own.shape, bool)
        for di, dj in ((0, 1), (2, 1), (1, 0), (1, 2)):
            beside = wide[di : di + own.shape[0], dj : dj + own.shape[1]]
            gone |= (beside >= 0) & (beside != own)
        own = np.where(gone, 0, own)
    for side in (3, 256):
        monkeypatch.setattr(tiles, "SIZE", side)
        assert np.array_equal(arrays(stencil.erode_edges(df, ("k",), 2), "label")["a"], own)


@pytest.mark.parametrize("method", ["macenko", "vahadane"])
def test_images_take_the_colours_of_a_reference(spark, method):
    rng = np.random.default_rng(4)

    def slide(h, e, n=600):
        amounts = rng.gamma(2.0, 0.35, (n, 2))
        amounts[: n // 3, 0] = amounts[n // 3 : 2 * n // 3, 1] = 0.02
        density = amounts @ np.array([np.array(v) / np.linalg.norm(v) for v in (h, e)])
        return [tuple(int(x) for x in np.clip(256 * np.exp(-d) - 1, 0, 255)) for d in density]

    to_frame = lambda px: spark.createDataFrame([("s", k, *p) for k, p in enumerate(px)], "slide string, k int, r int, g int, b int")
    reference, other = to_frame(slide((0.65, 0.70, 0.29), (0.07, 0.99, 0.11))), to_frame(slide((0.55, 0.76, 0.34), (0.20, 0.95, 0.22)))
    target = stain.fit_to_reference(reference, method)
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in target.vectors) and target.vectors[0][0] > target.vectors[1][0] and min(target.most) > 0
    again = stain.fit_to_reference(stain.normalize_stain(other, "slide", method=method, target=target), method)
    for found, wanted in zip(again.vectors, target.vectors, strict=True):
        assert np.dot(found, wanted) > 0.98
    with pytest.raises(ValueError):
        stain.fit_to_reference(to_frame([(255, 255, 255)] * 5), method)
