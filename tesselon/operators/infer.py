"""Model inference on tiles: one ONNX session per Python worker and model, tiles in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Numbers that go through a model together at most, apart from a single image.
_BATCH_VALUES = 1 << 20


@dataclass(frozen=True)
class ModelCard:
    name: str = ""
    num_classes: int = 0
    model_type: str = ""
    notes: str = ""
    model_input_notes: str = ""
    model_output_notes: str = ""
    citation: str = ""

    def as_dict(self) -> dict:
        return asdict(self)


@lru_cache(maxsize=4)
def session(model: bytes):
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = 1  # Spark's tasks are the parallelism
    return ort.InferenceSession(model, options, providers=["CPUExecutionProvider"])


def is_clean(model: bytes) -> bool:
    """Whether no initializer of the model can be overridden by an input."""
    return not session(model).get_overridable_initializers()


def fits(height: Column, width: Column, least: int) -> Column:
    """Both sides must reach the model's input size."""
    return (height >= least) & (width >= least)


def infer(tiles: DataFrame, model: bytes, key: str, shape: tuple[int, int, int], channels: int | None = None) -> DataFrame:
    """(key, shape, output): the model's outputs for tiles given as flat float arrays in column ``image``.

    ``shape`` is channels, height, width. Several outputs are joined along their channels; ``channels``
    keeps the first ones. Null images, or images of another size, give a null output.
    """
    kind = tiles.schema[key].dataType.simpleString()
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = session(model)
        given = net.get_inputs()[0]
        # Where the model leaves its first dimension open, images go through it together.
        together = 1 if isinstance(given.shape[0], int) else max(1, _BATCH_VALUES // max(1, size))
        for batch in batches:
            images = batch.column("image").cast(pa.list_(pa.float32()))
            good = [k for k, n in enumerate(pc.list_value_length(images).to_pylist()) if n == size]
            shapes, out = [None] * batch.num_rows, [None] * batch.num_rows
            for at in range(0, len(good), together):
                some = good[at : at + together]
                x = images.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), *shape)
                found = net.run(None, {given.name: x})
                y = (found[0] if len(found) == 1 else np.concatenate(found, axis=1))[:, :channels]
                for k, own in zip(some, y, strict=True):
                    shapes[k], out[k] = list(own.shape), own.ravel()
            yield pa.record_batch([batch.column(key), pa.array(shapes, pa.list_(pa.int32())), pa.array(out, pa.list_(pa.float32()))], [key, "shape", "output"])

    return tiles.select(key, "image").mapInArrow(run, f"{key} {kind}, shape array<int>, output array<float>")


def _field(number: int, payload: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(payload, int):
        return varint(number << 3) + varint(payload)
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def affine_model(scale: float, shift: float) -> bytes:
    """A small ONNX model, y = scale * x + shift on any batch of images; for tests and benchmarks."""

    def constant(name: str, value: float) -> bytes:
        return _field(5, _field(1, 1) + _field(2, 1) + _field(9, np.float32([value]).tobytes()) + _field(8, name.encode()))

    def node(kind: str, a: str, b: str, out: str) -> bytes:
        return _field(1, _field(1, a.encode()) + _field(1, b.encode()) + _field(2, out.encode()) + _field(4, kind.encode()))

    def value(name: str) -> bytes:
        dims = b"".join(_field(1, _field(2, d.encode())) for d in ("n", "c", "h", "w"))
        return _field(1, name.encode()) + _field(2, _field(1, _field(1, 1) + _field(2, dims)))

    graph = node("Mul", "data", "scale", "t") + node("Add", "t", "shift", "y") + _field(2, b"affine") + constant("scale", scale) + constant("shift", shift) + _field(11, value("data")) + _field(12, value("y"))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def mean_per_entity(patches: DataFrame, nodes: DataFrame, key: tuple[str, ...], features: str = "features") -> DataFrame:
    """(key, features): mean of the patches' feature arrays; entities without patches get zeros of the same length."""
    long = patches.select(*key, F.posexplode(features).alias("k", "x")).groupBy(*key, "k").agg(F.avg("x").alias("x"))
    mean = long.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("f")).select(*key, F.transform("f", lambda s: s["x"]).alias(features))
    length = patches.agg(F.max(F.size(features)).alias("_n"))
    joined = nodes.select(*key).distinct().join(mean, list(key), "left").join(F.broadcast(length))
    return joined.select(*key, F.coalesce(features, F.array_repeat(F.lit(0.0), F.coalesce("_n", F.lit(0)))).alias(features))
