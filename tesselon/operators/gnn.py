"""Graph neural networks, run forward: messages are joins over edges, layer products numpy in Arrow batches.

Nodes are (graph_id, node, x), ``x`` an array of numbers, edges (graph_id, src, dst) send messages from
``src`` to ``dst``. What arrives at a node is summed by Spark, one sum a channel, so that sums are formed
before the shuffle and a node with very many neighbours is no burden. Weights are a table (layer, name,
shape, values) of bounded size; layers are numbered from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.lineage import cut

#: Numbers that all weights of a model may have together.
MOST = 1 << 26
KINDS = ("gcn", "sage", "gin")
#: What is added to variances in normalisation (a fixed value of the layers that models are trained with).
_EPSILON = 1e-5


@dataclass
class Layer:
    """One step of message passing.

    ``gcn``: neighbours and the node itself, weighted by one over the root of both degrees, times
    ``weight`` (in x out). ``sage``: the mean of the neighbours times ``weight`` and the node times
    ``own``. ``gin``: the node times 1 + ``eps`` and the sum of its neighbours, through two linear maps
    with a rectifier between (``weight``, ``bias``, then ``weight2``, ``bias2``). Then ``bias``, and where
    there are ``mean``, ``variance``, ``scale`` and ``shift`` a normalisation with these.
    """

    kind: str
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind}: layers are {', '.join(KINDS)}")

    def _normalised(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        if "mean" not in w:
            return x
        return (x - w["mean"]) / np.sqrt(w["variance"] + _EPSILON) * w.get("scale", 1.0) + w.get("shift", 0.0)

    def __call__(self, own: np.ndarray, met: np.ndarray, degree: np.ndarray) -> np.ndarray:
        """New values of nodes from their own, the sum of what met them, and how many messages that were."""
        w = self.weights
        if self.kind == "gcn":
            out = (met + own / np.sqrt(degree + 1)[:, None]) / np.sqrt(degree + 1)[:, None] @ w["weight"] + w.get("bias", 0.0)
        elif self.kind == "sage":
            out = met / np.maximum(degree, 1)[:, None] @ w["weight"] + own @ w["own"] + w.get("bias", 0.0)
        else:
            inner = np.maximum(((1 + float(w.get("eps", 0.0))) * own + met) @ w["weight"] + w.get("bias", 0.0), 0)
            out = inner @ w["weight2"] + w.get("bias2", 0.0)
        return self._normalised(out)


def weights_of(table: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """The arrays of each layer from a table (layer, name, shape, values); tables of more than ``MOST`` numbers are refused."""
    total = table.agg(F.sum(F.size("values"))).first()[0] or 0
    if total > MOST:
        raise ValueError(f"weights of {total} numbers")
    out: dict[int, dict[str, np.ndarray]] = {}
    for r in table.select("layer", "name", "shape", "values").collect():
        out.setdefault(r["layer"], {})[r["name"]] = np.array(r["values"], float).reshape(r["shape"])
    return out


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def mapped(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], function: Callable[..., dict[str, np.ndarray]], into: tuple[str, ...]) -> DataFrame:
    """(keys, into): arrays of numbers computed from the arrays, or numbers, of ``columns``, a batch at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            given = [_rows(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False).astype(float) for c in map(batch.column, columns)]
            found = function(*given)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(found[c], float).ravel()), found[c].shape[1]).cast(pa.list_(pa.float64())) for c in into]
            yield pa.record_batch([*map(batch.column, keys), *lists], [*keys, *into])

    return rows.select(*keys, *columns).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} array<double>" for c in into)]))


def _sum(size: int, name: str = "x"):
    return F.array(*(F.sum(F.col(name)[k]) for k in range(size)))


def _zeros(size: int):
    return F.array_repeat(F.lit(0.0), size)


def _width(nodes: DataFrame) -> int:
    first = nodes.select(F.size("x")).first()
    return first[0] if first else 0


def convolve(nodes: DataFrame, edges: DataFrame, layer: Layer, size: int) -> DataFrame:
    """(graph_id, node, x) after one layer; ``size`` is the length of the nodes' arrays.

    Edges from a node to itself are left out, repeated ones count as often as they occur. Edges to nodes
    that are not there are ignored.
    """
    sent = edges.filter("src <> dst").select("graph_id", "src", "dst")
    degree = sent.groupBy("graph_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    state = nodes.join(degree, ["graph_id", "node"], "left").select("graph_id", "node", F.transform("x", lambda v: v.cast("double")).alias("x"), F.coalesce("degree", F.lit(0)).alias("degree"))
    message = F.transform("x", lambda v: v / F.sqrt(F.col("degree") + 1.0)) if layer.kind == "gcn" else F.col("x")
    given = state.select("graph_id", F.col("node").alias("src"), message.alias("x"))
    met = sent.join(given, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node")).agg(_sum(size).alias("met"))
    both = state.join(met, ["graph_id", "node"], "left").select("graph_id", "node", "x", "degree", F.coalesce("met", _zeros(size)).alias("met"))
    return mapped(both, ("graph_id", "node"), ("x", "met", "degree"), lambda x, met, degree: {"x": layer(x, met, degree)}, ("x",))


def run(nodes: DataFrame, edges: DataFrame, layers: list[Layer], readout: str = "last", attention: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(graph_id, node, x): the nodes' arrays after all layers, those of all of them joined (``concat``), or weighed by ``lstm``."""
    if readout not in ("last", "concat", "lstm"):
        raise ValueError(f"{readout}: readouts are last, concat or lstm")
    size, state, held = _width(nodes), nodes.select("graph_id", "node", "x"), None
    for k, layer in enumerate(layers):
        state = cut(convolve(state, edges, layer, size), state if k else None) if readout == "last" else cut(convolve(state, edges, layer, size))
        size = _width(state)
        own = state.select("graph_id", "node", F.col("x").alias(f"_{k}"))
        held = own if held is None else held.join(own, ["graph_id", "node"])
    if readout == "last" or not layers:
        return state
    names = tuple(f"_{k}" for k in range(len(layers)))
    if readout == "concat":
        return held.select("graph_id", "node", F.concat(*names).alias("x"))
    return mapped(held, ("graph_id", "node"), names, lambda *h: {"x": weighed(np.stack(h, axis=1), attention)}, ("x",))


def _lstm(x: np.ndarray, w: dict[str, np.ndarray], suffix: str) -> np.ndarray:
    """Outputs (rows, steps, hidden) of one direction; gates stand in the order input, forget, cell, output (a fixed value of stored weights)."""
    size = w[f"hidden{suffix}"].shape[1]
    h = c = np.zeros((len(x), size))
    out = []
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(x.shape[1]):
        gates = x[:, t] @ w[f"input{suffix}"].T + h @ w[f"hidden{suffix}"].T + w[f"bias{suffix}"]
        i, f, g, o = np.split(gates, 4, axis=1)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        out.append(h)
    return np.stack(out, axis=1)


def weighed(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """The layers' arrays (rows, layers, channels) summed with weights that a two-way LSTM over the layers gives."""
    both = np.concatenate([_lstm(x, w, ""), _lstm(x[:, ::-1], w, "_back")[:, ::-1]], axis=2)
    score = both @ w["attention"] + w.get("attention_bias", 0.0)
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return (x * (score / score.sum(axis=1, keepdims=True))[:, :, None]).sum(axis=1)


def mean_pool(nodes: DataFrame, size: int) -> DataFrame:
    """(graph_id, x): the mean of a graph's nodes."""
    return nodes.groupBy("graph_id").agg(F.array(*(F.avg(F.col("x")[k]) for k in range(size))).alias("x"))


def to_tissue(cells: DataFrame, tissue: DataFrame, assignment: DataFrame, size: int) -> DataFrame:
    """(graph_id, node, x): tissue nodes with the sum of their cells' arrays before their own; zeros where there is no cell.

    ``assignment`` is (graph_id, cell, tissue), cells without tissue go nowhere.
    """
    at = assignment.filter("tissue IS NOT NULL").select("graph_id", F.col("cell").alias("node"), "tissue")
    sums = cells.join(at, ["graph_id", "node"]).groupBy("graph_id", F.col("tissue").alias("node")).agg(_sum(size).alias("_s"))
    return tissue.join(sums, ["graph_id", "node"], "left").select("graph_id", "node", F.concat(F.coalesce("_s", _zeros(size)), F.transform("x", lambda v: v.cast("double"))).alias("x"))


def classify(graphs: DataFrame, maps: list[dict[str, np.ndarray]]) -> DataFrame:
    """(graph_id, x) through linear maps (``weight`` in x out, ``bias``) with rectifiers between them."""

    def through(x: np.ndarray) -> dict[str, np.ndarray]:
        for k, w in enumerate(maps):
            x = (np.maximum(x, 0) if k else x) @ w["weight"] + w.get("bias", 0.0)
        return {"x": x}

    return mapped(graphs, ("graph_id",), ("x",), through, ("x",))


def cells_and_tissue(
    cells: DataFrame,
    cell_edges: DataFrame,
    tissue: DataFrame,
    tissue_edges: DataFrame,
    assignment: DataFrame,
    cell_layers: list[Layer],
    tissue_layers: list[Layer],
    classifier: list[dict[str, np.ndarray]],
    readout: tuple[str, str] = ("last", "last"),
    attention: tuple[dict | None, dict | None] = (None, None),
) -> DataFrame:
    """(graph_id, x): the outputs of the hierarchical model, one row for each graph with tissue.

    Cells pass messages, their sums join the tissue nodes that they lie in, those pass messages, and
    the mean of a graph's tissue nodes is classified.
    """
    z = cut(run(cells, cell_edges, cell_layers, readout[0], attention[0]))
    joined = cut(to_tissue(z, tissue, assignment, _width(z) or _size(cell_layers, readout[0])))
    nodes = cut(run(joined, tissue_edges, tissue_layers, readout[1], attention[1]))
    return classify(mean_pool(nodes, _width(nodes)), classifier)


def _size(layers: list[Layer], readout: str) -> int:
    """Channels after all layers, for tables without any cell."""
    each = [layer.weights["weight2" if layer.kind == "gin" else "weight"].shape[1] for layer in layers]
    return sum(each) if readout == "concat" else each[-1]
