"""Graph networks against dense numpy, eccentricities against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators import gnn, graph


def random_graphs(seed, sizes=(7, 1, 12), channels=3):
    rng = np.random.default_rng(seed)
    nodes, edges, dense = [], [], {}
    for g, n in enumerate(sizes):
        x, links = rng.normal(size=(n, channels)), rng.random((n, n)) < 0.3
        dense[g] = x, links
        nodes += [(g, i, x[i].tolist()) for i in range(n)]
        edges += [(g, int(a), int(b)) for a, b in np.argwhere(links)]
    return nodes, edges, dense


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, "graph_id int, node int, x array<double>"), spark.createDataFrame(edges, "graph_id int, src int, dst int")


def weights(kind, inside, out, rng, normal=True):
    w = {"weight": rng.normal(size=(inside, out)), "bias": rng.normal(size=out)}
    if kind == "sage":
        w["own"] = rng.normal(size=(inside, out))
    if kind == "gin":
        w |= {"eps": np.array(0.25), "weight2": rng.normal(size=(out, out)), "bias2": rng.normal(size=out)}
    if normal:
        w |= {"mean": rng.normal(size=out), "variance": rng.random(out) + 0.5, "scale": rng.normal(size=out), "shift": rng.normal(size=out)}
    return w


def dense_layer(kind, x, links, w):
    """``links[a, b]`` sends from a to b."""
    a = (links & ~np.eye(len(x), dtype=bool)).T.astype(float)
    if kind == "gcn":
        full = a + np.eye(len(x))
        d = 1 / np.sqrt(full.sum(axis=1))
        out = d[:, None] * full * d[None, :] @ x @ w["weight"] + w["bias"]
    elif kind == "sage":
        out = a / np.maximum(a.sum(axis=1, keepdims=True), 1) @ x @ w["weight"] + x @ w["own"] + w["bias"]
    else:
        out = np.maximum((1.25 * x + a @ x) @ w["weight"] + w["bias"], 0) @ w["weight2"] + w["bias2"]
    return (out - w["mean"]) / np.sqrt(w["variance"] + 1e-5) * w["scale"] + w["shift"] if "mean" in w else out


def collected(df):
    return {(r["graph_id"], r["node"]): np.array(r["x"]) for r in df.collect()}


@pytest.mark.parametrize("kind", gnn.KINDS)
def test_layers_equal_dense_products(spark, kind):
    rng = np.random.default_rng(3)
    nodes, edges, dense = random_graphs(1)
    w = [weights(kind, 3, 4, rng), weights(kind, 4, 2, rng, False)]
    layers = [gnn.Layer(kind, x) for x in w]
    expected = {}
    for g, (x, links) in dense.items():
        h = [dense_layer(kind, x, links, w[0])]
        h.append(dense_layer(kind, h[0], links, w[1]))
        expected |= {(g, i): np.concatenate([h[0][i], h[1][i]]) for i in range(len(x))}
    got = collected(gnn.run(*frames(spark, nodes, edges), layers, "concat"))
    assert got.keys() == expected.keys() and all(np.allclose(got[k], expected[k]) for k in got)
    last = collected(gnn.run(*frames(spark, nodes, edges), layers))
    assert all(np.allclose(last[k], expected[k][4:]) for k in got)


def plain_lstm(x, w, suffix):
    h = c = np.zeros(w[f"hidden{suffix}"].shape[1])
    out = []
    for step in x:
        i, f, g, o = np.split(w[f"input{suffix}"] @ step + w[f"hidden{suffix}"] @ h + w[f"bias{suffix}"], 4)
        c = c / (1 + np.exp(-f)) + np.tanh(g) / (1 + np.exp(-i))
        h = np.tanh(c) / (1 + np.exp(-o))
        out.append(h)
    return np.array(out)


def test_the_hierarchical_model_equals_dense_numpy(spark):
    rng = np.random.default_rng(5)
    cells, cell_edges, dense_cells = random_graphs(6, (9, 5), 3)
    tissue, tissue_edges, dense_tissue = random_graphs(7, (4, 3, 2), 2)
    assignment = [(g, i, int(rng.integers(0, len(dense_tissue[g][0]) - 1)) if i % 4 else None) for g, (x, _) in dense_cells.items() for i in range(len(x))]
    first, second = [weights("sage", 3, 4, rng), weights("sage", 4, 4, rng)], [weights("gcn", 6, 5, rng), weights("gcn", 5, 5, rng)]
    lstm = {f"{n}{s}": rng.normal(size=size) for s in ("", "_back") for n, size in (("input", (12, 4)), ("hidden", (12, 3)), ("bias", 12))} | {"attention": rng.normal(size=6)}
    head = [{"weight": rng.normal(size=(10, 3)), "bias": rng.normal(size=3)}, {"weight": rng.normal(size=(3, 2))}]
    expected = {}
    for g, (x, links) in dense_tissue.items():
        sums = np.zeros((len(x), 4))
        if g in dense_cells:
            h = [dense_layer("sage", *dense_cells[g], first[0])]
            h.append(dense_layer("sage", h[0], dense_cells[g][1], first[1]))
            for i in range(len(h[0])):
                both = np.stack([h[0][i], h[1][i]])
                out = np.concatenate([plain_lstm(both, lstm, ""), plain_lstm(both[::-1], lstm, "_back")[::-1]], axis=1) @ lstm["attention"]
                share = np.exp(out) / np.exp(out).sum()
                to = next(t for a, c, t in assignment if (a, c) == (g, i))
                if to is not None:
                    sums[to] += share @ both
        h = [dense_layer("gcn", np.concatenate([sums, x], axis=1), links, second[0])]
        h.append(dense_layer("gcn", h[0], links, second[1]))
        pooled = np.concatenate(h, axis=1).mean(axis=0)
        expected[g] = np.maximum(pooled @ head[0]["weight"] + head[0]["bias"], 0) @ head[1]["weight"]
    layers = lambda kind, w: [gnn.Layer(kind, x) for x in w]
    given = *frames(spark, cells, cell_edges), *frames(spark, tissue, tissue_edges), spark.createDataFrame(assignment, "graph_id int, cell int, tissue int")
    got = {r["graph_id"]: r["x"] for r in gnn.cells_and_tissue(*given, layers("sage", first), layers("gcn", second), head, ("lstm", "concat"), (lstm, None)).collect()}
    assert got.keys() == expected.keys() and all(np.allclose(got[g], expected[g]) for g in got)


def test_weights_come_from_a_table(spark, monkeypatch):
    table = spark.createDataFrame([(0, "weight", [2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (0, "eps", [], [0.5])], "layer int, name string, shape array<int>, values array<double>")
    found = gnn.weights_of(table)
    assert found[0]["weight"].tolist() == [[1, 2, 3], [4, 5, 6]] and float(found[0]["eps"]) == 0.5
    monkeypatch.setattr(gnn, "MOST", 3)
    with pytest.raises(ValueError):
        gnn.weights_of(table)
    with pytest.raises(ValueError):
        gnn.Layer("other")


@pytest.mark.parametrize("words,at_once", [(1, 1), (2, 8)])
def test_eccentricities_equal_a_plain_search(spark, words, at_once):
    rng = np.random.default_rng(words)
    edges = [(0, 0, a) for a in range(1, 80)] + [(0, a, a + 1) for a in range(79, 90)] + [(1, int(a), int(b)) for a, b in rng.integers(0, 40, (70, 2))] + [(2, 5, 5), (3, 1, 2)]
    near = {}
    for g, a, b in edges:
        if a != b:
            near.setdefault((g, a), set()).add((g, b))
            near.setdefault((g, b), set()).add((g, a))
    expected = {}
    for start in near:
        seen, front, hops = {start}, {start}, -1
        while front:
            hops, front = hops + 1, {q for p in front for q in near[p]} - seen
            seen |= front
        expected[start] = hops
    got = graph.eccentricities(spark.createDataFrame(edges, "graph_id int, src int, dst int"), words, at_once)
    assert {(r["graph_id"], r["node"]): r["eccentricity"] for r in got.collect()} == expected
    assert graph.eccentricities(spark.createDataFrame([], "graph_id int, src int, dst int")).count() == 0


def test_eccentricities_do_not_take_a_round_a_step(spark, monkeypatch):
    """A path of 3000 nodes took 3000 rounds of joins, and rows for each node and block in each."""
    cuts, real = [], graph.cut

    def counted(df, instead=None):
        cuts.append(1)
        assert len(cuts) < 20
        return real(df, instead)

    monkeypatch.setattr(graph, "cut", counted)
    n = 3000
    path = spark.range(n - 1).select(F.lit("path").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(1, 41).select(F.lit("star").alias("graph_id"), (F.col("id") * 7).alias("src"), F.lit(0).cast("long").alias("dst"))
    got = {(r["graph_id"], r["node"]): r["eccentricity"] for r in graph.eccentricities(path.unionAll(star), sources=700).collect()}
    assert got == {**{("path", k): max(k, n - 1 - k) for k in range(n)}, **{("star", 7 * k): 2 if k else 1 for k in range(41)}}


def test_eccentricities_of_larger_graphs_by_joins(spark):
    """Graphs whose edges are too many for a task keep the search by joins, beside others."""
    edges = [("small", str(k), str(k + 1)) for k in range(6)] + [("large", "hub", str(k)) for k in range(9)] + [("large", "0", "far")]
    df = spark.createDataFrame(edges, "graph_id string, src string, dst string")
    expected = {**{("small", str(k)): max(k, 6 - k) for k in range(7)}, **{("large", str(k)): 3 for k in range(1, 9)}, ("large", "hub"): 2, ("large", "0"): 2, ("large", "far"): 3}
    for most in (0, 12, 1000):
        assert {(r["graph_id"], r["node"]): r["eccentricity"] for r in graph.eccentricities(df, 1, 1, most).collect()} == expected


def test_blocks_hold_every_node_once():
    from tesselon.functions import breadth

    rng = np.random.default_rng(4)
    n = 1500
    pairs = np.unique(np.concatenate([e := rng.integers(0, n, (1800, 2)), e[:, ::-1], [[k, (k + 1) % n] for k in range(n)], [[(k + 1) % n, k] for k in range(n)]]), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    ptr, near = np.searchsorted(pairs[:, 0], np.arange(n + 1)), pairs[:, 1].astype(np.int32)
    order = breadth.blocks(ptr, near)
    assert sorted(order) == list(range(n))
    for k, far in zip(order[::97], breadth.farthest(ptr, near, order)[::97], strict=True):
        steps, front, seen = 0, {k}, {k}
        while front := {q for p in front for q in near[ptr[p] : ptr[p + 1]].tolist()} - seen:
            seen |= front
            steps += 1
        assert far == steps
