"""Cell and tissue graphs: neighbours, adjacency, spanning trees, components and centralities.

Nodes are (graph_id, node), edges (graph_id, src, dst). Loops that need several rounds cut their lineage
in each by a checkpoint, so a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions import breadth
from tesselon.lineage import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of ``edges`` (src, dst).

    Each round takes the smallest label among a node's neighbours and then the label of that label,
    which halves the remaining distance.
    """
    edges = cut(edges.select("src", "dst"))
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = new = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("low"))
        hop = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = cut(hop.join(jump, "via").select("node", "old", F.least("via", "far").alias("label")), new)
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            return labels


#: Places that a cell may hold when the search for neighbours begins, and rows of it that a task takes.
_CELL_PLACES, _CELL_ROWS = 24, 20_000


def knn_graph(points: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(graph_id, src, dst, d): the ``k`` nearest other nodes of each, ties to the smaller node.

    Points (graph_id, node, x, y) at one place have the same neighbours but for themselves, so the search
    is for each place and knows its ``k + 1`` smallest nodes. Places fall into square cells, so narrow
    at first that the fullest holds few of them. A place looks at the cells around its own; it is done
    when the last of its ``k + 1`` nearest is no farther than a cell is wide, or when it has seen its
    whole graph. The others look again in cells of twice the width. Cells are arrays of places, of
    which each keeps the nearest, so pairs are neither rows nor sorted. Points without a place have no
    neighbours and are none.
    """
    nodes = cut(points.filter("x IS NOT NULL AND y IS NOT NULL").select("graph_id", "node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    size = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("extent"))
    own = nodes.groupBy("graph_id", "x", "y").agg(F.slice(F.array_sort(F.collect_list("node")), 1, k + 1).alias("nodes"))
    places = cut(own.join(size, "graph_id").select("graph_id", "x", "y", "nodes", "n", "extent", (F.col("extent") * F.sqrt(F.lit(float(k)) / F.col("n"))).alias("cell")))
    at = lambda c, w: F.floor(F.col(c) / (F.col("cell") * w))
    width = 1.0
    for _ in range(40):
        fullest = places.groupBy("graph_id", at("x", width).alias("ci"), at("y", width).alias("cj")).count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= _CELL_PLACES:
            break
        width /= 2
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    kind = f"array<struct<d:double,node:{points.schema['node'].dataType.simpleString()}>>"
    nearest = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    wanted, found, keys = places, [], ["graph_id", "x", "y"]
    while True:
        asked = wanted.select(*keys, "cell", around.alias("_o")).select(*keys, (at("x", width) + F.col("_o.a")).alias("ci"), (at("y", width) + F.col("_o.b")).alias("cj"))
        tasks = 1 + asked.count() // _CELL_ROWS
        held = places.groupBy("graph_id", at("x", width).alias("ci"), at("y", width).alias("cj")).agg(F.collect_list(F.struct("x", "y", "nodes")).alias("held"))
        square = lambda p: (F.col("x") - p["x"]) * (F.col("x") - p["x"]) + (F.col("y") - p["y"]) * (F.col("y") - p["y"])
        one = lambda p: F.transform(p["nodes"], lambda n: F.struct(F.sqrt(square(p)).alias("d"), n.alias("node")))
        seen = asked.repartition(tasks, "graph_id", "ci", "cj").hint("merge").join(held, ["graph_id", "ci", "cj"]).select(*keys, nearest(F.flatten(F.transform("held", one))).cast(kind).alias("near"))
        best = seen.groupBy(*keys).agg(nearest(F.flatten(F.collect_list("near"))).alias("near"))
        whole = F.size("near") >= F.least(F.lit(k + 1), F.col("n"))
        sure = (F.element_at("near", -1)["d"] <= F.col("cell") * width) | (F.col("cell") * width >= F.col("extent"))
        state = cut(wanted.join(best, keys).withColumn("done", whole & sure))
        found.append(state.filter("done").select(*keys, "near"))
        wanted = state.filter("NOT done").select(*places.columns)
        if wanted.isEmpty():
            break
        width *= 2
    near = reduce(DataFrame.unionByName, found)
    others = F.explode(F.slice(F.filter("near", lambda e: e["node"] != F.col("node")), 1, k)).alias("e")
    edges = cut(nodes.join(near, keys).select("graph_id", "node", others).select("graph_id", F.col("node").alias("src"), F.col("e.node").alias("dst"), F.col("e.d").alias("d")))
    return edges if threshold is None else edges.filter(F.col("d") <= threshold)


def adjacency(pixels: DataFrame) -> DataFrame:
    """(graph_id, src, dst), both ways: labels with pixels that touch, diagonals included. Background 0 has no node."""
    own = pixels.filter("label <> 0").select("graph_id", "i", "j", "label")
    beside = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    sent = own.withColumn("_o", beside).select("graph_id", (F.col("i") + F.col("_o.a")).alias("i"), (F.col("j") + F.col("_o.b")).alias("j"), F.col("label").alias("other"))
    pairs = own.join(sent, ["graph_id", "i", "j"]).filter("label <> other").select("graph_id", F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).distinct()
    return pairs.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(pairs.select("graph_id", F.col("b").alias("src"), F.col("a").alias("dst")))


def two_hop(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """The edges and, after them, those between different ends of two edges; with ``distinct`` each once."""
    second = edges.select("graph_id", F.col("src").alias("mid"), F.col("dst").alias("end"))
    far = edges.select("graph_id", "src", F.col("dst").alias("mid")).join(second, ["graph_id", "mid"]).filter("src <> end").select("graph_id", "src", F.col("end").alias("dst"))
    return edges.select("graph_id", "src", "dst").unionAll(far.distinct() if distinct else far)


def assign(cells: DataFrame, tissue: DataFrame) -> DataFrame:
    """(graph_id, cell, tissue): the label under each cell's centroid (cy, cx); null on background."""
    at = tissue.filter("label <> 0").select("graph_id", F.col("i").alias("cy"), F.col("j").alias("cx"), F.col("label").alias("tissue"))
    return cells.join(at, ["graph_id", "cy", "cx"], "left").select("graph_id", "cell", "tissue")


def centroids(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(graph_id, node, cx, cy, nx, ny): centroids rounded half to even, and as shares of the image's size."""
    mean = pixels.filter("label <> 0").groupBy("graph_id", F.col("label").alias("node")).agg(F.rint(F.avg("j")).cast("long").alias("cx"), F.rint(F.avg("i")).cast("long").alias("cy"))
    return mean.select("*", (F.col("cx") / width).alias("nx"), (F.col("cy") / height).alias("ny"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    pairs = undirected(edges)
    return pairs.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(pairs.select("graph_id", F.col("b").alias("src"), F.col("a").alias("dst")))


def triangles(edges: DataFrame) -> DataFrame:
    """(graph_id, triangles): each counted once, at its node of least degree.

    Every edge points to the end of greater degree, so a node has at most as many edges out as the
    square root of twice the number of edges, and a hub makes no pairs of its neighbours.
    """
    p = undirected(edges)
    degree = p.select("graph_id", F.explode(F.array("a", "b")).alias("node")).groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("d"))
    of = lambda c: degree.select("graph_id", F.col("node").alias(c), F.struct("d", F.col("node").alias("n")).alias(f"o{c}"))
    up = p.join(of("a"), ["graph_id", "a"]).join(of("b"), ["graph_id", "b"])
    out = up.select("graph_id", F.least("oa", "ob").alias("x"), F.greatest("oa", "ob").alias("y"))
    wedge = out.join(out.select("graph_id", "x", F.col("y").alias("z")), ["graph_id", "x"]).filter("y < z").select("graph_id", F.col("y").alias("x"), F.col("z").alias("y"))
    closed = wedge.join(out, ["graph_id", "x", "y"])
    return closed.groupBy("graph_id").agg(F.count(F.lit(1)).alias("triangles"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, nodes, edges, density, transitivity, assortativity) of the undirected graphs."""
    both = symmetric(edges)
    degree = both.groupBy("graph_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    ends = both.join(degree.select("graph_id", F.col("node").alias("src"), F.col("d").alias("d1")), ["graph_id", "src"]).join(degree.select("graph_id", F.col("node").alias("dst"), F.col("d").alias("d2")), ["graph_id", "dst"])
    n, e = F.count("d1"), F.sum(F.col("d1").cast("double"))
    s1, s2, s12 = F.sum(F.col("d1").cast("double")), F.sum(F.col("d1").cast("double") * F.col("d1")), F.sum(F.col("d1").cast("double") * F.col("d2"))
    mix = ends.groupBy("graph_id").agg(F.try_divide(n * s12 - e * s1, n * s2 - s1 * s1).alias("assortativity"))
    paths = degree.groupBy("graph_id").agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("paths"), (F.sum("d") / 2).cast("long").alias("edges"))
    count = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    joined = count.join(paths, "graph_id", "left").join(triangles(edges), "graph_id", "left").join(mix, "graph_id", "left")
    return joined.select(
        "graph_id",
        "nodes",
        F.coalesce("edges", F.lit(0)).alias("edges"),
        F.coalesce(F.try_divide(2.0 * F.col("edges"), (F.col("nodes") * (F.col("nodes") - 1)).cast("double")), F.lit(0.0)).alias("density"),
        F.coalesce(F.try_divide(3.0 * F.coalesce("triangles", F.lit(0)), F.col("paths")), F.lit(0.0)).alias("transitivity"),
        "assortativity",
    )


def _settled(state: DataFrame, tolerance: float | None, *values: str) -> bool:
    """Whether no value differs from the one of the round before (``_old``, or the name after it) by more than ``tolerance``."""
    if tolerance is None:
        return False
    old = ["_old"] if len(values) == 1 else [f"_old_{v}" for v in values]
    change = F.greatest(*(F.max(F.abs(F.col(v) - F.col(o))) for v, o in zip(values, old, strict=True))) if len(values) > 1 else F.max(F.abs(F.col(values[0]) - F.col("_old")))
    return (state.agg(change).first()[0] or 0.0) <= tolerance


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(graph_id, node, rank) after ``rounds`` steps from equal ranks; nodes without out-edges share with all.

    With a ``tolerance`` the steps end early, once no rank changes by more.
    """
    out = edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    size = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    state = cut(nodes.select("graph_id", "node").join(size, "graph_id").join(out, ["graph_id", "node"], "left").withColumn("rank", 1.0 / F.col("n")))
    for _ in range(rounds):
        flow = edges.join(state.select("graph_id", F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("f")), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node")).agg(F.sum("f").alias("f"))
        lost = state.groupBy("graph_id").agg(F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(0.0)).alias("lost"))
        joined = state.join(flow, ["graph_id", "node"], "left").join(lost, "graph_id")
        rank = (1 - damping) / F.col("n") + damping * (F.coalesce("f", F.lit(0.0)) + F.col("lost") / F.col("n"))
        state = cut(joined.select("graph_id", "node", "n", "out", rank.alias("rank"), F.col("rank").alias("_old")), state)
        if _settled(state, tolerance, "rank"):
            break
    return state.select("graph_id", "node", "rank")


def hits(edges: DataFrame, rounds: int, tolerance: float | None = None) -> DataFrame:
    """(graph_id, node, hub, authority), each summing to 1 in a graph, after ``rounds`` steps, or once none changes by more than ``tolerance``."""
    ends = edges.select("graph_id", F.col("src").alias("node")).unionAll(edges.select("graph_id", F.col("dst").alias("node"))).distinct()
    state = cut(ends.withColumn("hub", F.lit(1.0)).withColumn("authority", F.lit(1.0)))

    def step(state: DataFrame, given: str, to: str, taken: str, end: str) -> DataFrame:
        sums = edges.join(state.select("graph_id", F.col("node").alias(end), F.col(given).alias("_s")), ["graph_id", end]).groupBy("graph_id", F.col(to).alias("node")).agg(F.sum("_s").alias("_n"))
        total = sums.groupBy("graph_id").agg(F.sum("_n").alias("_t"))
        kept = [c for c in state.columns if c != taken]
        return state.select(*kept).join(sums, ["graph_id", "node"], "left").join(total, "graph_id").select(*kept, F.coalesce(F.try_divide(F.col("_n"), F.col("_t")), F.lit(0.0)).alias(taken))

    for _ in range(rounds):
        old = state.select("graph_id", "node", "hub", "authority", F.col("hub").alias("_old_hub"), F.col("authority").alias("_old_authority"))
        state = cut(step(step(old, "hub", "dst", "authority", "src"), "authority", "src", "hub", "dst"), state)
        if _settled(state, tolerance, "hub", "authority"):
            break
    return state.select("graph_id", "node", "hub", "authority")


def eigenvector(edges: DataFrame, rounds: int, tolerance: float | None = None) -> DataFrame:
    """(graph_id, node, centrality) of unit length after ``rounds`` steps of x + A x on the undirected graph, or once none changes by more than ``tolerance``."""
    both = cut(symmetric(edges))
    state = both.select("graph_id", F.col("src").alias("node")).distinct().withColumn("centrality", F.lit(1.0))
    for _ in range(rounds):
        sums = both.join(state.select("graph_id", F.col("node").alias("dst"), "centrality"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node")).agg(F.sum("centrality").alias("_s"))
        raw = state.join(sums, ["graph_id", "node"]).select("graph_id", "node", F.col("centrality").alias("_old"), (F.col("centrality") + F.col("_s")).alias("c"))
        norm = raw.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("_l"))
        state = cut(raw.join(norm, "graph_id").select("graph_id", "node", (F.col("c") / F.col("_l")).alias("centrality"), "_old"), state)
        if _settled(state, tolerance, "centrality"):
            break
    return state.drop("_old")


def coreness(edges: DataFrame) -> DataFrame:
    """(graph_id, node, core): from the degree down, each node takes the h-index of its neighbours' values until none changes."""
    both = cut(symmetric(edges))
    state = new = cut(both.groupBy("graph_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("core")))
    order = Window.partitionBy("graph_id", "src").orderBy(F.col("core").desc())
    while True:
        seen = both.join(state.select("graph_id", F.col("node").alias("dst"), "core"), ["graph_id", "dst"])
        index = seen.withColumn("_r", F.row_number().over(order)).groupBy("graph_id", F.col("src").alias("node")).agg(F.max(F.least(F.col("_r").cast("long"), F.col("core"))).alias("h"))
        new = cut(state.join(index, ["graph_id", "node"]).select("graph_id", "node", F.least("core", "h").alias("core"), F.col("core").alias("_old")), new)
        state = new.select("graph_id", "node", "core")
        if new.filter("core <> _old").isEmpty():
            return state


def constraint(edges: DataFrame) -> DataFrame:
    """(graph_id, node, constraint): how far a node's neighbours are tied to each other (equal weights)."""
    both = symmetric(edges)
    degree = both.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("d"))
    share = both.join(degree, ["graph_id", "src"]).select("graph_id", "src", "dst", (1.0 / F.col("d")).alias("p"))
    indirect = share.select("graph_id", "src", F.col("dst").alias("mid"), "p").join(share.select("graph_id", F.col("src").alias("mid"), "dst", F.col("p").alias("q")), ["graph_id", "mid"])
    via = indirect.filter("src <> dst").groupBy("graph_id", "src", "dst").agg(F.sum(F.col("p") * F.col("q")).alias("via"))
    tied = share.join(via, ["graph_id", "src", "dst"], "left").withColumn("t", F.col("p") + F.coalesce("via", F.lit(0.0)))
    return tied.groupBy("graph_id", F.col("src").alias("node")).agg(F.sum(F.col("t") * F.col("t")).alias("constraint"))


#: Words of 64 bits in which the sources of a block are kept, and blocks that are searched from at a time.
_SEARCH_WORDS, _SEARCH_BLOCKS = 16, 8
#: Edges, both ways, of a graph that a task may hold to search it from some of its nodes, and those nodes.
_SEARCH_EDGES, _SEARCH_SOURCES = 1 << 21, 4096


def eccentricities(edges: DataFrame, words: int = _SEARCH_WORDS, at_once: int = _SEARCH_BLOCKS, most: int = _SEARCH_EDGES, sources: int = _SEARCH_SOURCES) -> DataFrame:
    """(graph_id, node, eccentricity) in each connected part, by breadth-first search from many nodes at once.

    Every node must be searched from. The searches of a graph of at most ``most`` edges (both ways) are
    dealt over tasks by ``sources`` nodes; each holds which nodes are neighbours, and bits for one block of
    sources at a time. Larger graphs are searched by joins: their nodes are dealt into blocks of 64 times
    ``words`` sources, and ``at_once`` blocks are searched from together.
    """
    both = cut(symmetric(edges))
    number = F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1
    degree = both.groupBy("graph_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_d"))
    numbered = cut(degree.withColumn("_k", number.cast("long")))
    sizes = cut(numbered.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("_d").alias("_m")))
    small, large = sizes.filter(F.col("_m") <= most), sizes.filter(F.col("_m") > most).select("graph_id")
    found = _searched_in_tasks(both, numbered, small, sources)
    if large.isEmpty():
        return found
    of = lambda df: df.join(large, "graph_id", "left_semi")
    return found.unionAll(_searched_by_joins(of(both), cut(of(numbered).drop("_d")), words, at_once))


def _searched_in_tasks(both: DataFrame, numbered: DataFrame, sizes: DataFrame, sources: int) -> DataFrame:
    """Eccentricities of graphs whose edges fit a task: one task for each graph and ``sources`` of its nodes."""
    shares = F.ceil(F.col("_n") / sources).cast("int")
    tasks = sizes.agg(F.sum(shares)).first()[0] or 1
    to = numbered.join(sizes.select("graph_id"), "graph_id").select("graph_id", F.col("node").alias("dst"), F.col("_k").cast("int").alias("_to"))
    near = both.join(to, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node")).agg(F.collect_list("_to").alias("near"))
    rows = numbered.join(near, ["graph_id", "node"]).join(sizes.select("graph_id", shares.alias("_of")), "graph_id").select("graph_id", F.col("_k").cast("int").alias("_k"), "near", "_of")
    dealt = rows.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).repartition(tasks, "graph_id", "_share")
    kind = both.schema["graph_id"].dataType.simpleString()

    def search(graph: pa.Table) -> pa.Table:
        near = graph.column("near").combine_chunks().take(pa.array(np.argsort(graph.column("_k").to_numpy())))
        ptr, near = near.offsets.to_numpy().astype(np.int64), near.values.to_numpy()
        order, share, of = breadth.blocks(ptr, near), graph.column("_share")[0].as_py(), graph.column("_of")[0].as_py()
        mine = order[len(order) * share // of : len(order) * (share + 1) // of]
        named = pa.array([graph.column("graph_id")[0].as_py()] * len(mine), graph.schema.field("graph_id").type)
        return pa.table([named, pa.array(mine), pa.array(breadth.farthest(ptr, near, mine).astype(np.int32))], ["graph_id", "_k", "eccentricity"])

    searched = dealt.groupBy("graph_id", "_share").applyInArrow(search, f"graph_id {kind}, _k long, eccentricity int")
    return numbered.select("graph_id", "node", "_k").join(cut(searched), ["graph_id", "_k"]).select("graph_id", "node", "eccentricity")


def _searched_by_joins(both: DataFrame, numbered: DataFrame, words: int, at_once: int) -> DataFrame:
    """Eccentricities of graphs of any size, whose rows are nowhere together.

    For each node and block there is one row, whose bits say from which of the block's sources the node
    has been reached; a round joins the rows that changed with the edges and takes the union of what
    arrives. As paths lead both ways, a node's eccentricity is the last round in which one of its rows
    changed. The rows of a search are at most ``at_once`` times the nodes.
    """
    bits, size = [f"_b{w}" for w in range(words)], 64 * words
    highest = numbered.agg(F.max("_k")).first()[0]
    keys, found = ["graph_id", "node", "_block"], []
    for low in range(0, highest // size + 1, at_once):
        own = numbered.withColumn("_block", F.floor(F.col("_k") / size)).filter(F.col("_block").between(low, low + at_once - 1))
        first = [F.when(F.floor(F.col("_k") % size / 64) == w, F.expr("shiftleft(1L, cast(_k % 64 AS int))")).otherwise(F.lit(0).cast("long")).alias(b) for w, b in enumerate(bits)]
        state, hops = cut(own.select(*keys, *first, F.lit(0).alias("last"))), 0
        while True:
            front = state.filter(F.col("last") == hops)
            hops += 1
            sent = front.select("graph_id", F.col("node").alias("src"), "_block", *bits).join(both, ["graph_id", "src"])
            met = sent.groupBy("graph_id", F.col("dst").alias("node"), "_block").agg(*(F.bit_or(b).alias(f"_n{b}") for b in bits))
            held = lambda b: F.coalesce(b, F.lit(0).cast("long"))
            joined = state.join(met, keys, "full_outer")
            changed = reduce(lambda x, y: x | y, (held(b).bitwiseOR(held(f"_n{b}")) != held(b) for b in bits))
            new = joined.select(*keys, *(held(b).bitwiseOR(held(f"_n{b}")).alias(b) for b in bits), F.when(changed, hops).otherwise(F.col("last")).alias("last"))
            state = cut(new, state)
            if state.filter(F.col("last") == hops).isEmpty():
                break
        found.append(state.groupBy("graph_id", "node").agg(F.max("last").alias("last")))
    return reduce(DataFrame.unionAll, found).groupBy("graph_id", "node").agg(F.max("last").alias("eccentricity"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b, w): the minimum spanning forest of undirected edges (graph_id, src, dst, w), node ids kept.

    Boruvka's rounds: each component picks its lightest edge to another one, with (w, a, b) as the
    total order, and the picked edges merge components.
    """
    w = F.min("w").alias("w")
    edges = cut(edges.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w").filter("a <> b").groupBy("graph_id", "a", "b").agg(w))
    parts = edges.select("graph_id", F.col("a").alias("node")).unionAll(edges.select("graph_id", F.col("b").alias("node"))).distinct()
    part = cut(parts.withColumn("part", F.col("node")))
    chosen: list[DataFrame] = []
    while True:
        side = lambda c: part.select("graph_id", F.col("node").alias(c), F.col("part").alias(f"p{c}"))
        open_edges = edges.join(side("a"), ["graph_id", "a"]).join(side("b"), ["graph_id", "b"]).filter("pa <> pb")
        each = open_edges.select("*", F.explode(F.array(F.struct(F.col("pa").alias("p"), F.col("pb").alias("q")), F.struct(F.col("pb").alias("p"), F.col("pa").alias("q")))).alias("s"))
        picked = cut(each.groupBy("graph_id", F.col("s.p").alias("p")).agg(F.min(F.struct("w", "a", "b", "s.q")).alias("e")).select("graph_id", "p", "e.*"))
        if picked.isEmpty():
            break
        chosen.append(picked.select("graph_id", "a", "b", "w").distinct())
        # Two components may pick the same edge; the smaller is the root then. All others point on, and
        # following the pointers of pointers reaches the root in a number of rounds that is a logarithm.
        back = picked.select("graph_id", F.col("p").alias("q"), F.col("q").alias("back"))
        roots = cut(picked.join(back, ["graph_id", "q"], "left").select("graph_id", "p", F.when((F.col("back") == F.col("p")) & (F.col("p") < F.col("q")), F.col("p")).otherwise(F.col("q")).alias("root")))
        changed = True
        while changed:
            far = roots.select("graph_id", F.col("p").alias("root"), F.col("root").alias("far"))
            roots = cut(roots.select("graph_id", "p", "root").join(far, ["graph_id", "root"]).select("graph_id", "p", F.col("far").alias("root"), F.col("root").alias("old")), roots)
            changed = not roots.filter("root <> old").isEmpty()
        part = cut(part.join(roots.select("graph_id", F.col("p").alias("part"), "root"), ["graph_id", "part"], "left").select("graph_id", "node", F.coalesce("root", "part").alias("part")), part)
    return reduce(DataFrame.unionByName, chosen) if chosen else edges.limit(0)


def batch(graphs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all graphs as one: nodes numbered on from graph to graph, edges with the new numbers.

    Graphs go by id and nodes by theirs. Numbers count within graphs first and then add the sizes of the
    graphs before, of which there is one row a graph.
    """
    sizes = graphs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("graph_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("graph_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1 + F.col("start")
    nodes = graphs.join(starts, "graph_id").withColumn("number", number.cast("long")).drop("start")
    of = lambda c: nodes.select("graph_id", F.col("node").alias(c), F.col("number").alias(f"_{c}"))
    moved = edges.join(of("src"), ["graph_id", "src"]).join(of("dst"), ["graph_id", "dst"]).select("graph_id", F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    return nodes, moved


def build(nodes: DataFrame, edges: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, features..., degree, target): the nodes of graphs with how many edges end there, and the graph's target."""
    degree = edges.groupBy("graph_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    out = nodes.join(degree, ["graph_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out if target is None else out.join(target, "graph_id", "left")


#: The seven node values that graph features are statistics of, and the statistics.
NODE_VALUES = ("hubs", "authorities", "constraint", "coreness", "egvec_centr", "degree", "personalized_pgrank")
STATISTICS = ("mean", "median", "max", "min", "sum", "std")


def features(nodes: DataFrame, edges: DataFrame, rounds: int = 100, tolerance: float | None = 1e-9, alpha: float = 0.85) -> DataFrame:
    """(graph_id, 47 features): five numbers of each undirected graph and six statistics of seven node values.

    Hubs, authorities, eigenvector centrality and ranks are stepped until they settle. Diameter and
    radius are those of the connected parts.
    """
    both = cut(symmetric(edges))
    ecc = eccentricities(both).groupBy("graph_id").agg(F.max("eccentricity").alias("diameter"), F.min("eccentricity").alias("radius"))
    stats = graph_stats(nodes, both).select("graph_id", F.col("assortativity").alias("assortativity_degree"), "density", F.col("transitivity").alias("transitivity_undir"))
    scores = hits(both, rounds, tolerance)
    degree = both.groupBy("graph_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    values = [
        scores.select("graph_id", "node", F.col("hub").alias("hubs"), F.col("authority").alias("authorities")),
        constraint(both),
        coreness(both).withColumnRenamed("core", "coreness"),
        eigenvector(both, rounds, tolerance).withColumnRenamed("centrality", "egvec_centr"),
        degree,
        pagerank(nodes, both, rounds, alpha, tolerance).withColumnRenamed("rank", "personalized_pgrank"),
    ]
    joined = reduce(lambda a, b: a.join(b, ["graph_id", "node"], "left"), values, nodes.select("graph_id", "node"))
    of = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_pop}
    summary = joined.groupBy("graph_id").agg(*(of[s](v).alias(f"{v}_{s}") for v in NODE_VALUES for s in STATISTICS))
    return ecc.join(stats, "graph_id").join(summary, "graph_id")


def cell_patches(instances: DataFrame, keys: tuple[str, ...], size: int, least: int) -> DataFrame:
    """(keys, label, y, x, overlap): a patch around each instance's centre that holds at least ``least`` of its pixels."""
    own = instances.filter("label <> 0")
    corner = lambda c: (F.floor(F.avg(c)).cast("int") - size // 2)
    at = own.groupBy(*keys, "label").agg(corner("i").alias("y"), corner("j").alias("x"))
    return _overlaps(own, at, keys, size).filter(F.col("overlap") >= least)


def tissue_patches(instances: DataFrame, keys: tuple[str, ...], size: int, least: int) -> DataFrame:
    """(keys, label, y, x, overlap): a lattice of patches over each instance's box that hold more than ``least`` of its pixels.

    The lattice steps by a patch's side from the rounded centre towards the box's sides; places name
    the patches' centres' upper left corners.
    """
    own = instances.filter("label <> 0")
    box = own.groupBy(*keys, "label").agg(*(f(c).alias(f"{n}{c}") for c in "ij" for n, f in (("c", lambda c: F.rint(F.avg(c)).cast("int")), ("low", F.min), ("high", lambda c: F.max(c) + 1))))
    line = lambda c: F.sequence(F.col(f"c{c}") - F.floor((F.col(f"c{c}") - F.col(f"low{c}")) / size).cast("int") * size, F.col(f"c{c}") + F.floor((F.col(f"high{c}") - F.col(f"c{c}")) / size).cast("int") * size, F.lit(size))
    at = box.withColumn("y", F.explode(line("i"))).withColumn("x", F.explode(line("j"))).select(*keys, "label", (F.col("y") - size // 2).alias("y"), (F.col("x") - size // 2).alias("x"))
    return _overlaps(own, at, keys, size).filter(F.col("overlap") > least)


def _overlaps(own: DataFrame, at: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """How many pixels of its instance each patch holds, by the cells of ``size`` that both meet."""
    near = lambda c, over: F.explode(F.sequence(F.floor(F.col(c) / size), F.floor((F.col(c) + over) / size)))
    patches = at.withColumn("_a", near("y", size - 1)).withColumn("_b", near("x", size - 1))
    cells = own.select(*keys, "label", "i", "j", F.floor(F.col("i") / size).alias("_a"), F.floor(F.col("j") / size).alias("_b"))
    inside = F.col("i").between(F.col("y"), F.col("y") + size - 1) & F.col("j").between(F.col("x"), F.col("x") + size - 1)
    return cells.join(patches, [*keys, "label", "_a", "_b"]).filter(inside).groupBy(*keys, "label", "y", "x").agg(F.count(F.lit(1)).alias("overlap"))
