"""SQL texts for queries that work in rounds: recursive CTEs, or one CTE a round."""

from __future__ import annotations

from tesselon.plans import tables as T

#: Undirected edges both ways (s) and degrees (deg) of the nearest-neighbour graph.
UNDIRECTED = f"""{T.KNN}, p AS (SELECT DISTINCT graph_id, least(src, dst) AS a, greatest(src, dst) AS b FROM knn),
s AS (SELECT graph_id, a AS src, b AS dst FROM p UNION ALL SELECT graph_id, b, a FROM p), deg AS (SELECT graph_id, src AS node, count(*)::BIGINT AS d FROM s GROUP BY ALL)"""


def regions(name: str, mask: str, eight: bool = True) -> str:
    """CTE ``name`` (vec_id, k, root): connected regions of the pixels k = 8 i + j that ``mask`` selects."""
    near = "abs(m.k // 8 - r.k // 8) <= 1 AND abs(m.k % 8 - r.k % 8) <= 1" if eight else "abs(m.k // 8 - r.k // 8) + abs(m.k % 8 - r.k % 8) = 1"
    return f"""{name}_m AS ({mask}), {name}_r AS (SELECT vec_id, k, k AS root FROM {name}_m UNION SELECT m.vec_id, m.k, r.root FROM {name}_r r JOIN {name}_m m ON m.vec_id = r.vec_id AND {near}),
{name} AS (SELECT vec_id, k, min(root) AS root FROM {name}_r GROUP BY vec_id, k)"""


def filled(name: str, mask: str, most: int) -> str:
    """CTE ``name`` (vec_id, k): the mask of 8 by 8 tiles with holes of at most ``most`` pixels filled."""
    outside = f"SELECT vec_id, i * 8 + j AS k FROM px WHERE (vec_id, i * 8 + j) NOT IN (SELECT vec_id, k FROM ({mask}))"
    return f"""{regions(name + "_b", outside, eight=False)}, {name}_h AS (SELECT vec_id, root FROM {name}_b GROUP BY ALL HAVING count(*) <= {most} AND NOT bool_or(k // 8 IN (0, 7) OR k % 8 IN (0, 7))),
{name} AS (SELECT vec_id, k FROM ({mask}) UNION ALL SELECT vec_id, k FROM {name}_b JOIN {name}_h USING (vec_id, root))"""


def foreground(name: str, mask: str, least: int, most: int) -> str:
    """CTE ``name`` (vec_id, k): regions of at least ``least`` pixels, then small holes filled."""
    large = f"SELECT vec_id, k FROM {name}_f JOIN (SELECT vec_id, root FROM {name}_f GROUP BY ALL HAVING count(*) >= {least}) USING (vec_id, root)"
    return f"""{regions(name + "_f", mask)}, {filled(name, large, most)}"""


def as_pixels(name: str) -> str:
    return f"SELECT vec_id, (k // 8)::INT AS i, (k % 8)::INT AS j FROM {name}"


def hits_ctes(rounds: int, edges: str = "knn") -> str:
    """CTEs up to ``h{rounds}`` (graph_id, node, hub) and ``a{rounds}`` (graph_id, node, authority)."""

    def step(k: int, given: str, to: str, end: str, of: str) -> str:
        return f"""(SELECT n.graph_id, n.node, coalesce(q / sum(q) OVER (PARTITION BY n.graph_id), 0) AS {of} FROM nodes n LEFT JOIN
  (SELECT k.graph_id, k.{to} AS node, sum(x.{given}) AS q FROM {edges} k JOIN {"h" if given == "hub" else "a"}{k} x ON x.graph_id = k.graph_id AND x.node = k.{end} GROUP BY ALL) USING (graph_id, node))"""

    parts = [f"nodes AS (SELECT graph_id, src AS node FROM {edges} UNION SELECT graph_id, dst FROM {edges}), h0 AS (SELECT *, 1.0::DOUBLE AS hub FROM nodes)"]
    for k in range(rounds):
        parts += [f"a{k + 1} AS MATERIALIZED {step(k, 'hub', 'dst', 'src', 'authority')}", f"h{k + 1} AS MATERIALIZED {step(k + 1, 'authority', 'src', 'dst', 'hub')}"]
    return ", ".join(parts)


def hits(rounds: int) -> str:
    return f"WITH {T.KNN}, {hits_ctes(rounds)} SELECT graph_id, node, round(hub, 6) AS hub, round(authority, 6) AS authority FROM h{rounds} JOIN a{rounds} USING (graph_id, node)"


def eigenvector_ctes(rounds: int) -> str:
    parts = ["e0 AS (SELECT graph_id, node, 1.0::DOUBLE AS c FROM deg)"]
    for k in range(rounds):
        parts.append(
            f"""e{k + 1} AS MATERIALIZED (SELECT graph_id, node, x / sqrt(sum(x * x) OVER (PARTITION BY graph_id)) AS c FROM
  (SELECT e.graph_id, e.node, e.c + sum(o.c) AS x FROM e{k} e JOIN s ON s.graph_id = e.graph_id AND s.src = e.node JOIN e{k} o ON o.graph_id = s.graph_id AND o.node = s.dst GROUP BY e.graph_id, e.node, e.c))"""
        )
    return ", ".join(parts)


def eigenvector(rounds: int) -> str:
    return f"WITH {UNDIRECTED}, {eigenvector_ctes(rounds)} SELECT graph_id, node, round(c, 6) AS centrality FROM e{rounds}"


def pagerank_ctes(rounds: int, edges: str = "knn") -> str:
    """CTEs up to ``r{rounds}`` (graph_id, node, r) for graphs in which every node has an edge out."""
    parts = [f"n AS (SELECT graph_id, count(*)::DOUBLE AS n FROM pts GROUP BY 1), o AS (SELECT graph_id, src, count(*)::DOUBLE AS o FROM {edges} GROUP BY ALL), r0 AS (SELECT graph_id, node, 1 / n AS r FROM pts JOIN n USING (graph_id))"]
    for k in range(rounds):
        parts.append(
            f"f{k} AS MATERIALIZED (SELECT k.graph_id, k.dst AS node, sum(r / o) AS f FROM {edges} k JOIN r{k} ON r{k}.graph_id = k.graph_id AND r{k}.node = k.src JOIN o ON o.graph_id = k.graph_id AND o.src = k.src GROUP BY ALL), "
            f"r{k + 1} AS MATERIALIZED (SELECT p.graph_id, p.node, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(f, 0) AS r FROM pts p JOIN n USING (graph_id) LEFT JOIN f{k} ON f{k}.graph_id = p.graph_id AND f{k}.node = p.node)"
        )
    return ", ".join(parts)


CONSTRAINT = """ct AS (SELECT s.graph_id, s.src, s.dst, 1.0::DOUBLE / d AS p FROM s JOIN deg ON deg.graph_id = s.graph_id AND deg.node = s.src),
cv AS (SELECT a.graph_id, a.src, b.dst, sum(a.p * b.p) AS v FROM ct a JOIN ct b ON a.graph_id = b.graph_id AND a.dst = b.src WHERE a.src <> b.dst GROUP BY ALL),
tied AS (SELECT ct.graph_id, ct.src AS node, sum((p + coalesce(v, 0)) * (p + coalesce(v, 0))) AS tie FROM ct LEFT JOIN cv ON cv.graph_id = ct.graph_id AND cv.src = ct.src AND cv.dst = ct.dst GROUP BY ALL)"""
_CORE = """core_r AS (SELECT graph_id, node, d AS core, 0 AS k FROM deg UNION ALL
  SELECT graph_id, node, least(core, max(least(place, other))), k + 1 FROM (
    SELECT r.graph_id, r.node, r.core, r.k, o.core AS other, row_number() OVER (PARTITION BY r.graph_id, r.node ORDER BY o.core DESC) AS place
    FROM core_r r JOIN s ON s.graph_id = r.graph_id AND s.src = r.node JOIN core_r o ON o.graph_id = s.graph_id AND o.node = s.dst) WHERE k < 40 GROUP BY graph_id, node, core, k)"""
_REACH = """reach AS (SELECT DISTINCT graph_id, src AS node, src AS place, 0 AS hops FROM s UNION
  SELECT r.graph_id, r.node, s.dst, hops + 1 FROM reach r JOIN s ON s.graph_id = r.graph_id AND s.src = r.place WHERE hops < 40),
far AS (SELECT graph_id, node, max(hops) AS e FROM (SELECT graph_id, node, place, min(hops) AS hops FROM reach GROUP BY ALL) GROUP BY ALL)"""
CORENESS = f"WITH RECURSIVE {UNDIRECTED}, {_CORE} SELECT graph_id, node, core::BIGINT AS core FROM core_r WHERE k = 40"
ECCENTRICITY = f"WITH RECURSIVE {UNDIRECTED}, {_REACH} SELECT graph_id, node, e::INT AS eccentricity FROM far"


def features(rounds: int) -> str:
    of = {"hubs": "hub", "authorities": "authority", "constraint": "tie", "coreness": "core", "egvec_centr": "c", "degree": "d", "personalized_pgrank": "r"}
    how = {"mean": "avg", "median": "median", "max": "max", "min": "min", "sum": "sum", "std": "stddev_pop"}
    stats = ", ".join(f"round({f}({c})::DOUBLE, 5) AS {v}_{n}" for v, c in of.items() for n, f in how.items())
    return f"""WITH RECURSIVE {UNDIRECTED}, {hits_ctes(rounds, "s")}, {eigenvector_ctes(rounds)}, {pagerank_ctes(rounds, "s")}, {CONSTRAINT}, {_CORE}, {_REACH},
val AS (SELECT * FROM deg JOIN h{rounds} USING (graph_id, node) JOIN a{rounds} USING (graph_id, node) JOIN e{rounds} USING (graph_id, node) JOIN r{rounds} USING (graph_id, node) JOIN tied USING (graph_id, node)
  JOIN (SELECT graph_id, node, core FROM core_r WHERE k = 40) USING (graph_id, node)),
tri AS (SELECT x.graph_id, count(*) AS t FROM p x JOIN p y ON x.graph_id = y.graph_id AND x.b = y.a JOIN p z ON z.graph_id = x.graph_id AND z.a = x.a AND z.b = y.b GROUP BY 1),
wedge AS (SELECT graph_id, sum(d * (d - 1) / 2) AS w, sum(d) / 2 AS edges FROM deg GROUP BY 1),
mix AS (SELECT s.graph_id, corr(x.d, y.d) AS m FROM s JOIN deg x ON x.graph_id = s.graph_id AND x.node = s.src JOIN deg y ON y.graph_id = s.graph_id AND y.node = s.dst GROUP BY 1),
ends AS (SELECT graph_id, max(e) AS diameter, min(e) AS radius FROM far GROUP BY 1), st AS (SELECT graph_id, {stats} FROM val GROUP BY 1)
SELECT graph_id, diameter::DOUBLE AS diameter, radius::DOUBLE AS radius, round(m, 5) AS assortativity_degree, round(2.0::DOUBLE * edges / (n * (n - 1)), 5) AS density, round(3.0::DOUBLE * coalesce(t, 0) / w, 5) AS transitivity_undir, st.* EXCLUDE (graph_id)
FROM st JOIN ends USING (graph_id) JOIN mix USING (graph_id) JOIN wedge USING (graph_id) JOIN n USING (graph_id) LEFT JOIN tri USING (graph_id)"""


#: An edge is in the forest unless lighter edges join its ends.
FOREST = f"""WITH RECURSIVE {T.KNN}, e AS (SELECT graph_id, least(src, dst) AS a, greatest(src, dst) AS b, min(d) AS w FROM knn GROUP BY ALL),
way AS (SELECT graph_id, a AS src, b AS dst, {{'w': w, 'a': a, 'b': b}} AS o FROM e UNION ALL SELECT graph_id, b, a, {{'w': w, 'a': a, 'b': b}} FROM e),
reach AS (SELECT graph_id, {{'w': w, 'a': a, 'b': b}} AS o, a AS node FROM e UNION SELECT r.graph_id, r.o, way.dst FROM reach r JOIN way ON way.graph_id = r.graph_id AND way.src = r.node AND way.o < r.o)
SELECT graph_id, a, b, round(w, 6) AS w FROM e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.graph_id = e.graph_id AND r.o = {{'w': e.w, 'a': e.a, 'b': e.b}} AND r.node = e.b)"""


def equalised(source: str, block: int, clip: float, bins: int) -> str:
    """CTEs up to ``equal`` (vec_id, i, j, cdf) from (vec_id, i, j, bin); ``clip`` is a multiple of a block's mean bin."""
    blocks = 8 // block
    return f"""eq_h AS (SELECT vec_id, i // {block} AS bi, j // {block} AS bj, bin AS b, count(*) AS n FROM {source} GROUP BY ALL),
every AS (SELECT vec_id, bi, bj, b, least(coalesce(n, 0), greatest(1.0::DOUBLE, {block * block}.0::DOUBLE / {bins} * {clip})) AS c
  FROM (SELECT vec_id FROM embeddings) CROSS JOIN range({blocks}) x(bi) CROSS JOIN range({blocks}) y(bj) CROSS JOIN range({bins}) z(b) LEFT JOIN eq_h USING (vec_id, bi, bj, b)),
curve AS (SELECT vec_id, bi, bj, b, (sum(c) OVER (PARTITION BY vec_id, bi, bj ORDER BY b) + (b + 1) * ({block * block} - sum(c) OVER (PARTITION BY vec_id, bi, bj)) / {bins}) / {block * block} AS y FROM every),
four AS (SELECT vec_id, i, j, y, (1 - abs((i + 0.5::DOUBLE) / {block} - 0.5 - bi)) * (1 - abs((j + 0.5::DOUBLE) / {block} - 0.5 - bj)) AS w FROM {source} JOIN curve USING (vec_id)
  WHERE b = bin AND bi - floor((i + 0.5::DOUBLE) / {block} - 0.5) BETWEEN 0 AND 1 AND bj - floor((j + 0.5::DOUBLE) / {block} - 0.5) BETWEEN 0 AND 1),
equal AS (SELECT vec_id, i, j, sum(y * w) / sum(w) AS cdf FROM four GROUP BY ALL)"""


def clahe(block: int, clip: float, bins: int) -> str:
    return f"WITH {T.PX}, binned AS (SELECT vec_id, i, j, v * {bins} // 256 AS bin FROM px), {equalised('binned', block, clip, bins)} SELECT vec_id, i, j, v, round(cdf, 6) AS cdf FROM px JOIN equal USING (vec_id, i, j)"


def flooded(heights: str, rounds: int = 64) -> str:
    """CTE ``flood`` (vec_id, i, j, s) after ``rounds`` rounds over (vec_id, i, j, h, marker); s holds cost, steps and marker in decimals."""
    return f"""flood_r AS (SELECT vec_id, i, j, h, CASE WHEN marker IS NOT NULL THEN h * 1000000 + marker END AS s, 0 AS n FROM ({heights}) UNION ALL
  SELECT vec_id, i, j, h, least(s, greatest(b // 1000000, h) * 1000000 + b % 1000000 + 1000), n + 1 FROM (
    SELECT p.vec_id, p.i, p.j, p.h, p.s, p.n, min(q.s) AS b FROM flood_r p CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(di, dj)
    LEFT JOIN flood_r q ON q.vec_id = p.vec_id AND q.i = p.i + di AND q.j = p.j + dj WHERE p.n < {rounds} GROUP BY ALL)),
flood AS (SELECT vec_id, i, j, s FROM flood_r WHERE n = {rounds} AND s IS NOT NULL)"""


WATERSHED = f"""WITH RECURSIVE {T.PX}, top AS (SELECT p.vec_id, p.i, p.j, max(q.v) AS m FROM px p JOIN px q ON q.vec_id = p.vec_id AND abs(q.i - p.i) <= 1 AND abs(q.j - p.j) <= 1 GROUP BY ALL),
{flooded("SELECT vec_id, i, j, 255 - v AS h, CASE WHEN v >= 130 AND v = m THEN i * 8 + j + 1 END AS marker FROM px JOIN top USING (vec_id, i, j)")}
SELECT vec_id, i, j, (s % 1000)::INT AS marker FROM flood"""


def superpixels(step: int, compactness: float, rounds: int) -> str:
    """CTEs up to ``l{rounds}`` (vec_id, i, j, v, li, lj)."""
    parts = [f"{T.PX}, c0 AS (SELECT vec_id, i // {step} AS li, j // {step} AS lj, avg(i) AS mi, avg(j) AS mj, avg(v) AS mv FROM px GROUP BY ALL)"]
    for k in range(rounds):
        parts.append(
            f"""l{k + 1} AS MATERIALIZED (SELECT vec_id, i, j, v, li, lj FROM (SELECT px.*, li, lj,
    row_number() OVER (PARTITION BY px.vec_id, i, j ORDER BY round((v - mv) * (v - mv) + ((i - mi) * (i - mi) + (j - mj) * (j - mj)) * {(compactness / step) ** 2}::DOUBLE, 6), li, lj) AS r
  FROM px JOIN c{k} c ON c.vec_id = px.vec_id AND abs(c.li - i // {step}) <= 1 AND abs(c.lj - j // {step}) <= 1) WHERE r = 1),
c{k + 1} AS MATERIALIZED (SELECT vec_id, li, lj, avg(i) AS mi, avg(j) AS mj, avg(v) AS mv FROM l{k + 1} GROUP BY ALL)"""
        )
    return ", ".join(parts)


def merged(step: int, compactness: float, rounds: int, threshold: float) -> str:
    return f"""WITH RECURSIVE {superpixels(step, compactness, rounds)}, px2 AS (SELECT vec_id, i, j, v, li || ':' || lj AS label FROM l{rounds}),
m AS (SELECT vec_id, label, avg(v) AS m FROM px2 GROUP BY ALL),
alike AS (SELECT DISTINCT p.vec_id, p.label, q.label AS other FROM px2 p JOIN px2 q ON q.vec_id = p.vec_id AND abs(q.i - p.i) + abs(q.j - p.j) = 1 AND p.label <> q.label
  JOIN m x ON x.vec_id = p.vec_id AND x.label = p.label JOIN m y ON y.vec_id = p.vec_id AND y.label = q.label WHERE abs(x.m - y.m) < {threshold}::DOUBLE),
reach AS (SELECT vec_id, label, label AS root FROM m UNION SELECT a.vec_id, a.other, r.root FROM reach r JOIN alike a ON a.vec_id = r.vec_id AND a.label = r.label)
SELECT vec_id, label, min(root) AS merged FROM reach GROUP BY ALL"""


def vahadane(rounds: int, penalty: float, start: tuple, beta: float) -> str:
    """Stain vectors of RGB strips by rounds of sparse amounts and vectors fitted to them."""
    axes = range(3)
    parts = [f"""WITH {T.RGB}, od AS (SELECT vec_id % 20 AS slide, {", ".join(f"-ln(({c} + 1) / 255.0::DOUBLE) AS x{k}" for k, c in enumerate("rgb"))} FROM rgb),
w0 AS (SELECT DISTINCT slide, {", ".join(f"{start[m][k]!r}::DOUBLE AS {n}{k}" for m, n in enumerate("he") for k in axes)} FROM od)"""]
    dot = lambda a, b: " + ".join(f"{a}{k} * {b}{k}" for k in axes)
    for t in range(rounds):
        unit = lambda n: f"sqrt({dot(n, n)})"
        parts.append(f"""b{t} AS (SELECT *, {dot("h", "x")} - {penalty}::DOUBLE AS p, {dot("e", "x")} - {penalty}::DOUBLE AS q, {dot("h", "e")} AS g FROM od JOIN w{t} USING (slide) WHERE {" AND ".join(f"x{k} > {beta}" for k in axes)}),
c{t} AS (SELECT *, (p - g * q) / (1 - g * g) AS u, (q - g * p) / (1 - g * g) AS v FROM b{t}),
d{t} AS (SELECT *, CASE WHEN u >= 0 AND v >= 0 THEN u WHEN p >= q THEN greatest(p, 0) ELSE 0 END AS ah, CASE WHEN u >= 0 AND v >= 0 THEN v WHEN p >= q THEN 0 ELSE greatest(q, 0) END AS ae FROM c{t}),
s{t} AS (SELECT slide, sum(ah * ah) AS hh, sum(ah * ae) AS he, sum(ae * ae) AS ee, {", ".join(f"sum(x{k} * a{n}) AS b{n}{k}" for n in "he" for k in axes)} FROM d{t} GROUP BY 1),
n{t} AS (SELECT slide, hh, he, ee, {", ".join(f"e{k}" for k in axes)}, {", ".join(f"be{k}" for k in axes)}, {", ".join(f"CASE WHEN hh > 0 THEN greatest((bh{k} - he * e{k}) / hh, 0) ELSE h{k} END AS h{k}" for k in axes)} FROM s{t} JOIN w{t} USING (slide)),
m{t} AS (SELECT slide, hh, he, ee, {", ".join(f"coalesce(h{k} / nullif({unit('h')}, 0), 0) AS h{k}" for k in axes)}, {", ".join(f"e{k}, be{k}" for k in axes)} FROM n{t}),
o{t} AS (SELECT slide, {", ".join(f"h{k}" for k in axes)}, {", ".join(f"CASE WHEN ee > 0 THEN greatest((be{k} - he * h{k}) / ee, 0) ELSE e{k} END AS e{k}" for k in axes)} FROM m{t}),
w{t + 1} AS MATERIALIZED (SELECT slide, {", ".join(f"h{k}" for k in axes)}, {", ".join(f"coalesce(e{k} / nullif({unit('e')}, 0), 0) AS e{k}" for k in axes)} FROM o{t})""")
    red = f"h0 > e0"
    return ", ".join(parts) + f""" SELECT slide, {", ".join(f"round(CASE WHEN {red} THEN h{k} ELSE e{k} END, 5) AS h{k}, round(CASE WHEN {red} THEN e{k} ELSE h{k} END, 5) AS e{k}" for k in axes)} FROM w{rounds}"""
