"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are rows of integer weights, their components are the terms. Queries and candidates are dealt
into blocks of bounded size; each pair of a query block and a candidate block meets in one task. There,
for one term after the other, the queries that hold the term scatter their weight times the term's
postings (candidates and weights) into a dense array of scores. The best ``k`` of each block are
selected by partition and merged over the blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, EVERY, SCALE = 5, 50, 256
#: Each candidate is sent to every block of queries and each query to every block of candidates, so neither may be small.
QUERY_BLOCK, CANDIDATE_BLOCK = 16384, 16384
#: Scores held at a time inside a task: this many query rows times a block of candidates.
_ROWS = 64
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double; null unless all components are finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: _floor(x, scale)))


def _floor(x: Column, scale: int) -> Column:
    """The floor as a double: whole numbers beyond the range of a long stay what they are."""
    v = x.cast("double") * scale
    return F.when(F.abs(v) < 2.0**62, F.floor(v).cast("double")).otherwise(v)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of weights; shorter vectors lack the terms beyond their end. Python numbers where a long may overflow."""
    flat = vectors.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    size = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat.flatten().to_numpy()
    return out


def _integers(*parts: np.ndarray) -> list[np.ndarray]:
    width = max(p.shape[1] for p in parts)
    top = math.prod(float(np.abs(p).max(initial=0)) + 1 for p in parts) * (width + 1)
    padded = [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]
    if top < 2.0**62:
        return [p.astype(np.int64) for p in padded]
    return [np.array([[int(x) for x in row] for row in p], object).reshape(p.shape) for p in padded]


def _best(queries: pa.Table, candidates: pa.Table, k: int) -> tuple[list, list, list]:
    """Query ids, candidate ids and scores of the best ``k`` candidates of each query in a pair of blocks.

    Scores are held at the ends of a long; vectors of one id with the same score count once.
    """
    order = np.argsort(candidates["vec_id"].to_numpy(), kind="stable")
    ids = candidates["vec_id"].to_numpy()[order]
    query_ids = queries["vec_id"].to_numpy()
    equal = ids[1:] == ids[:-1]
    repeated = np.flatnonzero(np.concatenate((equal, [False])) | np.concatenate(([False], equal)))
    weights, stored = _integers(_matrix(queries["v"]), _matrix(candidates["v"])[order])
    postings = [(np.flatnonzero(stored[:, t]), stored[:, t]) for t in range(stored.shape[1])]
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(query_ids), _ROWS):
        own = weights[at : at + _ROWS]
        score = np.zeros((len(own), len(ids)), own.dtype)
        for t, (rows, column) in enumerate(postings):
            holds = np.flatnonzero(own[:, t])
            if not len(holds) or not len(rows):
                continue
            if len(holds) == len(own) and len(rows) == len(ids):
                score += own[:, t, None] * column
            else:
                score[np.ix_(holds, rows)] += own[holds, t, None] * column[rows]
        for q, line in zip(query_ids[at : at + _ROWS], score, strict=True):
            if line.dtype == object:
                line = np.array([min(max(int(x), _LONG[0]), _LONG[1]) for x in line], np.int64)
            counts = ids != q
            if len(repeated):
                by_score = repeated[np.lexsort((line[repeated], ids[repeated]))]
                one, two = by_score[:-1], by_score[1:]
                counts[two[(ids[one] == ids[two]) & (line[one] == line[two])]] = False
            left = np.flatnonzero(counts)
            line = line[left]
            if len(left) > k:
                bound = np.partition(line, len(line) - k)[len(line) - k]
                above = np.flatnonzero(line > bound)
                level = np.flatnonzero(line == bound)[: k - len(above)]  # ids ascend, so ties go to the smaller
                chosen = np.concatenate((above, level))
            else:
                chosen = np.arange(len(left))
            out[0].extend([q] * len(chosen))
            out[1].extend(ids[left[chosen]])
            out[2].extend(line[chosen])
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query, or all if there are fewer.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates all rows but the query's
    own; ties go to the smaller ``vec_id``. Vectors that are null or hold null or non-finite components
    take no part, nor do rows without a ``vec_id``. A vector that is shorter than another lacks its
    last components. Rows that repeat a ``vec_id`` with the same vector count once; with different
    vectors each is a candidate, and none is a candidate of its own id's queries. Scores beyond a long
    are held at its ends. An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select("vec_id", quantized(F.col("embedding"), scale).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    is_query = F.col("vec_id") % every == 0
    n, m = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    # Copies go before the blocks are dealt, so that no block is larger than the others.
    rows = rows.dropDuplicates(["vec_id", "v"])
    query_blocks, blocks = max(1, math.ceil(m / QUERY_BLOCK)), max(1, math.ceil(n / CANDIDATE_BLOCK))

    def dealt(df: DataFrame, own: str, count: int, other: str, times: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int").alias(own)
        return df.select("vec_id", "v", block, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(other))

    queries = dealt(rows.filter(is_query), "q", query_blocks, "c", blocks).groupBy("q", "c")
    candidates = dealt(rows, "c", blocks, "q", query_blocks).groupBy("q", "c")
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def score(own: pa.Table, stored: pa.Table) -> pa.Table:
        q, c, s = _best(own, stored, k) if own.num_rows and stored.num_rows else ([], [], [])
        types = stored.schema.field("vec_id").type
        return pa.table([pa.array(q, types), pa.array(c, types), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    found = queries.cogroup(candidates).applyInArrow(score, f"query_id {kind}, vec_id {kind}, score long").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(k: int = K, every: int = EVERY, scale: int = SCALE) -> str:
    """DuckDB SQL for the rows of ``top_k`` over ``embeddings``."""
    return f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}
"""
