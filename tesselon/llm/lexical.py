"""Ranked lexical search over an index whose documents are grouped by equal length normaliser.

Queries are items of text. Each batch of items has a vocabulary of bounded size; documents are scanned
once a batch and become bags of those terms. Bags are dealt into shards that hold about as many postings
each, and sorted by the normaliser m there: documents of equal m are a stratum. Within a stratum a term's postings stand by frequency, and
as m is the same for all of them the impact of a frequency is computed once. A term's last posting in a
stratum has its greatest impact; the sum over an item's terms bounds the scores of the stratum. An item
visits the strata from the highest bound down and stops at the first one whose bound is below the score
that its k-th best document has so far. The best ``k`` of each task are merged at the end.

All scores are whole numbers. They are added as doubles, of which sums of up to ``_EXACT`` terms are
exact, and those sums as long integers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesselon.lineage import cut as written
from tesselon.llm.common import chunks, text_or_empty

K = 10
#: Bytes of the terms that a batch of items may have together; one item alone may have more.
BATCH_BYTES = 8 << 20
#: Postings of a block, which is what a task holds of the index at a time.
BLOCK = 2_000_000
#: Bytes of a text whose terms are listed at a time.
WINDOW = 1 << 20
#: Terms of an item whose scores are added as doubles: 2^16 times 2^20 times this is below 2^53.
_EXACT = 1 << 16
# The terms, as bytes of lower-cased UTF-8 and as the contract writes them (fixed values).
_TERM, _APART = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, a window of it at a time; only A-Z are lower-cased."""
    raw, at = text.encode().lower(), 0
    while at < len(raw):
        end = _APART.search(raw, at + WINDOW) if len(raw) - at > WINDOW else None
        stop = end.start() if end else len(raw)
        yield _TERM.findall(raw, at, stop)
        at = stop


def _distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0)))


def _bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, place, n, terms, times) of the documents with a term; ``terms`` are those of the vocabulary, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        for part in chunks(batches, "text"):
            sizes, codes = [], []
            for text in part.column("text").to_pylist():
                size = 0
                for own in terms(text):
                    codes.append(np.fromiter(map(vocabulary.get, own, repeat(-1)), np.int32, len(own)))
                    size += len(own)
                sizes.append(size)
            n = np.array(sizes, np.int64)
            code = np.concatenate([*codes, np.zeros(0, np.int32)])
            row = np.repeat(np.arange(len(n)), n)[code >= 0]
            key, times = np.unique(row * max(1, len(vocabulary)) + code[code >= 0], return_counts=True)
            row, term = np.divmod(key, max(1, len(vocabulary)))
            offsets = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, times)]
            out = pa.record_batch([part.column("doc_id"), pa.array(np.arange(place, place + len(n))), pa.array(n), *lists], ["doc_id", "place", "n", "terms", "times"])
            place += len(n)
            yield out.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, place long, n long, terms array<int>, times array<int>")


def weight(documents: int, holding: int) -> int:
    """A term's weight from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Block:
    """Strata of documents and their postings by term, stratum and frequency."""

    def __init__(self, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, times: np.ndarray, terms: int):
        strata, of_doc = np.unique(m, return_inverse=True)
        doc = np.repeat(np.arange(len(m)), sizes)
        stratum = of_doc[doc]
        order = np.lexsort((times, stratum, term))
        self.doc, term, stratum, times = doc[order], term[order], stratum[order], times[order]
        # One impact for each frequency of a stratum.
        new = np.concatenate(([True], (np.diff(term) != 0) | (np.diff(stratum) != 0) | (np.diff(times) != 0)))[: len(term)]
        pairs, which = np.unique(np.stack((stratum[new], times[new])), axis=1, return_inverse=True)
        impact = (1_000_000_000 * pairs[1]) // (1000 * pairs[1] + 8 * strata[pairs[0]])
        self.impact = impact[which.reshape(-1)][np.cumsum(new) - 1].astype(float)
        run = np.flatnonzero(np.concatenate(([True], (np.diff(term) != 0) | (np.diff(stratum) != 0)))[: len(term)])
        self.start, self.stop = run, np.append(run[1:], len(term))
        self.stratum, self.most = stratum[run], self.impact[self.stop - 1]
        self.first = np.searchsorted(term[run], np.arange(terms + 1))
        self.documents, self.strata = len(m), len(strata)

    def runs(self, own: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of an item's terms and their weights."""
        size = self.first[own + 1] - self.first[own]
        at = np.repeat(self.first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return at, np.repeat(weights[own], size)

    def scores(self, runs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        size = self.stop[runs] - self.start[runs]
        at = np.repeat(self.start[runs] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.doc[at], self.impact[at] * np.repeat(weights, size), self.documents)


class Best:
    """The ``k`` best documents of each item among the blocks seen so far."""

    def __init__(self, queries: list[np.ndarray], weights: np.ndarray, k: int):
        self.queries, self.weights, self.k = queries, weights.astype(float), k
        self.found: list[list[tuple]] = [[] for _ in queries]

    def visit(self, block: Block, ids: list) -> None:
        order = np.empty(len(ids), np.int64)  # of the documents by id, null last
        order[sorted(range(len(ids)), key=lambda d: (ids[d] is None, ids[d] if ids[d] is not None else 0))] = np.arange(len(ids))
        for q, own in enumerate(self.queries):
            parts = [block.runs(own[a : a + _EXACT], self.weights) for a in range(0, len(own), _EXACT)]
            bound = sum(np.bincount(block.stratum[r], w * block.most[r], block.strata) for r, w in parts) if parts else np.zeros(block.strata)
            visits, at, step = np.argsort(-bound, kind="stable"), 0, 1
            while at < len(visits):
                least = self.found[q][-1][0] if len(self.found[q]) == self.k else 1
                step = min(step, int(np.searchsorted(-bound[visits[at:]], -least, "right")))
                if not step:
                    break
                chosen = np.zeros(block.strata, bool)
                chosen[visits[at : at + step]] = True
                score = np.zeros(block.documents, np.int64)
                for r, w in parts:
                    kept = chosen[block.stratum[r]]
                    score += block.scores(r[kept], w[kept]).astype(np.int64)
                self._merge(q, score, least, order, ids)
                at, step = at + step, step * 2

    def _merge(self, q: int, score: np.ndarray, least: int, order: np.ndarray, ids: list) -> None:
        good = np.flatnonzero(score >= least)
        if len(good) > self.k:
            good = good[np.lexsort((order[good], -score[good]))[: self.k]]
        both = self.found[q] + [(int(score[d]), ids[d]) for d in good]
        both.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
        self.found[q] = both[: self.k]


def _best_of_tasks(bags: DataFrame, items: list, item_type, queries: list[np.ndarray], weights: np.ndarray, k: int, shape: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, postings, kind = Best(queries, weights, k), [], 0, None

        def close() -> None:
            m, ids = np.concatenate([b.column("m").to_numpy() for b in held]), [i for b in held for i in b.column("doc_id").to_pylist()]
            lists = [b.column("terms") for b in held]
            size = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
            flat = [np.concatenate([b.column(c).flatten().to_numpy() for b in held]).astype(np.int64) for c in ("terms", "times")]
            best.visit(Block(m, size, *flat, len(weights)), ids)

        for batch in batches:
            kind, at = batch.schema.field("doc_id").type, 0
            ends = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + BLOCK - postings, "right")))
                held.append(batch.slice(at, stop - at))
                postings += int(ends[stop - 1] - before)
                if postings >= BLOCK or stop < batch.num_rows:
                    close()
                    held, postings = [], 0
                at = stop
        if held:
            close()
        rows = [(items[q], i, s) for q, own in enumerate(best.found) for s, i in own]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(item, item_type), pa.array(doc, kind), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    return bags.mapInArrow(run, shape)


def search(docs: DataFrame, items: DataFrame, k: int = K, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, all with a score above 0 if there are fewer.

    Equal scores go by ascending id, null ids last. Null texts have no terms; items without terms have
    no results. Rows of ``docs`` that repeat an id are documents of their own; rows of ``items`` that
    repeat an id are one item with the terms of all. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.explode(_distinct_terms(text_or_empty())).alias("t")).groupBy("item_id").agg(F.array_sort(F.collect_set("t")).alias("terms"))
    asked = written(asked.withColumn("size", F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))))
    number = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    batches = max(1, -(-(asked.agg(F.sum("size")).first()[0] or 0) // batch_bytes))
    while not asked.groupBy(number(batches).alias("b")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).filter((F.col("size") > batch_bytes) & (F.col("n") > 1)).isEmpty():
        batches *= 2
    kinds = {c: f.schema[c].dataType for f, c in ((docs, "doc_id"), (items, "item_id"))}
    shape = f"item_id {kinds['item_id'].simpleString()}, doc_id {kinds['doc_id'].simpleString()}, score long"
    found = []
    for b in range(batches):
        rows = asked.filter(number(batches) == b).select("item_id", "terms").collect()
        names = sorted({t for r in rows for t in r["terms"]})
        at = {t: i for i, t in enumerate(names)}
        bags = written(_bags(docs, {t.encode(): i for t, i in at.items()}))
        documents, words, postings = bags.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms"))).first()
        if not rows or not documents:
            continue
        holding = np.zeros(len(names), np.int64)
        for r in bags.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
            holding[r["t"]] = r["df"]
        weights = np.array([weight(documents, int(df)) for df in holding])
        m = F.expr(f"100 - 90 + (cast(n AS decimal(19, 0)) * cast({90 * documents} AS decimal(19, 0))) div cast({words} AS decimal(19, 0))").cast("long")
        parts = max(spark.sparkContext.defaultParallelism, -(-postings // BLOCK))
        # Long documents have many postings, so that ranges of m would be uneven.
        placed = bags.filter(F.size("terms") > 0).select("doc_id", "place", "terms", "times", m.alias("m")).repartition(parts, "place").sortWithinPartitions("m", "place")
        queries = [np.array([at[t] for t in r["terms"]], np.int64) for r in rows]
        found.append(_best_of_tasks(placed.select("doc_id", "m", "terms", "times"), [r["item_id"] for r in rows], to_arrow_type(kinds["item_id"]), queries, weights, k, shape))
    if not found:
        return spark.createDataFrame([], f"item_id {kinds['item_id'].simpleString()}, rank int, doc_id {kinds['doc_id'].simpleString()}, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_sql(k: int = K) -> str:
    """DuckDB SQL for the rows of ``search`` over ``documents`` and ``benchmark``."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({words}) AS term FROM benchmark)),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
lengths AS (SELECT r, doc_id, 100 - 90 + (90::HUGEINT * len(w) * n_docs) // n_words AS m FROM d, s WHERE len(w) > 0),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN weights USING (term) JOIN p USING (term) JOIN lengths USING (r) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}
"""
