"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every copy of a document gets a virtual finish time: the words of its source up to and with it, in a
shuffled order, divided by the source's target. Copies are served by ascending finish time until the
word budget is used up, so all sources run out of budget together.

No step orders all rows in one task. A prefix sum inside a source runs over cells of the shuffle key,
about as many as a cell has rows; the global order is cut into ranges of the finish time, and only
the range in which the budget ends is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.llm.common import cut, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
_KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Sources by code point, null last, take the weights in turn and share all words. No target exceeds
    ``most`` times its source's size; what it would exceed is shared by weight among the others. The
    sources are filled by rising limit per weight: those before the level are full, the rest share.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).alias("w"))
    limit = (F.col("source_size") * most).cast("double")
    by_limit = Window.orderBy(limit / F.col("w"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum(F.col("source_size") * most).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(Window.partitionBy()) - full) / F.sum("w").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighted.withColumn("level", level).withColumn("open", limit > F.col("level") * F.col("w"))
    common = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("common", common).select("source", "source_size", F.when(F.col("open"), F.col("common") * F.col("w")).otherwise(limit).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    ``size`` is the number of words (null and empty texts: 0), ``taken`` the words that the mix takes
    of the document, whole copies only, at most ``most`` of them. Null sources form the last source.
    Repeated rows stay rows of their own; rows that agree in id and size are interchangeable. An empty
    table gives an empty result; a corpus without words takes nothing. Other columns are ignored. The
    order depends on ``seed``, id and size alone, so reruns agree. ``also`` names columns to carry along.
    """
    size = word_count(text_or_empty())
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), size.cast("string"))), 1, _KEY_BITS // 4), 16, 10).cast("long")
    slim = cut(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *also))
    sizes = cut(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    n, hot, budget = sizes.agg(F.coalesce(F.sum("n"), F.lit(1)), F.coalesce(F.max("n"), F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()

    cells = 1 << max(0, math.ceil(math.log2(hot) / 2))
    placed = slim.withColumn("cell", F.shiftright("key", _KEY_BITS - cells.bit_length() + 1))
    cell_sizes = placed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cell_sizes.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("run", F.sum("size").over(within))
    shares = targets(sizes, weights, most).withColumnRenamed("source", "t")
    queued = (
        summed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
        .join(shares, F.col("source").eqNullSafe(F.col("t")))
        .select("doc_id", "size", "source_size", "target", "key", *also, (F.col("start") + F.col("run")).alias("words"))
    )

    ranges = math.ceil(math.sqrt(n * most))
    finish = [F.try_divide(F.col("source_size") * e + F.col("words"), F.col("target")) for e in range(most)]
    rank = [F.least(F.floor(f * ranges), F.lit(4 * ranges)).cast("long") for f in finish]
    copies = queued.select(
        "doc_id", "size", "key", F.explode(F.array(*(F.struct(r.alias("range"), f.alias("finish"), F.lit(e).alias("copy")) for e, (r, f) in enumerate(zip(rank, finish, strict=True))))).alias("c")
    ).select("doc_id", "size", "key", "c.*")
    upto = F.sum("range_size").over(Window.orderBy("range"))
    ends = copies.groupBy("range").agg(F.sum("size").alias("range_size")).select("range", "range_size", upto.alias("upto"))
    last = ends.filter(F.col("upto") > budget).orderBy("range").first()
    if last is None:
        served = [F.lit(True)] * most
    else:
        order = ["finish", "key", "doc_id", "copy"]
        run = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        end = copies.filter(F.col("range") == last["range"]).withColumn("run", run).filter(F.col("run") <= budget - last["upto"] + last["range_size"]).agg(F.max(F.struct(*order)).alias("end")).first()["end"]
        served = []
        for e, (r, f) in enumerate(zip(rank, finish, strict=True)):
            inside = F.lit(False)
            if end is not None:
                bound = F.struct(
                    F.lit(end["finish"]).alias("finish"), F.lit(end["key"]).alias("key"), F.lit(end["doc_id"]).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(end["copy"]).alias("copy")
                )
                inside = F.struct(f.alias("finish"), F.col("key"), F.col("doc_id"), F.lit(e).alias("copy")) <= bound
            served.append((r < last["range"]) | ((r == last["range"]) & inside))
    copies_taken = sum((F.when(s, 1).otherwise(0) for s in served), F.lit(0))
    return queued.select("doc_id", "size", "source_size", "target", *also, (F.col("size") * copies_taken).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Documents without words are not taken. Rows that repeat id and text are one document, whose copies
    add up.
    """
    names, h = docs.columns, F.xxhash64(text_or_empty())
    rows = mix(docs.select("doc_id", "source", "text", h.alias("__h")), weights, most, seed, ("__h",))
    copies = cut(rows.filter("taken > 0").groupBy(F.col("doc_id").alias("__d"), "__h").agg(F.sum(F.expr("taken div size")).alias("__n"), F.count(F.lit(1)).alias("__rows")))
    out = docs.withColumn("__own", h)
    if not copies.filter("__rows > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "__own"])
    out = out.join(copies, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__own") == F.col("__h")))
    return out.select(*names, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy")).select(*names)


def mix_sql(weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED) -> str:
    """DuckDB SQL for the rows of ``mix`` over ``documents``, with plain global windows."""
    n = len(weights)
    return f"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
keyed AS (
  SELECT *, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR || ':', '') || size::VARCHAR), 1, 15))::BIGINT AS key FROM slim),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighted AS (
  SELECT *, (ARRAY{list(weights)})[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n}] AS w FROM sizes),
leveled AS (
  SELECT source, source_size, w, (source_size * {most})::DOUBLE AS lim,
    (sum(source_size) OVER () - coalesce(sum(source_size * {most}) OVER (ORDER BY (source_size * {most})::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY (source_size * {most})::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted),
shares AS (
  SELECT source, source_size, CASE WHEN lim > level * w THEN (SELECT max(level) FROM leveled WHERE lim > level * w) * w ELSE lim END AS target FROM leveled),
queued AS (
  SELECT k.doc_id, k.size, s.source_size, s.target, k.key,
    (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING))::BIGINT AS words
  FROM keyed k JOIN shares s ON k.source IS NOT DISTINCT FROM s.source),
copies AS (
  SELECT *, e AS copy, (source_size * e + words)::DOUBLE / nullif(target, 0) AS finish FROM queued, range({most}) r(e)),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish NULLS LAST, key, doc_id, copy ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size) FROM keyed) AS ok FROM copies)
SELECT doc_id, size, source_size, target, (size * sum(CASE WHEN ok THEN 1 ELSE 0 END))::BIGINT AS taken
FROM served GROUP BY doc_id, size, source_size, target, key, words
"""
