"""Order MinHash fingerprints, in DataFrame operations only.

The k-mers of a text are runs of ``K`` words, numbered by occurrence (first, second, ...), so that
repeats count. One permutation of the numbered k-mers is cut into ``BUCKETS`` ranges; of each range the
``TUPLE`` smallest are selected, put back into text order and hashed as a tuple. A moved passage changes
the order inside tuples, so the share of equal tuples follows edit distance and not only shared content.

All steps work on arrays of longs inside a row: a hash in the upper 40 bits and the position in the text
in the lower 24, so that sorting by hash carries positions along. Texts of more than 2^24 words number
runs of 2, 4, ... words instead of words, as many as it takes; k-mers of one run go by their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.llm.common import cut, text_or_empty

K, TUPLE, BUCKETS = 3, 2, 32
_PLACE = 24
#: Bits of a position.
_PLACES = _PLACE
_LOWER = (1 << _PLACE) - 1
_SHIFT = 64 - (BUCKETS - 1).bit_length()
_REST = _SHIFT - _PLACE
_LAST = (1 << _REST) - 1


def _tag(value: Column, place: Column) -> Column:
    return value.bitwiseAND(F.lit(~_LOWER)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_LOWER)))


def _bucket(x: Column) -> Column:
    return F.shiftrightunsigned(x, _SHIFT)


def _hash(x: Column) -> Column:
    return F.shiftright(x, _PLACE)


def signatures(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add column ``into``: one long for each non-empty bucket, its number above 32 bits of the tuple's hash.

    Each step is a projection of its own, because an array that a lambda refers to must be a column:
    written inline it would be computed anew for every element.
    """
    kept = [c for c in df.columns if c != into]
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    df = df.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    count = F.greatest(F.least(F.size("_w"), F.lit(1)), F.size("_w") - (K - 1))
    coarser = F.greatest(F.lit(0), F.length(F.bin(F.size("_w") - 1)) - _PLACES)
    df = df.select(*kept, "_w", coarser.alias("_c"))
    kmer = lambda x, i: _tag(F.xxhash64(x, *(F.get("_w", i + j) for j in range(1, K))), F.call_function("shiftright", i, F.col("_c")))
    df = df.select(*kept, F.sort_array(F.transform(F.slice("_w", F.lit(1), count), kmer)).alias("_s"))
    # Occurrence numbers: within each run of equal k-mers in sorted order 1, 2, ...
    start = F.array_compact(F.transform("_s", lambda x, i: F.when((i == 0) | (_hash(x) != _hash(F.get("_s", i - 1))), i)))
    df = df.select(*kept, "_s", start.alias("_r"))
    runs = F.transform("_r", lambda s, j: F.sequence(F.lit(1), F.coalesce(F.get("_r", j + 1), F.size("_s")) - s))
    occurrence = F.when(F.size("_r") == F.size("_s"), F.array_repeat(F.lit(1), F.size("_s"))).otherwise(F.flatten(runs))
    numbered = F.zip_with("_s", occurrence, lambda x, o: _tag(F.xxhash64(_hash(x), o), x))
    df = df.select(*kept, F.sort_array(numbered).alias("_p"))
    # A long sorts as signed, so the ranges come in another order, but each is still one contiguous run.
    least = F.filter("_p", lambda x, i: (i < TUPLE) | (_bucket(x) != _bucket(F.get("_p", i - TUPLE))))
    # Bucket, position, rest of the hash: sorted so, each bucket's selection stands in text order.
    turned = F.transform(least, lambda x: F.shiftleft(_bucket(x), _SHIFT).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(_LOWER)), _REST)).bitwiseOR(_hash(x).bitwiseAND(F.lit(_LAST))))
    df = df.select(*kept, F.sort_array(turned).alias("_m"))
    first = lambda x, i: (i == 0) | (_bucket(x) != _bucket(F.get("_m", i - 1)))
    rest = lambda x, i: [F.when(_bucket(F.get("_m", i + j)) == _bucket(x), F.get("_m", i + j).bitwiseAND(F.lit(_LAST))) for j in range(1, TUPLE)]
    entry = lambda x, i: F.when(first(x, i), F.shiftleft(_bucket(x), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(x.bitwiseAND(F.lit(_LAST)), *rest(x, i)), 32)))
    return df.select(*kept, F.array_compact(F.transform("_m", entry)).alias(into))


def fingerprint(signature: Column) -> Column:
    """Ten hexadecimal digits for each non-empty bucket: its number and the tuple's hash."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal tuples as a share of the buckets that are not empty in either; 1 for two empty signatures."""
    bucket = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    filled = F.size(F.array_union(bucket(a), bucket(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def _next_links(base: DataFrame) -> tuple[DataFrame, int]:
    """(k, h, to_k, to_h, need): each document with the one that it follows and the characters that one asks for.

    Positions come from one range sort of keys; the documents before a partition are counted by
    partition, so no task sees all rows.
    """
    order = base.select("doc_id", "k", "h", F.length("text").alias("n")).dropDuplicates(["k", "h"]).orderBy(F.col("doc_id").desc_nulls_last(), "h")
    ranked = cut(order.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("m"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    placed = ranked.join(starts, "_part").select("k", "h", "n", (F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))
    total = ranked.count()
    earlier = placed.select(F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.floor(F.col("n") / 3).cast("int").alias("need"), ((F.col("place") + 1) % max(1, total)).alias("place"))
    return placed.select("k", "h", "place").join(earlier, "place").drop("place"), total


def compare_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id) of every document.

    The edited text replaces the last third (rounded down) of a text's characters by as many of the
    next document's first ones, or all of them. The next document is the one with the next smaller id,
    after the smallest the one with the largest; null ids come last, and documents with the same id
    follow each other by the hash of their text. Rows that repeat id and text are one document and give
    equal rows. Null texts count as empty: empty signatures are alike, and unlike any other. An empty
    table gives an empty result; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    text = text_or_empty()
    base = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("k"), F.xxhash64(text, F.col("doc_id").isNull()).alias("h"))
    links, distinct = _next_links(base)
    # Both joins below read the same columns of this, so that its shuffle is written once and reused.
    signed = signatures(base, "text", "sig")
    sent = signed.join(links, ["k", "h"]).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.expr("left(text, need)").alias("head"), F.col("sig").alias("next_sig"), F.col("doc_id").alias("next_id"))
    if docs.count() > distinct:
        sent = sent.groupBy("k", "h").agg(F.first("head").alias("head"), F.first("next_sig").alias("next_sig"), F.first("next_id").alias("next_id"))
    n = F.length("text")
    joined = signed.join(sent, ["k", "h"]).select(
        "doc_id", n.cast("long").alias("n_chars"), F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.col("head")).alias("edited"), "sig", "next_sig", "next_id"
    )
    joined = signatures(joined, "edited", "edited_sig")
    return joined.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
        "next_id",
    )
