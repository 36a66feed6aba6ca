"""Phrase collocations by set-oriented relational mining.

The occurrence relation is persisted once, sorted by piece and position: a row of the table holds many
pieces of one language, the words of all its positions in order, and where each piece ends. A row is
packed and compressed, so that Spark moves bytes; only the row that a task works on is ever unpacked. The
occurrences of phrases of k words are the merge-join of those of k - 1 words with each other on piece
and adjacent position, which in sorted order is one pass; they are grouped and counted, and the counts
are added up. Before the next length, occurrences whose phrase is not frequent are left out.

Most phrases are rare, so groups are first counted by a hash of the phrase. The semi-join goes through
a bitmap of the frequent hashes, whose size is fixed, since the frequent phrases themselves may be any
number. A last pass counts the phrases that the bitmaps of all lengths let through by their words. What
a bitmap lets through by chance is found there not to be frequent, so counts are exact at any load; a
full bitmap would merely leave out nothing.

Groups and counts are shuffled packed: a task deals its groups into buckets by their hash, a row holds
the groups of one bucket, compressed, and what meets in a bucket is bounded by the number of buckets.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.lineage import cut as written
from tesselon.lineage import remove
from tesselon.llm.common import chunks, shared_dir

LENGTHS, LEAST, TOP = 3, 10, 2000
#: Percent of a candidate's occurrences that a longer one must reach to take its place.
DOMINATED = 50
#: Bits of the bitmap of frequent phrases, as a power of two (8 MB), and of one row of it (a fixed value of Spark's bitmap functions).
BITS, ROW = 26, 15
#: Occurrences of a row of the relation, and of phrases that a task holds before it counts them by hash, or by words.
RELATION, HELD, HELD_WORDS = 1 << 19, 1 << 20, 1 << 21
#: Buckets at least, and occurrences of a bucket on average, which bound its groups, once there are more.
BUCKETS, BUCKET = 512, 1 << 22
#: Words that a task numbers; beyond, it starts anew.
WORDS = 1 << 17
# Characters that end pieces, and those between words (fixed values of the contract).
_ENDS, _BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
_TABLE = bytes(ord("\n") if chr(b) in _ENDS else ord(" ") if chr(b) in _BLANKS else b for b in range(256))
_WORD = re.compile(rb"[^ \n]+|\n")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def relation(docs: DataFrame) -> DataFrame:
    """(lang, n, words, places): ``n`` occurrences, their different words, and for ``_unpacked`` what is known without the words.

    ``places`` holds the hashes of the words, the language's being part of them, the occurrences in order
    as numbers of the words, and the end of each piece among them.
    """

    def row(lang: str, raw: list[bytes]) -> pa.RecordBatch:
        # Every text is closed by a line feed, as is every piece.
        coded = pa.array(_WORD.findall(b"\n".join([*raw, b""]).translate(_TABLE)), pa.binary()).dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        stop = names.index(b"\n")
        at = np.flatnonzero(code == stop)
        ends = np.unique(at - np.arange(len(at)))
        ends, code = ends[ends > 0], code[code != stop]
        code, names = code - (code > stop), names[:stop] + names[stop + 1 :]
        places = b"".join(map(_whole, (_hashes(names, lang), code.astype(np.uint32), ends.astype(np.uint32))))
        columns = [pa.array([lang]), pa.array([len(code)], pa.int64()), pa.array([zstandard.compress(b"\n".join(names))], pa.binary()), pa.array([places], pa.binary())]
        return pa.record_batch(columns, ["lang", "n", "words", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for part in chunks(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                raw = text.encode().lower()
                held.setdefault(lang, []).append(raw)
                size += len(raw)
            # About six bytes a word.
            if size > 6 * RELATION:
                yield from (row(*x) for x in held.items())
                held, size = {}, 0
        yield from (row(*x) for x in held.items())

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL")
    return texts.mapInArrow(run, "lang string, n long, words binary, places binary")


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, their first bytes first, and so on, compressed."""
    return zstandard.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes())


def _of_planes(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(raw).view(np.uint32).ravel()


def _whole(numbers: np.ndarray) -> bytes:
    packed = _planes(numbers)
    return len(packed).to_bytes(8, "little") + packed


def _unpacked(places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the words, the occurrences and the ends in a row of the relation."""
    out, at = [], 0
    while at < len(places):
        size = int.from_bytes(places[at : at + 8], "little")
        out.append(_of_planes(places[at + 8 : at + 8 + size]))
        at += 8 + size
    hashes, word, ends = out
    return hashes, word.view(np.int32), ends.view(np.int32)


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh32_intdigest(w, seed) for w in words), np.uint32, len(words))


def _combined(hashes: list[np.ndarray]) -> np.ndarray:
    """The hashes of phrases, whose words' hashes are given by place in the phrase."""
    with np.errstate(over="ignore"):
        out = hashes[0].astype(np.uint64)
        for h in hashes[1:]:
            out = (out ^ (out >> np.uint64(31))) * _FACTOR + h
        return (out ^ (out >> np.uint64(29))) * _FACTOR


def _among(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _places(hashes: np.ndarray, word: np.ndarray, ends: np.ndarray, bitmaps: list[Broadcast], k: int) -> list[np.ndarray]:
    """Where phrases of 1 to ``k`` words begin, sorted, each length semi-joined with its bitmap if there is one.

    The phrases of j words are those of j - 1 words joined with those that begin one position on in the
    same piece.
    """
    live = _among(bitmaps[0].value, _combined([hashes]))[word] if bitmaps else np.ones(len(word), bool)
    follows = np.ones(len(word), bool)
    follows[ends - 1] = False
    out = [np.flatnonzero(live)]
    for j in range(2, k + 1):
        live = live & follows & np.append(live[1:], False)
        at = np.flatnonzero(live)
        if j <= len(bitmaps):
            good = _among(bitmaps[j - 1].value, _combined([hashes[word[at + i]] for i in range(j)]))
            live[at] = good
            at = at[good]
        out.append(at)
    return out


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the groups by bucket and lower half of the hash, the buckets that have any, and where each begins and the last ends."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF))
    own, starts = np.unique(bucket[order], return_index=True)
    return order, own, np.append(starts, len(order))


def _steps(ascending: np.ndarray) -> bytes:
    """Ascending numbers of 32 bits as what each adds to the one before."""
    return _planes(np.diff(ascending, prepend=np.uint32(0)))


def _ascending(steps: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(steps), dtype=np.uint32)


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the values between cuts."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _split(lines: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([lines], pa.large_string()), "\n").flatten()


def _met(rows: DataFrame, keys: list[str], merge, schema: str) -> DataFrame:
    """``merge`` of all packed rows with the same ``keys``, the first of which is the bucket; it gets the keys' values and the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != at and held:
                    yield merge(at, held)
                    held = []
                at = own
                held.append(row)
        if held:
            yield merge(at, held)

    return rows.repartition("bucket").sortWithinPartitions(*keys).mapInArrow(run, schema)


def bitmap(occurrences: DataFrame, k: int, least: int, shorter: list[Broadcast], buckets: int) -> Broadcast:
    """The bits of the hashes of phrases of ``k`` words that occur ``least`` times, as bytes sent to all workers.

    ``shorter`` are the bitmaps of the phrases of fewer words. At most 2^``BITS`` bits come to the driver.
    Within a bucket phrases are told apart by the lower 32 bits of their hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def counted() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(found), return_counts=True)
            order, own, cuts = _dealt(hashes, buckets)
            lower = hashes[order].astype(np.uint32)
            steps = [_steps(lower[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            return pa.record_batch([pa.array(own.astype(np.int32)), pa.array(steps, pa.binary()), _packed(n[order].astype(np.uint32), cuts)], ["bucket", "hashes", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                hashes, word, ends = _unpacked(batch.column("places")[i].as_py())
                at = _places(hashes, word, ends, shorter, k)[-1]
                found.append(_combined([hashes[word[at + j]] for j in range(k)]))
                held += len(at)
                if held > HELD:
                    yield counted()
                    found, held = [], 0
        if held:
            yield counted()

    def merge(_, rows: list[dict]) -> pa.RecordBatch:
        hashes, n = np.concatenate([_ascending(r["hashes"]) for r in rows]), np.frombuffer(b"".join(r["n"] for r in rows), np.uint32)
        order = np.argsort(hashes)
        hashes = hashes[order]
        starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        often = np.add.reduceat(n[order].astype(np.int64), starts) >= least
        return pa.record_batch([pa.array((hashes[starts[often]] & np.uint32((1 << BITS) - 1)).astype(np.int64))], ["bit"])

    counts = occurrences.select("places").mapInArrow(run, "bucket int, hashes binary, n binary")
    bits = _met(counts, ["bucket"], merge, "bit long")
    rows = bits.groupBy(F.shiftright("bit", ROW).alias("row")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << ROW) - 1))).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    width = 1 << (ROW - 3)
    for r in rows.collect():
        out[r["row"] * width : (r["row"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return occurrences.sparkSession.sparkContext.broadcast(out)


class _Counter:
    """Counts of phrases by their words, numbered within a task, of one language."""

    def __init__(self, lang: str, lengths: int, buckets: int):
        self.lang, self.lengths, self.buckets = lang, lengths, buckets
        self._anew()

    def _anew(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes: list[np.ndarray] = []
        self.found: list[list[np.ndarray]] = [[] for _ in range(self.lengths)]
        self.held = 0

    def add(self, words: pa.Array, hashes: np.ndarray, word: np.ndarray, places: list[np.ndarray]) -> None:
        """``words`` of a row of the relation and their hashes, and where phrases of each length begin in it."""
        used = np.zeros(len(words), bool)
        used[word[places[0]]] = True
        number, before = np.zeros(len(words), np.int64), len(self.number)
        number[used] = [self.number.setdefault(w, len(self.number)) for w in words.filter(pa.array(used)).to_pylist()]
        fresh = used & (number >= before)
        self.hashes.append(hashes[fresh][np.argsort(number[fresh])])
        code = number[word]
        for k, at in enumerate(places):
            self.found[k].append(np.stack([code[at + i] for i in range(k + 1)]).astype(np.int32))
            self.held += len(at)

    def count(self) -> Iterator[pa.RecordBatch]:
        names, span = list(self.number), len(self.number)
        hashes = np.concatenate(self.hashes) if self.hashes else None
        for found in self.found:
            codes = np.concatenate(found, axis=1) if found else np.zeros((1, 0), np.int32)
            if not codes.shape[1]:
                continue
            key = codes[0].astype(np.int64)
            for c in codes[1:]:
                if int(key.max()) + 1 >= (1 << 62) // span:
                    key = np.unique(key, return_inverse=True)[1]
                key = key * span + c
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            codes = codes[:, first]
            order, own, cuts = _dealt(_combined([hashes[c] for c in codes]), self.buckets)
            n, codes = n[order].astype(np.uint32), codes[:, order]
            step = max(1, len(own) * (1 << 16) // len(order))
            for a in range(0, len(own), step):
                cut = cuts[a : a + step + 1]
                low, high = cut[0], cut[-1]
                phrases = list(map(" ".join, zip(*(map(names.__getitem__, c[low:high].tolist()) for c in codes), strict=True)))
                packed = [zstandard.compress("\n".join(phrases[x - low : y - low]).encode()) for x, y in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
                yield pa.record_batch([pa.array(own[a : a + step].astype(np.int32)), pa.array([self.lang] * len(packed)), pa.array(packed, pa.binary()), _packed(n[low:high], cut - low)], ["bucket", "lang", "phrases", "n"])
        self._anew()


def frequent(occurrences: DataFrame, least: int, bitmaps: list[Broadcast], buckets: int) -> DataFrame:
    """(lang, k, phrase, f) of the phrases of up to as many words as there are bitmaps that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, _Counter] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words = batch.column("lang")[i].as_py(), _split(zstandard.decompress(batch.column("words")[i].as_py()))
                hashes, word, ends = _unpacked(batch.column("places")[i].as_py())
                words = words.slice(0, len(hashes))  # none of a row without words
                own = counters.setdefault(lang, _Counter(lang, len(bitmaps), buckets))
                own.add(words, hashes, word, _places(hashes, word, ends, bitmaps, len(bitmaps)))
                if len(own.number) > WORDS or sum(c.held for c in counters.values()) > HELD_WORDS:
                    for c in counters.values():
                        yield from c.count()
        for c in counters.values():
            yield from c.count()

    def merge(at: tuple, rows: list[dict]) -> pa.RecordBatch:
        phrases = _split(b"\n".join(zstandard.decompress(r["phrases"]) for r in rows))
        n = pa.array(np.frombuffer(b"".join(r["n"] for r in rows), np.uint32).astype(np.int64))
        sums = pa.table({"phrase": phrases, "f": n}).group_by("phrase").aggregate([("f", "sum")])
        sums = sums.filter(pc.greater_equal(sums["f_sum"], least)).combine_chunks()
        phrase, f = sums["phrase"].cast(pa.string()), sums["f_sum"]
        k = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
        return pa.Table.from_arrays([pa.array([at[1]] * len(f), pa.string()), k, phrase, f], ["lang", "k", "phrase", "f"]).combine_chunks().to_batches()[0] if len(f) else empty

    shape = "lang string, k int, phrase string, f long"
    empty = pa.record_batch([pa.nulls(0, t) for t in (pa.string(), pa.int32(), pa.string(), pa.int64())], ["lang", "k", "phrase", "f"])
    counts = occurrences.select("lang", "words", "places").mapInArrow(run, "bucket int, lang string, phrases binary, n binary")
    return _met(counts, ["bucket", "lang"], merge, shape)


def _parts(words: str, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def mine(docs: DataFrame, lengths: int = LENGTHS, least: int = LEAST, top: int = TOP, dominated: int = DOMINATED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of 2 to ``lengths`` words in each language.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its lowest-scoring cut, ``n`` all words
    of the language. Equal scores go by ``a``, then by the phrase's bytes. Candidates inside a longer one
    with at least ``dominated`` percent of their occurrences are left out. Null texts count as empty, null
    languages are ``und``; ids are not used and repeated rows count as often as they occur. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/occurrences-{uuid.uuid4().hex}"
    # Without dictionaries, since rows are compressed and no two are equal.
    relation(docs).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(folder)
    occurrences = spark.read.parquet(folder)
    buckets = max(BUCKETS, (occurrences.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    bitmaps: list[Broadcast] = []
    for k in range(1, lengths + 1):
        bitmaps.append(bitmap(occurrences, k, least, bitmaps, buckets))
    counted = written(frequent(occurrences, least, bitmaps, buckets))
    n = written(occurrences.groupBy("lang").agg(F.sum("n").alias("n")))
    remove(spark, folder)
    candidates = counted.filter("k > 1").drop("k")
    split = F.split("phrase", " ", -1).alias("words")
    # Longer candidates are met at their parts.
    inner = "transform(filter(flatten(transform(sequence(2, size(words) - 1), s -> transform(sequence(1, size(words) - s + 1), i -> struct(i, s)))), x -> x.s >= 2), x -> array_join(slice(words, x.i, x.s), ' '))"
    longer = counted.filter("k > 2").select("lang", "f", split).select("lang", "f", F.explode(F.array_distinct(F.expr(inner))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < dominated * F.col("f"), F.lit(True)))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), split).select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _parts("words", F.lit(1), F.col("k")).alias("left"), _parts("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    of = lambda c, name: counted.select("lang", F.col("phrase").alias(c), F.col("f").alias(name))
    met = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    whole = lambda c: f"cast({c} AS decimal(19, 0))"
    met = met.withColumn("score", F.expr(f"({whole('a')} * {whole('a')} * cast(1000000 AS decimal(7, 0))) div ({whole('l')} * {whole('r')})").cast("long"))
    least_cut = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("c")
    scored = met.groupBy("lang", "phrase", "a").agg(least_cut).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # First within parts of a language, so that no task sees all phrases of one.
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = scored.withColumn("_p", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine_sql(least: int = LEAST, top: int = TOP, dominated: int = DOMINATED) -> str:
    """DuckDB SQL for the rows of ``mine`` over ``documents`` with phrases of 2 and 3 words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest(list_transform(list_zip(w, w[2:], true), lambda x: x[1] || ' ' || x[2])) FROM pieces
  UNION ALL SELECT lang, 3, unnest(list_transform(list_zip(w, w[2:], w[3:], true), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) FROM pieces),
f AS (SELECT lang, phrase, k, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
longer AS (
  SELECT lang, phrase, max(a) AS f FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < {dominated} * a),
places AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS place FROM kept),
halves AS (SELECT lang, phrase, a, place, array_to_string(w[1:place], ' ') AS first, array_to_string(w[place + 1:], ' ') AS rest FROM places),
cuts AS (
  SELECT h.lang, h.phrase, a, x.f AS l, y.f AS r, place, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.first JOIN f y ON y.lang = h.lang AND y.phrase = h.rest),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) AS o FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE o = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= {top}
"""
