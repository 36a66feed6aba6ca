"""Quality scores by supervised subword embeddings.

A text is the bag of its words, its pairs of neighbouring words and its character n-grams, each hashed to
a bucket with a learned vector. The average of the vectors passes a linear layer and a softmax. Vectors
and layer are trained by stochastic gradient descent in numpy, in one task, on a bounded sample of the
labelled rows; scoring covers every whole text. An immediate repetition of a word is the same pair
whatever the word, so that repetition can be learned from any vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import chunks, text_or_empty

BUCKET_BITS, DIM, GRAMS = 15, 8, (2, 4)
#: Bytes of text, or characters of a longer text, hashed at a time; each needs some hundred bytes of arrays.
STEP_BYTES = 1 << 18
#: Labelled rows that training uses at most.
MAX_ROWS = 4096
FOLDS, THRESHOLD = 5, 0.3
EPOCHS, RATE, VECTOR_RATE, SEED = 6, 4.0, 20, 11
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _inside(points: np.ndarray) -> np.ndarray:
    """Which characters belong to words."""
    return (points != 32) & ((points < 9) | (points > 13))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and of its inverse."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    steps = [np.full(n + 1, b, np.uint64) for b in (_BASE, inverse)]
    for s in steps:
        s[0] = 1
    return np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _grams(wide: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(0, len(wide) - n + 1), n, np.uint64)
    for k in range(n):
        h = (h + wide[k : len(h) + k]) * _BASE
    return h


def _spans(wide: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of each word: the sum of its characters times powers of the base."""
    up, down = _powers(len(wide))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wide * up[:-1], dtype=np.uint64)))
    return (total[stop] - total[start]) * down[start]


def _pairs(word: np.ndarray) -> np.ndarray:
    return np.where(word[1:] == word[:-1], np.uint64(1), word[1:] * _BASE + word[:-1])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, and the number of the text that each belongs to; texts in order per kind."""
    data = _points("".join(texts))
    doc = np.repeat(np.arange(len(texts)), np.array([len(t) for t in texts], np.int64))
    found, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    wide = data.astype(np.uint64) + np.uint64(1)
    for n in GRAMS:
        h = _grams(wide, n)
        same = doc[n - 1 :] == doc[: len(h)]
        found.append(_bucket(h)[same])
        owner.append(doc[: len(h)][same])
    if len(data):
        inside = _inside(data)
        edge = np.concatenate(([True], doc[1:] != doc[:-1]))
        start = np.flatnonzero(inside & (edge | ~np.concatenate(([False], inside[:-1]))))
        stop = np.flatnonzero(inside & np.concatenate((edge[1:] | ~inside[1:], [True]))) + 1
        word = _spans(wide, start, stop)
        same = doc[start[1:]] == doc[start[:-1]]
        found += [_bucket(word), _bucket(_pairs(word))[same]]
        owner += [doc[start], doc[start[1:]][same]]
    return np.concatenate(found), np.concatenate(owner)


def windows(text: str, step: int = STEP_BYTES) -> Iterator[np.ndarray]:
    """The buckets of one text's features in several arrays, each from ``step`` characters.

    A word that goes on in the next window is carried along with its hash and length so far.
    """
    held, length, last = np.zeros(1, np.uint64), 0, np.zeros(0, np.uint64)
    for at in range(0, len(text), step):
        wide = _points(text[at : at + step + max(GRAMS) - 1]).astype(np.uint64) + np.uint64(1)
        for n in GRAMS:
            yield _bucket(_grams(wide[: step + n - 1], n))
        wide = wide[:step]
        inside = np.concatenate(([False], _inside(wide - np.uint64(1)), [False]))
        start, stop = np.flatnonzero(inside[1:] > inside[:-1]), np.flatnonzero(inside[1:] < inside[:-1])
        word, size = _spans(wide, start, stop), stop - start
        if length and len(start) and start[0] == 0:
            word[:1] = held + word[:1] * np.uint64(pow(int(_BASE), length, 1 << 64))
            size[0] += length
        elif length:
            word, size = np.concatenate((held, word)), np.append(length, size)
        length = 0
        if inside[-2] and at + step < len(text):
            held, length, word = word[-1:], int(size[-1]), word[:-1]
        yield _bucket(word)
        word = np.concatenate((last, word))
        yield _bucket(_pairs(word))
        last = word[-1:]


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Softmax weights folded into one number a bucket, and the bias last: the log-odds of label 1.

    ``bags`` holds the buckets and their shares of each labelled text. Each step is one text. Shares of a
    text's buckets are small, so the vectors move ``VECTOR_RATE`` times the rate.
    """
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << BUCKET_BITS, DIM)) - 0.5) / DIM
    layer, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            own = vectors[ids]
            hidden = share @ own
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = layer @ p
            layer -= 0.1 * rate * np.outer(hidden, p)
            bias -= 0.02 * rate * p
            vectors[ids] = own - rate * VECTOR_RATE * share[:, None] * step
    folded = vectors @ (layer[:, 1] - layer[:, 0])
    return np.append(folded, bias[1] - bias[0]).astype(np.float64)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features and the share of each."""
    n = np.zeros(1 << BUCKET_BITS, np.int64)
    for part in windows(text) if len(text) > STEP_BYTES else [features([text])[0]]:
        n += np.bincount(part, minlength=len(n))
    ids = np.flatnonzero(n)
    return ids, n[ids] / max(1, n.sum())


def scores(texts: list[str], model: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each text; a text without features gets that of the bias."""
    mean = np.zeros(len(texts))
    short = np.array([k for k, t in enumerate(texts) if len(t) <= STEP_BYTES], np.int64)
    buckets, owner = features([texts[k] for k in short])
    n = np.bincount(owner, minlength=len(short))
    mean[short] = np.bincount(owner, weights=model[buckets], minlength=len(short)) / np.maximum(n, 1)
    for k in set(range(len(texts))).difference(short.tolist()):
        ids, share = bag(texts[k])
        mean[k] = share @ model[ids]
    return 1 / (1 + np.exp(-np.clip(mean + model[-1], -700, 700)))


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text (null: the empty text) modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray | None:
    """Train on at most ``max_rows`` labelled texts outside fold 0, chosen by the hash of their id.

    The sample of ids is bounded and so may be broadcast; a text passes on at most one number for each
    of its buckets. Ids with contradicting labels count as label 0. None if no row has a label.
    """
    wanted = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", STEP_BYTES):
            bags = [bag(t) for t in part.column("text").to_pylist()]
            columns = [pa.array([b[k] for b in bags], t) for k, t in ((0, pa.list_(pa.int32())), (1, pa.list_(pa.float32())))]
            yield pa.record_batch([part.column("doc_id"), part.column("y"), *columns], ["doc_id", "y", "ids", "share"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for doc_id, y, ids, share in zip(*(b.column(c) for c in ("doc_id", "y", "ids", "share")), strict=True):
                rows.append((str(doc_id.as_py()), y.as_py(), np.asarray(ids.values), np.asarray(share.values)))
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        if rows:
            model = train([(r[2], r[3]) for r in rows], np.array([r[1] for r in rows]))
            yield pa.record_batch([pa.array([model.tobytes()], pa.binary())], ["model"])

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    bags = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(reduce, f"doc_id {kind}, y int, ids array<int>, share array<float>")
    # A label names one document; should ids repeat, the bound holds for the rows too.
    found = bags.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).coalesce(1).mapInArrow(learn, "model binary").collect()
    return np.frombuffer(found[0]["model"], np.float64) if found else None


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    ``score`` is the estimated probability of quality label 1; ``predicted`` is 1 from ``threshold`` on.
    Texts of fold 0 (``held_out``) are not learned from. Null texts count as empty and get the score of
    the bias alone. Without any label all scores are 0.5. Null ids, which count as the empty text for
    the fold, and repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    model = _model(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", STEP_BYTES):
            yield pa.record_batch([part.column("doc_id"), pa.array(scores(part.column("text").to_pylist(), model))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def _model(docs: DataFrame, labels: DataFrame, max_rows: int) -> np.ndarray:
    model = fit(docs, labels, max_rows)
    return np.zeros((1 << BUCKET_BITS) + 1) if model is None else model


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, as they are, in one pass without a shuffle."""
    model, names = _model(docs, labels, max_rows), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", STEP_BYTES):
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield part.filter(pa.array(scores(texts, model) >= threshold))

    return docs.select(*names).mapInArrow(run, docs.schema)
