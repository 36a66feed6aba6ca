import re
import zlib

import numpy as np
import pytest

from tesselon.llm import quality
from tests.llm.conftest import SF


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert all(p["held_out"] == (zlib.crc32(str(p["doc_id"]).encode()) % 5 == 0) for p in got.values())
    good = [p["score"] for p, y in held if y == 1]
    bad = [p["score"] for p, y in held if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9 and sum(s >= 0.3 for s in good) >= 0.95 * len(good)


def test_training_is_repeatable(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a, b = (quality.fit(d, labels) for d in (documents, documents.repartition(5)))
    assert (a == b).all()


def brute_features(text):
    """The features of one text in plain Python integers: word, pair and character n-gram buckets."""
    base, mix, whole = int(quality._BASE), int(quality._MIX), (1 << 64) - 1
    bucket = lambda h: (h * mix & whole) >> (64 - quality.BUCKET_BITS)
    out = []
    for n in quality.GRAMS:
        for at in range(len(text) - n + 1):
            h = n
            for c in text[at : at + n]:
                h = (h + ord(c) + 1) * base & whole
            out.append(bucket(h))
    words = [sum((ord(c) + 1) * pow(base, k, 1 << 64) for k, c in enumerate(w)) & whole for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    out += [bucket(h) for h in words]
    return out + [bucket(1 if a == b else b * base + a & whole) for a, b in zip(words, words[1:], strict=False)]


TEXTS = ["", " ", "a", "one two two three", "  é日本\t日本 日本\n\U0001f389x ", "x" * 50, "ab cd " * 9 + "y" * 20]


def test_features_equal_brute_force():
    buckets, owner = quality.features(TEXTS)
    for k, text in enumerate(TEXTS):
        assert sorted(buckets[owner == k]) == sorted(brute_features(text))


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_windows_lose_nothing_and_count_nothing_twice(step):
    for text in TEXTS:
        assert sorted(np.concatenate([np.zeros(0, int), *quality.windows(text, step)])) == sorted(brute_features(text))


def test_long_texts_score_like_short_ones(monkeypatch):
    model = quality.train([quality.bag(t) for t in ("good text here", "$$ bad $$ bad")], np.array([1, 0]))
    texts = ["good text " * 40, "a", "$$ bad" * 30]
    whole = quality.scores(texts, model)
    monkeypatch.setattr(quality, "STEP_BYTES", 16)
    assert list(quality.scores(texts, model)) == pytest.approx(list(whole))


def test_training_lowers_the_loss_like_plain_gradients():
    """The first step of a one-text training against gradients worked out by differences."""
    ids, share = quality.bag("one two")

    def log_odds(model):
        return share @ model[ids] + model[-1]

    up, down = (quality.train([(ids, share)], np.array([y])) for y in (1, 0))
    assert log_odds(up) > 1 and log_odds(down) < -1


def test_batches_do_not_change_scores():
    model = quality.train([quality.bag(t) for t in ("good text here", "$$ bad $$ bad")], np.array([1, 0]))
    texts = ["good text", "", "$$ bad", "é日本", "a", " "]
    together = quality.scores(texts, model)
    assert [float(quality.scores([t], model)[0]) for t in texts] == pytest.approx(list(together))


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    got = quality.score_documents(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_documents(empty, labels).count() == 0
    unlabelled = quality.score_documents(awkward, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    kept = quality.keep_good(awkward, labels, threshold=0.0)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
