import math
import re
from collections import Counter

import pytest

from tesselon.llm import lexical
from tests.llm.conftest import SF


def words(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def brute(docs, items, k=10):
    """Each item's scores of all documents in whole numbers."""
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c, size in held:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_terms():
    assert [w.decode() for w in sum(lexical.terms("Ab-c1 ÉÀ_x\x00日本,İ A"), [])] == words("Ab-c1 ÉÀ_x\x00日本,İ A") == ["ab", "c1", "ÉÀ", "x", "日本", "İ", "a"]
    assert list(lexical.terms("")) == []


def test_long_texts_are_listed_in_windows(monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", 7)
    text = "one two  three-four " * 20 + "x" * 50 + " end"
    assert [w.decode() for part in lexical.terms(text) for w in part] == words(text)


@pytest.mark.parametrize("block,batch_bytes", [(lexical.BLOCK, lexical.BATCH_BYTES), (60, 200)])
def test_ranks_equal_brute_force(spark, documents, monkeypatch, block, batch_bytes):
    monkeypatch.setattr(lexical, "BLOCK", block)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    expected = brute([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert rows(lexical.search(documents, benchmark, batch_bytes=batch_bytes)) == expected


def test_awkward_rows(spark, awkward, empty):
    items = spark.createDataFrame([(1, "one TWO word3 word3"), (1, "日本語"), (2, None), (3, ""), (None, "com x"), (4, "not there at all"), (5, "five"), (5, "five")], "item_id int, text string").selectExpr("*", "item_id AS doc_id", "1 AS score")
    expected = brute([(r["doc_id"], r["text"]) for r in awkward.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    found = lexical.search(awkward, items)
    assert rows(found) == expected and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert {r["rank"] for r in found.filter("item_id = 1").collect()} == set(range(1, 7))
    assert lexical.search(empty, items).count() == 0 == lexical.search(awkward, items.limit(0)).count()


def test_ties_go_by_id_however_many_there_are(spark):
    docs = spark.range(500).selectExpr("499 - id AS doc_id", "'same words here' AS text").repartition(7)
    items = spark.createDataFrame([("a", "words"), ("b", "here other")], "item_id string, text string")
    more = docs.unionAll(spark.createDataFrame([(1000, "something else")], "doc_id long, text string"))
    found = rows(lexical.search(more, items))
    assert len(found) == 20
    for item in "ab":
        assert [r[2] for r in sorted((r for r in found if r[0] == item), key=lambda r: r[1])] == list(range(10))
