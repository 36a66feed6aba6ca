import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tesselon.llm import phrases
from tests.llm.conftest import SF


def brute(rows, lengths=3, least=10, top=2000, dominated=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", small):
            own = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(own)
            for k in range(1, lengths + 1):
                for i in range(len(own) - k + 1):
                    f[lang, tuple(own[i : i + k])] += 1
    often = {p for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for lang, p in often:
        a = f[lang, p]
        inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(o == lang and len(q) > len(p) and inside(q) and 100 * f[o, q] >= dominated * a for o, q in often):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, k, *r[1:]) for k, r in enumerate(own[:top], 1)]
    return sorted(ranked)


def texts(seed, rows=40):
    rng = np.random.default_rng(seed)
    names = ["a", "B", "c", "dé", "e-f", "日本", "g", "É", "x1"]
    end = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!\r", ";"]
    out = []
    for _ in range(rows):
        words = rng.zipf(1.5, rng.integers(0, 60)) % len(names)
        out.append((["en", "de", None, "xx\ty"][rng.integers(0, 4)], "".join(names[w] + end[rng.integers(0, len(end))] for w in words)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("RELATION", 8), ("HELD", 30), ("HELD_WORDS", 30), ("WORDS", 3), ("BUCKETS", 3)):
            monkeypatch.setattr(phrases, name, value)
    rows = texts(1)
    docs = spark.createDataFrame([(i, *r, "n", 1) for i, r in enumerate(rows)], "doc_id int, lang string, text string, n string, f int").repartition(3)
    got = sorted(map(tuple, phrases.mine(docs, least=4).collect()))
    assert got == brute(rows, least=4) and len(got) > 20


@pytest.mark.parametrize("lengths,top,dominated", [(2, 5, 50), (4, 2000, 80)])
def test_other_lengths_and_limits(spark, lengths, top, dominated):
    rows = texts(2)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.mine(docs, lengths, 3, top, dominated).collect())) == brute(rows, lengths, 3, top, dominated)


def test_a_full_bitmap_leaves_out_nothing(spark, monkeypatch):
    real = phrases.bitmap

    def full(occurrences, k, least, shorter, buckets):
        return occurrences.sparkSession.sparkContext.broadcast(np.full_like(real(occurrences, k, least, shorter, buckets).value, 255))

    monkeypatch.setattr(phrases, "bitmap", full)
    rows = texts(3)
    assert sorted(map(tuple, phrases.mine(spark.createDataFrame(rows, "lang string, text string"), least=4).collect())) == brute(rows, least=4)


def test_awkward_rows(spark, awkward, empty):
    docs = awkward.selectExpr("*", "CASE WHEN doc_id > 4 THEN 'en' END AS lang")
    got = phrases.mine(docs, least=2)
    assert sorted(map(tuple, got.collect())) == brute([(r["lang"], r["text"]) for r in docs.collect()], least=2)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.mine(docs.limit(0)).count() == 0 == phrases.mine(docs.filter("text IS NULL")).count()


def test_counts_beyond_64_bits(spark):
    """Scores of phrases with counts of 10^12: their squares do not fit a long."""
    whole = lambda c: f"cast({c} AS decimal(19, 0))"
    a, lr = 987_654_321_012, (999_999_999_999, 1_234_567_890_123)
    got = spark.sql(f"SELECT ({whole(a)} * {whole(a)} * cast(1000000 AS decimal(7, 0))) div ({whole(lr[0])} * {whole(lr[1])}) AS s").first()["s"]
    assert got == 1_000_000 * a * a // (lr[0] * lr[1])


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = sorted(con.execute(phrases.mine_sql()).fetchall())
    assert sorted(map(tuple, phrases.mine(spark.read.parquet(f"{SF}/documents.parquet")).collect())) == expected


def test_spark_moves_few_bytes_for_an_occurrence(spark):
    """Arrays of numbers took over four bytes an occurrence in every task's batch, and as many again while Spark built it."""
    rng = np.random.default_rng(4)
    rows = [("en", " ".join(f"w{w}" for w in rng.zipf(1.3, 2000) % 5000)) for _ in range(40)] + [("de", " . ")]
    found = phrases.relation(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    assert not [c for c, kind in found.dtypes if kind.startswith("array")]
    kept = found.filter("n > 0").collect()
    assert sum(len(r["words"]) + len(r["places"]) for r in kept) < 3 * sum(r["n"] for r in kept)
    assert sum(r["n"] for r in kept) == 80_000 and found.filter("n = 0").count() == 1
    for r in kept:
        hashes, word, ends = phrases._unpacked(r["places"])
        assert len(word) == r["n"] == ends[-1] and len(hashes) == word.max() + 1
