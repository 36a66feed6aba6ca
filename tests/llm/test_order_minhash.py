import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tesselon.llm import order_minhash as omh


def got(df):
    return {r["doc_id"]: r for r in omh.compare_edited(df).collect()}


def test_edited_text_equals_brute_force(documents):
    rows = sorted(documents.collect(), key=lambda r: -r["doc_id"])
    found = got(documents)
    for r, following in zip(rows, rows[1:] + rows[:1], strict=True):
        text, other = r["text"] or "", following["text"] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert found[r["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[r["doc_id"]]["n_chars"] == len(text) and found[r["doc_id"]]["next_id"] == following["doc_id"]
    assert sum(r["near_edited"] for r in found.values()) / len(found) > 0.2
    assert sum(r["near_next"] for r in found.values()) / len(found) < 0.05


def spark_hash(*values):
    """Spark's xxhash64: each value hashed with the hash of those before it as the seed; nulls change nothing."""
    seed = 42
    for kind, v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<" + kind, v), seed)
    return seed


def signed(x, bits=64):
    return x - (1 << bits) if x >> (bits - 1) else x


def brute_signature(text, places=24):
    """The definition over plain tuples: {range: hash of its least numbered k-mers in text order}."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, ranges = {}, {}
    coarser = max(0, max(0, len(words) - 1).bit_length() - places)
    for i in range(max(min(len(words), 1), len(words) - omh.K + 1)):
        gram = tuple(words[i : i + omh.K])
        seen[gram] = seen.get(gram, 0) + 1
        own = spark_hash(*(("q", signed(spark_hash(("s", w)))) for w in gram)) >> 24
        numbered = spark_hash(("q", signed(own, 40)), ("i", seen[gram])) >> 24
        ranges.setdefault(numbered >> 35, []).append((numbered, i >> coarser))
    out = {}
    for k, entries in ranges.items():
        least = sorted(entries)[: omh.TUPLE]
        rest = [h & (1 << 35) - 1 for h, _ in sorted(least, key=lambda e: (e[1], e[0]))]
        out[k] = spark_hash(*(("q", r) for r in rest)) >> 32
    return out


def written(signature):
    order = sorted(signature, key=lambda k: signed(k, 5))
    return "".join(f"{k << 32 | signature[k]:010x}" for k in order)


def alike(a, b):
    ranges = set(a) | set(b)
    return sum(a.get(k) == b.get(k) for k in ranges) / len(ranges) if ranges else 1.0


def test_fingerprints_equal_brute_force(documents):
    rows = sorted(documents.collect(), key=lambda r: -r["doc_id"])
    found = got(documents)
    for r, following in list(zip(rows, rows[1:] + rows[:1], strict=True))[:60]:
        text, other = r["text"] or "", following["text"] or ""
        cut = len(text) // 3
        own, edited, after = map(brute_signature, (text, text[: len(text) - cut] + other[:cut], other))
        f = found[r["doc_id"]]
        assert (f["fingerprint"], f["edited_fingerprint"]) == (written(own), written(edited))
        assert f["near_edited"] == pytest.approx(alike(own, edited)) and f["near_next"] == pytest.approx(alike(own, after))


def test_positions_beyond_their_bits_get_coarser(spark, monkeypatch):
    monkeypatch.setattr(omh, "_PLACES", 3)
    texts = [" ".join(f"w{i % 50}" for i in range(n)) for n in (1, 7, 8, 9, 100, 1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = omh.signatures(df, "text", "sig").select("doc_id", omh.fingerprint(F.col("sig")).alias("f")).collect()
    assert {r["doc_id"]: r["f"] for r in rows} == {k: written(brute_signature(t, 3)) for k, t in enumerate(texts)}


def test_occurrence_numbers_and_order_matter(spark):
    text = " ".join(f"w{i}" for i in range(40))
    halves = text.split()
    swapped = " ".join(halves[20:] + halves[:20])
    doubled = text + " " + text
    df = spark.createDataFrame([(3, text), (2, text), (1, swapped), (0, doubled)], "doc_id int, text string")
    r = got(df)
    assert r[3]["fingerprint"] == r[2]["fingerprint"] and r[3]["near_next"] == 1.0
    assert 0 < r[2]["near_next"] < 1  # the same words in another order
    assert r[1]["near_next"] < 1
    assert r[0]["fingerprint"] == written(brute_signature(doubled))


def test_numbered_kmers_decide_the_signature(spark):
    """Two texts with the same set of k-mers but other counts differ; the same bag in the same order does not."""
    df = spark.createDataFrame([(2, "a a a a"), (1, "a a a a a a"), (0, "a  a\ta\na")], "doc_id int, text string")
    r = got(df)
    assert r[2]["fingerprint"] == r[0]["fingerprint"] != r[1]["fingerprint"]


def test_awkward_rows(awkward, empty):
    df = omh.compare_edited(awkward)
    rows = df.collect()
    assert len(rows) == awkward.count() and omh.compare_edited(empty).count() == 0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 1}) == 1
    assert [r["fingerprint"] for r in rows if r["doc_id"] == 4] == [""]


def test_single_document(spark):
    r = got(spark.createDataFrame([(9, "abcdef")], "doc_id int, text string"))[9]
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0
