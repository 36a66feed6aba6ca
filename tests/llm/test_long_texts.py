"""Every operator on texts of over ten million characters among short ones."""

import random

import pytest

from tesselon.llm import html_text, mixing, order_minhash, pii, quality, sentencepiece_codec, simhash, token_counts, token_files

SIZE = 10_500_000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    words += ["+1 (743) 555-3824", "a.b@c.example", "日本語", "don't", "x.y,z;"]
    out, size = [], 0
    while size < SIZE:
        out.append(rng.choice(words))
        size += len(out[-1]) + 1
    return {1: " ".join(out), 2: "a short text of seven words here", 3: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    folder = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    return folder.repartition(3, "doc_id")


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_long_texts_are_worked_on_whole(spark, docs, texts):
    n_words = len(texts[1].split())
    found = rows(pii.find(docs))[1]
    assert found["n_phone"] > 0, found
    assert found["n_email"] == sum(t == "a.b@c.example" for t in texts[1].split()), found
    assert rows(mixing.mix(docs))[1]["size"] == n_words
    signed = rows(order_minhash.compare_edited(docs))
    assert signed[1]["n_chars"] == len(texts[1]) and len(signed[1]["fingerprint"]) == 10 * order_minhash.BUCKETS
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert 0 <= rows(quality.score_documents(docs, labels))[1]["score"] <= 1
    assert rows(token_counts.token_counts(docs))[1]["n_tokens"] > n_words
    assert rows(sentencepiece_codec.digest_documents(docs))[1]["n_tokens"] > n_words
    assert rows(token_files.store_and_read(docs))[1]["n_tokens"] > n_words
    assert int(rows(simhash.near_duplicates(docs))[1]["fingerprint"], 16) == simhash.simhash(texts[1].encode())
    page = f"<body><nav><a href=1>x</a></nav><article><p>{texts[1]}</p></article></body>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html_text.extract(pages).first()["n_chars"] == len(" ".join(texts[1].split()))
