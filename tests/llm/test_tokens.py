import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tesselon.llm import sentencepiece_codec, token_counts, token_files
from tesselon.llm.common import chunks


def odd_texts():
    rng = random.Random(7)
    texts = ["", "a", " ", "   ", "\n", "a" * 3000, "<|endoftext|>x<|endoftext|>", "x <|endoftext|> y <|ENDOFTEXT|>", "don't we'll I'M x'S", "日本語テキスト、漢字かな。" * 20, "▁▁ a ▁b", "🎉🎉 👩‍👩", "\x00\x01", "tab\t\ttab  \n\n x", "12,5 ½²", "é é É Å", "İstanbul ΣΑΣ ΑΣ\tΣ", "ﬁ Ⅷ ǅ K", "<s> </s> <unk> <0x41>", "a\x1cb\x85c　d"]
    texts += ["".join(rng.choice("aBΣς \n\t é▁日<|>'s1.,$ ́\x1cİILS") for _ in range(rng.randint(0, 60))) for _ in range(1000)]
    return texts + ["".join(chr(rng.choice([rng.randint(32, 0x24FF), rng.randint(0x3040, 0x9FFF)])) for _ in range(rng.randint(0, 30))) for _ in range(1000)]


def test_counts_equal_the_library():
    path = public_tokenizers.path(token_counts.VOCABULARY)
    texts = odd_texts()
    expected = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.merger(path).tokens(texts) == expected


def test_counts_over_documents(documents, awkward, empty):
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    for df in (documents, awkward):
        texts = {(r["doc_id"], r["text"]) for r in df.collect()}
        expected = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
        got = {(str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df).collect()}
        assert got == set(expected)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in token_counts.token_counts(documents).collect())
    assert token_counts.token_counts(empty).count() == 0


def test_pieces_equal_the_library(monkeypatch):
    path = public_tokenizers.path(sentencepiece_codec.VOCABULARY)
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    texts = odd_texts()
    ids = library.encode(texts, num_threads=1)
    expected = [",".join(map(str, i)).encode() for i in ids], [library.decode(i).encode() for i in ids]
    assert codec.encode(pa.array(texts)) == expected
    monkeypatch.setattr(sentencepiece_codec, "_SHORT", 0)
    codec.known.clear()
    codec.known_parts.clear()
    assert codec.encode(pa.array(texts)) == expected == codec.encode(pa.array(texts))
    assert max(map(len, [*codec.known, *codec.known_parts])) <= sentencepiece_codec.LONGEST


def test_the_library_decides_where_ids_should_differ(monkeypatch):
    path = public_tokenizers.path(sentencepiece_codec.VOCABULARY)
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.PieceCodec(path)
    monkeypatch.setattr(codec, "ids", lambda word: [codec.byte[x] for x in word.encode()])
    monkeypatch.setattr(codec, "decode", lambda ids: "wrong")
    texts = ["some words, here", "two  spaces", "", "日本 x\n\ny"]
    ids = library.encode(texts)
    assert codec.encode(pa.array(texts)) == ([",".join(map(str, i)).encode() for i in ids], [library.decode(i).encode() for i in ids])


def test_pieces_over_documents(documents, awkward, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.VOCABULARY))
    for df in (documents, awkward):
        texts = {(r["doc_id"], r["text"]) for r in df.collect()}
        expected = set()
        for i, t in texts:
            ids = library.encode(t or "")
            expected.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert set(map(tuple, sentencepiece_codec.digest_documents(df).collect())) == expected
    row = sentencepiece_codec.encode_documents(awkward.filter("doc_id = 1")).first()
    assert list(row["ids"]) == library.encode("one two three four five") and row["decoded"] == "one two three four five"
    assert sentencepiece_codec.digest_documents(empty).count() == 0


def test_word_tokenizer_equals_the_library():
    path = public_tokenizers.path(token_files.VOCABULARY)
    texts, words = odd_texts(), token_files.WordTokenizer(path)
    expected = [e.ids + [token_files.END_ID] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, words.width).tolist() for x in words.encode(pa.array(texts)).to_pylist()] == expected
    sliced = words.encode(pa.array(["left out", *texts]).slice(1)).to_pylist()
    assert [np.frombuffer(x, words.width).tolist() for x in sliced] == expected
    assert max(map(len, [*words.known, *words.known_parts])) <= token_files.LONGEST


def test_chunks_without_a_new_word(spark):
    """Words that are all known already, only odd ones, and none at all."""
    words, library = token_files.WordTokenizer(public_tokenizers.path(token_files.VOCABULARY)), Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    for texts in (["hello world"], ["hello world"], ["hello"], ["\U0001f389"] * 3, ["\U0001f389 hello"], ["", " "], [""], ["\U0001f389"]):
        expected = [e.ids + [token_files.END_ID] for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, words.width).tolist() for x in words.encode(pa.array(texts)).to_pylist()] == expected
    n = len(library.encode("hello world", add_special_tokens=False).ids) + 1
    same = spark.range(20_001).selectExpr("id AS doc_id", "'hello world' AS text").coalesce(1)
    emoji = spark.range(3).selectExpr("id AS doc_id", "'\U0001f389' AS text").coalesce(1)
    for _ in range(2):
        got = token_files.store_and_read(same).collect()
        assert len(got) == 20_001 and {r["n_tokens"] for r in got} == {n} and max(r["start"] for r in got) == 20_000 * n
        assert token_files.store_and_read(emoji).count() == 3


def test_the_query_runs_twice_in_a_session(documents):
    first, second = (sorted(map(tuple, token_files.store_and_read(documents).collect())) for _ in range(2))
    assert first == second


def test_count_memory_forgets_long_parts():
    merger = token_counts.PairMerger(public_tokenizers.path(token_counts.VOCABULARY))
    long = "x" * 5000
    assert merger.tokens([long, f"a {long}"]) == merger.tokens([long, f"a {long}"]) and max(map(len, merger.known)) <= token_counts.LONGEST


def test_other_vocabularies_are_refused(tmp_path):
    for module, kind in ((token_files, token_files.WordTokenizer), (token_counts, token_counts.PairMerger)):
        with open(public_tokenizers.path(module.VOCABULARY), encoding="utf-8") as f:
            spec = json.load(f)
        spec["pre_tokenizer"] = {"type": "Whitespace"}
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec), encoding="utf-8")
        with pytest.raises(ValueError):
            kind(str(other))


@pytest.mark.parametrize("n", [1, 31, 32 * 512, 32 * 512 + 1, 100_000, 1_200_000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n) * 7, 49_000).astype(np.int64)
    found, counts = np.unique(ids, return_counts=True)
    coder = token_files.RangeCoder(found, counts)
    payload = coder.encode(ids, np.array([n]))
    back, lengths = coder.decode(payload)
    assert (back == ids).all() and lengths.tolist() == [n]
    _, lanes, _, steps, segments, count, _ = token_files._HEAD.unpack_from(payload)
    part, _ = coder.decode(payload, range(segments - 1, segments))
    assert (part == ids[(segments - 1) * lanes * steps :]).all() and count == n
    if n > 10_000:
        assert len(payload) < 1.3 * n
        # A changed state and a changed word of the first segment lead to other ids.
        states = token_files._HEAD.size + 4
        for at in (states, states + 8 * segments * lanes + 4 * (2 * segments + 1)):
            broken = bytearray(payload)
            broken[at] ^= 255
            with pytest.raises(ValueError):
                coder.decode(bytes(broken))


def test_store_over_documents(documents, awkward, empty, spark):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    rows, start, expected = documents.orderBy("doc_id").collect(), 0, []
    for r in rows:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.store_and_read(documents.repartition(5)).collect())) == expected
    got = sorted(token_files.store_and_read(awkward).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert token_files.store_and_read(empty).count() == 0


def test_a_worker_forgets_the_pieces_when_another_operator_begins():
    path = public_tokenizers.path(sentencepiece_codec.VOCABULARY)
    batch = pa.record_batch([pa.array(["some words"])], ["text"])
    codec = sentencepiece_codec.codec(path)
    list(chunks([batch], "text", memory="pieces"))
    assert sentencepiece_codec.codec(path) is codec
    list(chunks([batch], "text"))
    assert sentencepiece_codec.codec.cache_info().currsize == 0
