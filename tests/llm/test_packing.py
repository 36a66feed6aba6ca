import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesselon.llm import packing


def first_fit(lengths, capacity):
    """First-fit decreasing by looking at all bins."""
    bins = []
    for n, d in sorted(((n, d) for d, n in enumerate(lengths)), key=lambda x: (-x[0], x[1])):
        for b in bins:
            if sum(m for m, _ in b) + n <= capacity:
                b.append((n, d))
                break
        else:
            bins.append([(n, d)])
    return bins


def test_the_tree_finds_the_first_bin_with_room():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 100, rng.integers(1, 60)).tolist()
        assert packing.packed(lengths, 100, 100) == [[(d, 0, n) for n, d in b] for b in first_fit(lengths, 100)]


def check(lengths, sequences, capacity, slack):
    held = sorted(p for s in sequences for p in s)
    for d, n in enumerate(lengths):
        own, at = [p for p in held if p[0] == d], 0
        for _, start, length in own:
            assert start == at and length > 0
            at += length
        assert at == n
    for s in sequences:
        n = sum(p[2] for p in s)
        assert n <= capacity and (capacity - n <= slack or n & (n - 1) == 0)


@pytest.mark.parametrize("slack", [0, 3, 8])
def test_every_token_lies_in_one_piece_and_little_is_padded(slack):
    rng = np.random.default_rng(slack)
    for kind in range(4):
        for size in (1, 2, 7, 150):
            lengths = [rng.integers(1, 64, size), rng.integers(33, 40, size), rng.integers(1, 500, size), np.full(size, 64 * int(rng.integers(1, 3)))][kind].tolist()
            check(lengths, packing.packed(lengths, 64, slack), 64, slack)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[5], r[6]))


def holds(got, docs, capacity):
    """Pieces give back each document's ids, and sequences have neither gaps nor more padding than there may be."""
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    wanted = sorted((str(i), tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in docs)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    by_id = {}
    for i, ids in wanted:
        by_id.setdefault(i, []).append(ids)
    assert sum(r[2] for r in got) == sum(len(ids) for _, ids in wanted)
    for doc, start, length, found, total, _, _ in got:
        assert any(len(ids) == total and crc(ids[start : start + length]) == found for ids in by_id[str(doc)])
    sequences = {}
    for r in got:
        assert r[6] == sequences.get(r[5], 0)
        sequences[r[5]] = r[6] + r[2]
    assert all(n <= capacity for n in sequences.values())
    return sum(capacity - n for n in sequences.values() if n & (n - 1))


def test_documents_are_packed(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = rows_of(packing.pack(documents.repartition(3)))
    padded = holds(got, docs, packing.CAPACITY)
    assert padded <= 0.003 * sum(r[2] for r in got)
    starts = {}
    for doc, start, length, *_ in sorted(got):
        assert start == starts.get(doc, 0)
        starts[doc] = start + length
    assert len(starts) == len(docs)


def test_small_groups_and_awkward_rows(awkward, empty):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for group in (1, 3, 4096):
        found = packing.pack(awkward, capacity=64, group=group, slack=0)
        assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert holds(rows_of(found), docs, 64) == 0
    assert packing.pack(empty).count() == 0
