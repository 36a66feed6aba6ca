"""Token counts of byte-level BPE vocabularies by rank-synchronous array merging.

The distinct pre-tokens of a batch that are not yet known lie end to end in one ragged array of symbols.
In each round every pre-token merges all occurrences of its own lowest-rank pair at once; pre-tokens
without a known pair are finished, and the symbols they are left with are their tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tesselon.llm.common import chunks, text_or_empty

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Pre-tokens that a worker remembers at most, and the longest of them that it does; the memory is emptied when it is full.
REMEMBERED, LONGEST = 1 << 18, 64
# The published split pattern of this vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.iinfo(np.int64).max


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairMerger:
    """Counts of the symbols that are left when all ranked pairs of a byte string are merged."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        way = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or (way.get("type"), way.get("add_prefix_space"), way.get("use_regex")) != ("ByteLevel", False, True) or any(model.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "ignore_merges")) or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only byte-level vocabularies that split texts like {VOCABULARY} are supported")
        self.first = np.zeros(256, np.int64)
        for symbol, byte in _byte_symbols().items():
            self.first[byte] = ids[symbol]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.width = max(ids.values()) + 1
        pair = np.array([ids[a] * self.width + ids[b] for a, b in merges], np.int64)
        order = np.argsort(pair)
        self.pair, self.rank = pair[order], order
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], _NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each of the byte strings, none of them empty."""
        out = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), out)
        while len(symbols) > 1:
            rank = np.where(word[1:] == word[:-1], self.ranks(symbols[:-1], symbols[1:]), _NONE)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(np.append(rank, _NONE), starts)
            sizes = np.diff(np.append(starts, len(word)))
            chosen = np.repeat(best, sizes)[:-1]
            hit = np.flatnonzero((rank == chosen) & (rank != _NONE))
            if not len(hit):
                break
            # Of overlapping occurrences, as in a run of one symbol, every second one counts.
            run = np.concatenate(([True], np.diff(hit) > 1))
            first = hit[run][np.cumsum(run) - 1]
            hit = hit[(hit - first) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            out -= np.bincount(word[hit], minlength=len(out))
            keep = np.repeat(best != _NONE, sizes)
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        return out

    def tokens(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; special strings inside it count as one token each."""
        pieces, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            pieces.append([w for p in parts for w in self.split.findall(p)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*pieces).difference(self.known))
        if new:
            self.known.update(zip(new, self.count([w.encode() for w in new]).tolist(), strict=True))
        out = [n + sum(map(self.known.__getitem__, words)) for n, words in zip(extra, pieces, strict=True)]
        for word in new:
            if len(word) > LONGEST:
                del self.known[word]
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    ``path`` is a byte-level BPE vocabulary in the tokenizers library's JSON format. No begin or end
    tokens are added and nothing is truncated. Null texts count as empty (no bytes, no tokens). Null
    ids and repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    where = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            texts = part.column("text").to_pylist()
            n = pa.array(merger(where).tokens(texts), pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.record_batch([part.column("doc_id"), size, n, pa.array([x > limit for x in n.to_pylist()], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
