"""SentencePiece ids of merge-type vocabularies by a score-ordered agenda of adjacent pairs.

The agenda holds the adjacent symbol pairs that form a piece, best score first and leftmost among
equals; the best pair is merged, and the pairs it forms with its neighbours join the agenda (a heap,
or for short words the plain list of pair scores). No piece of the vocabulary spans the end of a word,
or a line feed, or the step from a letter to some marks, so these parts are merged on their own and
remembered. Within each Arrow batch the ids of all newly met parts, and the text that they are decoded to,
are checked against the sentencepiece library; where they should differ, the library's are taken. A text's
ids and its decoded text are put together from those of its parts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tesselon.llm.common import chunks, memories, text_or_empty

VOCABULARY = "piece_bpe_32k.model"
#: Words, and parts of words, that a worker remembers at most, and the longest of them that it does; a memory is emptied when it is full.
REMEMBERED, LONGEST = 600_000, 64
SPACE = "▁"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SHORT = 40
_NEVER = float("inf")
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class PieceCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, trainer = spec.normalizer_spec, spec.trainer_spec
        spans = [p.piece for p in spec.pieces if SPACE in p.piece.lstrip(SPACE)]
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or trainer.treat_whitespace_as_suffix or spans or not trainer.byte_fallback:
            raise ValueError(f"{path}: only merge-type vocabularies with byte fallback, plain text and a leading space are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece = {p.piece: (i, p.score) for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        self.byte = {int(p.piece[3:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == _BYTE}
        self.of_id = [p.piece if p.type == _NORMAL else bytes([int(p.piece[3:-1], 16)]) if p.type == _BYTE else "" for p in spec.pieces]
        self.cost = {p: -score for p, (_, score) in self.piece.items()}
        if any("\n" in p for p in self.piece):
            raise ValueError(f"{path}: a piece holds a line feed")
        steps = {b for p in self.piece for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        marks = "".join(map(regex.escape, sorted(set(_MARKS) - steps)))
        self.parts = regex.compile(rf"{SPACE}*\p{{L}}+(?=[{SPACE}\n{marks}]|$)|\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.line_feed = self.library.encode("\n")
        self.known: dict[str, str] = {}
        self.known_parts: dict[str, str] = {}
        self.fresh: list[str] = []
        self.otherwise: dict[str, str] = {}
        self.irregular = f"^$|^ |  |{SPACE}"

    def ids(self, word: str) -> list[int]:
        """The ids of one part of a text in which spaces are already escaped."""
        merged = self._by_list(list(word)) if len(word) <= _SHORT else self._by_heap(list(word))
        out: list[int] = []
        for p in merged:
            found = self.piece.get(p)
            if found:
                out.append(found[0])
            else:
                out.extend(self.byte[x] for x in p.encode())
        return out

    def _by_list(self, parts: list[str]) -> list[str]:
        cost = self.cost.get
        agenda = [cost(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            parts[i] += parts.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(parts[i] + parts[i + 1], _NEVER)
            if i:
                agenda[i - 1] = cost(parts[i - 1] + parts[i], _NEVER)
        return parts

    def _by_heap(self, parts: list[str]) -> list[str]:
        cost, n = self.cost, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[a + b], i, i + 1, 2) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in cost]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = parts[left], parts[right]
            if not a or not b or len(a) + len(b) != size:
                continue
            parts[left], parts[right] = a + b, ""
            end = after[left] = after[right]
            if end < n:
                before[end] = left
                if a + b + parts[end] in cost:
                    heapq.heappush(agenda, (cost[a + b + parts[end]], left, end, size + len(parts[end])))
            start = before[left]
            if start >= 0 and parts[start] + a + b in cost:
                heapq.heappush(agenda, (cost[parts[start] + a + b], start, left, size + len(parts[start])))
        return [p for p in parts if p]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with spaces restored and bytes put together, the leading space included."""
        pieces = [self.of_id[i] for i in ids]
        try:
            return "".join(pieces).replace(SPACE, " ")
        except TypeError:  # some are bytes
            return b"".join(p if isinstance(p, bytes) else p.replace(SPACE, " ").encode() for p in pieces).decode("utf-8", errors="replace")

    def _learn_parts(self, parts: list[str]) -> None:
        """Remember the ids of new parts, and those that are decoded to another text, after a check against the library."""
        # The library puts a space in front of each text: a part's own first space is left out, and
        # a part without one follows a line feed, which no piece holds.
        held = self.library.encode([w[1:].replace(SPACE, " ") if w[0] == SPACE else "\n" + w.replace(SPACE, " ") for w in parts], num_threads=1)
        found = []
        for part, expected in zip(parts, held, strict=True):
            ids = self.ids(part)
            if part != SPACE:
                expected = expected if part[0] == SPACE else expected[len(self.line_feed) :]
                ids = ids if ids == expected else expected
            found.append(ids)
            self.known_parts[part] = ",".join(map(str, ids))
        # The library leaves out one leading space.
        for part, ids, text in zip(parts, found, self.library.decode(found, num_threads=1), strict=True):
            held = " " + text if part[0] == SPACE else text
            if self.decode(ids) != held or held != part.replace(SPACE, " "):
                self.otherwise[part] = held
        self.fresh += parts

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words, each with the space in front of it."""
        split = [self.parts.findall(SPACE + w) for w in words]
        self._learn_parts(list(set().union(*split).difference(self.known_parts)))
        get = self.known_parts.__getitem__
        self.known.update((w, ",".join(map(get, parts))) for w, parts in zip(words, split, strict=True))

    def _text(self, parts: list[str]) -> str:
        """What the parts of a text, or of a word, are decoded to."""
        return "".join([self.otherwise.get(p, p) for p in parts] if self.otherwise else parts).replace(SPACE, " ")[1:]

    def encode(self, texts: pa.StringArray) -> tuple[list[bytes], list[bytes]]:
        """The ids as decimal text joined by commas, and the decoded text in UTF-8, of each text."""
        # Other texts, such as those with two spaces in a row, are cut at their parts instead of at spaces.
        irregular = pc.match_substring_regex(texts, self.irregular)
        cut = pc.split_pattern(texts.filter(pc.invert(irregular)), " ")
        others = [[] if not t else self.parts.findall(SPACE + t.replace(" ", SPACE)) for t in texts.filter(irregular).to_pylist()]
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # What words are made of and decoded to is known together or not at all.
        if max(len(self.known), len(self.known_parts)) > REMEMBERED:
            for memory in (self.known, self.known_parts, self.otherwise):
                memory.clear()
        new = [w for w in words if w not in self.known]
        self._learn(new)
        self._learn_parts(list(set().union(*others).difference(self.known_parts)))
        starts = pa.array(cut.offsets.to_numpy() - cut.offsets[0].as_py(), pa.int32())

        def joined(of_word: list[str], by: str) -> list[bytes]:
            taken = pa.array(of_word, pa.string()).take(coded.indices)
            return pc.binary_join(pa.ListArray.from_arrays(starts, taken), by).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()

        ids = iter(joined([self.known[w] for w in words], ","))
        text = iter(joined([self._text(self.parts.findall(SPACE + w)) for w in words] if self.otherwise else words, " "))
        rest, out_ids, out_text = iter(others), [], []
        for apart in irregular.to_pylist():
            parts = next(rest) if apart else None
            out_ids.append(",".join(map(self.known_parts.__getitem__, parts)).encode() if apart else next(ids))
            out_text.append(self._text(parts).encode() if apart else next(text))
        for memory, fresh in ((self.known, new), (self.known_parts, self.fresh)):
            for word in fresh:
                if len(word) > LONGEST:
                    del memory[word]
                    self.otherwise.pop(word, None)
        self.fresh = []
        return out_ids, out_text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


memories["pieces"] = codec.cache_clear


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text, ``ids`` an int array, without begin and end ids.

    ``path`` is a merge-type SentencePiece model. Null texts count as empty: no ids, empty decoded
    text. Null ids and repeated rows stay; an empty table gives an empty result; other columns are
    ignored.
    """
    return _run(docs, path, "ids array<int>, decoded string", lambda ids, text: ([int(x) for x in ids.split(b",")] if ids else [], text.decode()), [pa.list_(pa.int32()), pa.string()])


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode_documents`` reduced to digests in the batch."""

    def digest(ids: bytes, text: bytes) -> tuple[int, str, str]:
        return ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return _run(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest, [pa.int64(), pa.string(), pa.string()])


def _run(docs: DataFrame, path: str | None, schema: str, row, types: list[pa.DataType]) -> DataFrame:
    where = path or public_tokenizers.path(VOCABULARY)
    names = ["doc_id", *(c.split(" ")[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", memory="pieces"):
            rows = [row(*x) for x in zip(*codec(where).encode(part.column("text")), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.record_batch([part.column("doc_id"), *columns], names)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")
