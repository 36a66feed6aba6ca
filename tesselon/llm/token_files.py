"""Token-id files: documents in id order, entropy-coded by a static range asymmetric numeral system.

A store is a folder with two Parquet tables. ``model`` holds the frequency of every id that occurs, the
table that all blocks share. ``blocks`` holds one row per block of whole documents: its place
(``file``, ``block``), the document ids, and a self-contained payload:

    magic "TANS", lanes u16, bits u16, steps u32, segments u32, ids u64, documents u32
    document lengths          u32 x documents
    checkpoints: coder states u64 x segments x lanes
    checkpoints: word offsets u32 x (segments + 1)
    checksums (CRC-32 of ids) u32 x segments
    words                     u32 ...

A segment is ``lanes`` interleaved coders of ``steps`` ids each; the last is filled up by the most
frequent id. Every segment starts at a checkpoint (states and word offset), so any of them can be decoded
alone. Numbers are little-endian; ids are unsigned 32-bit integers. Blocks are encoded and decoded some
segments at a time, side by side, so memory beyond the ids and the payload does not grow with a text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselon.lineage import remove
from tesselon.llm.common import chunks, shared_dir, text_or_empty

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
LANES, STEPS = 32, 256
#: Segments of a block that are encoded or decoded side by side.
GROUP = 64
#: Ids after which a block is closed; a block always holds whole documents.
BLOCK_IDS = 1 << 19
#: Words, and parts of words, that a worker remembers at most, and the longest of them that it does; a memory is emptied when it is full.
REMEMBERED, LONGEST = 600_000, 64
#: Bytes of text whose words are told apart at a time.
STEP_BYTES = 2 << 20
# The vocabulary's split pattern - contractions, runs of letters, single digits, runs of other characters
# but white space - as it reads inside the scripts below, where the only numbers beside 0-9 are these six; and line feeds.
_NUMBERS, _WHITE = "\u00b2\u00b3\u00b9\u00bc-\u00be", r" \t-\r\x85\xa0"
_PARTS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[^\W\d_{_NUMBERS}]+|[0-9{_NUMBERS}]|[^\w{_WHITE}]+(?:_[^\w{_WHITE}]*)*|_(?:[^\w{_WHITE}]|_)*|\n")
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_HEAD = struct.Struct("<4sHHIIQI")
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)
# Not in scripts of which every character is composed, has one small form and has long been a letter or not.
_ODD = "[^\\x00-\u012f\u0131-\u024f\u0388-\u03a1\u03a4-\u03ce\u0400-\u0481\u048a-\u0527\u2010-\u2027\u20ac\u3041-\u3096\u309b-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]"


class RangeCoder:
    """Static rANS over the ids of a frequency table: 64-bit states, 32-bit words."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        self.bits = max(16, int(len(ids) - 1).bit_length() + 4)
        total = 1 << self.bits
        freq = 1 + np.floor(counts / counts.sum() * (total - len(ids))).astype(np.int64)
        freq[np.argmax(freq)] += total - freq.sum()
        self.freq, self.first = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.rest = np.uint64(total) - self.freq
        self.symbol = np.repeat(np.arange(len(ids), dtype=np.int32), freq)
        self.position = np.zeros(int(self.ids[-1]) + 1, np.int32)
        self.position[self.ids] = np.arange(len(ids))

    def encode(self, ids: np.ndarray, lengths: np.ndarray) -> bytes:
        # As many segments as needed, of equal length, so that little is filled up.
        segments = max(1, -(-len(ids) // (LANES * STEPS)))
        steps = -(-len(ids) // (segments * LANES))
        size, raw = LANES * steps, ids.astype("<u4", copy=False)
        states, words, counts = [], [], []
        for at in range(0, segments, GROUP):
            state, sent, n = self._group(raw[at * size : (at + GROUP) * size], min(GROUP, segments - at), steps)
            states.append(state)
            words.append(sent)
            counts.append(n)
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype("<u4")
        sums = np.array([zlib.crc32(raw[k * size : (k + 1) * size]) for k in range(segments)], "<u4")
        head = _HEAD.pack(b"TANS", LANES, self.bits, steps, segments, len(ids), len(lengths))
        return b"".join((head, lengths.astype("<u4").tobytes(), *states, offsets.tobytes(), sums.tobytes(), *words))

    def _group(self, ids: np.ndarray, segments: int, steps: int) -> tuple[bytes, bytes, np.ndarray]:
        """Final states and words of some segments, and how many words each of them has."""
        symbols = np.full(segments * LANES * steps, np.argmax(self.freq), np.int32)
        symbols[: len(ids)] = self.position[ids]
        # One row a step, in which the lanes of all segments lie side by side.
        symbols = symbols.reshape(segments, steps, LANES).transpose(1, 0, 2).reshape(steps, segments * LANES)
        state = np.full(segments * LANES, _LOW, np.uint64)
        words, sent = np.zeros(symbols.shape, np.uint32), np.zeros(symbols.shape, bool)
        room = np.uint64(63 - self.bits)
        for t in range(steps - 1, -1, -1):
            now = symbols[t]
            freq = self.freq[now]
            over = np.flatnonzero(state >= freq << room)
            full = state[over]
            words[t, over], sent[t, over] = full.astype(np.uint32), True
            state[over] = full >> _WORD
            # (state // freq << bits) + state % freq, in terms of the quotient alone.
            state += state // freq * self.rest[now] + self.first[now]
        by_segment = (steps, segments, LANES)
        words, sent = (x.reshape(by_segment).transpose(1, 0, 2) for x in (words, sent))
        return state.astype("<u8").tobytes(), words[sent].astype("<u4").tobytes(), sent.sum(axis=(1, 2))

    def decode(self, payload: bytes, only: range | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids, as unsigned 32-bit integers, and the document lengths of a block.

        ``only`` names the segments whose ids are wanted; decoding starts at their checkpoints.
        """
        magic, lanes, bits, steps, segments, n, documents = _HEAD.unpack_from(payload)
        if magic != b"TANS" or bits != self.bits:
            raise ValueError("not a block of this store")
        at, parts = _HEAD.size, []
        for kind, count in (("<u4", documents), ("<u8", segments * lanes), ("<u4", segments + 1), ("<u4", segments)):
            parts.append(np.frombuffer(payload, kind, count, at))
            at += parts[-1].nbytes
        lengths, state, offsets, sums = parts
        words = np.frombuffer(payload, "<u4", offset=at)
        state, size = state.reshape(segments, lanes), lanes * steps
        first, last = (only.start, only.stop) if only else (0, segments)
        out = np.empty(max(0, min(n, last * size) - first * size), "<u4")
        for low in range(first, last, GROUP):
            high = min(last, low + GROUP)
            ids = self._ungroup(state[low:high], words, offsets[low:high], steps)[: n - low * size]
            out[(low - first) * size : (low - first) * size + len(ids)] = ids
            for k in range(low, high):
                if zlib.crc32(ids[(k - low) * size : (k + 1 - low) * size]) != sums[k]:
                    raise ValueError("a block's checksum differs")
        return out, lengths

    def _ungroup(self, states: np.ndarray, words: np.ndarray, offsets: np.ndarray, steps: int) -> np.ndarray:
        segments, lanes = states.shape
        state, place = states.reshape(-1).astype(np.uint64), offsets.astype(np.int64) - 1
        out = np.empty((steps, segments * lanes), np.int32)
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        for t in range(steps):
            slot = state & mask
            now = self.symbol.take(slot.view(np.int64), out=out[t], mode="clip")
            state = self.freq[now] * (state >> bits) + slot - self.first[now]
            low = state < _LOW
            taken = np.cumsum(low.reshape(segments, lanes), axis=1, dtype=np.int64)
            at = np.flatnonzero(low)
            # A damaged block may ask for more words than there are; its checksum tells.
            word = words[np.minimum((place[:, None] + taken).reshape(-1)[at], len(words) - 1)] if len(words) else 0
            state[at] = state[at] << _WORD | word
            place += taken[:, -1]
        return self.ids[out.reshape(steps, segments, lanes).transpose(1, 0, 2).reshape(-1)].astype("<u4")


class WordTokenizer:
    """The ids of whole texts by the tokenizers library, which sees each distinct part of a word once.

    The vocabulary composes and lower-cases texts and then splits them; the split drops white space and
    no part spans it. Ids are remembered by word, and by part of a word for words that are new. Words
    with special strings or with characters outside the scripts below, such as combining marks, go to
    the library whole. Vocabularies with another normalizer or another split are refused.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec["normalizer"], spec["pre_tokenizer"]) != (_NORMALIZER, _SPLIT) or not spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path}: only vocabularies that lower-case texts and split them like {VOCABULARY} are supported")
        # Parts are composed, in lower case and split already.
        plain = {**spec, "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _SPLIT["pretokenizers"][1]]}, "added_tokens": []}
        self.parts = Tokenizer.from_str(json.dumps(plain))
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for s, i in self.library.get_vocab().items() if s.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}
        names = "|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        self.odd = re.compile(f"(?i:{names})|{_ODD}" if names else _ODD)

    def _ids(self, library, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that are encoded as one text: the last id of each part is one that ends words."""
        if not parts:
            return []
        ids = np.array(self.parts.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.width)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(parts) or stops[-1] != len(ids):
            return self._ids(self.parts, parts)
        raw, size = ids.tobytes(), self.width.itemsize
        return [raw[a:b] for a, b in zip([0, *(stops[:-1] * size).tolist()], (stops * size).tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        odd = [w for w in words if self.odd.search(w)] if self.odd.search(" ".join(words)) else []
        self.known.update(zip(odd, self._ids(self.library, odd), strict=True))
        if odd:
            words = [w for w in words if w not in self.known]
        if not words:
            return
        # No word holds a line feed; between the parts of the words it has no ids, all others have some.
        found = _PARTS.findall("\n".join([*words, ""]).lower())
        self.known_parts["\n"] = b""
        new = list(set(found).difference(self.known_parts))
        self.known_parts.update(zip(new, self._joined(new), strict=True))
        ids = list(map(self.known_parts.__getitem__, found))
        size, raw = np.fromiter(map(len, ids), np.int64, len(ids)), b"".join(ids)
        ends = np.cumsum(size)[size == 0].tolist()
        self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
        _forget_long(self.known_parts, new)

    def encode(self, texts: pa.StringArray) -> pa.BinaryArray:
        """The ids of each text, closed by ``END_ID``, as bytes of ``width``."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        for memory in (self.known, self.known_parts):
            if len(memory) > REMEMBERED:
                memory.clear()
        new = [w for w in distinct if w not in self.known]
        self._learn(new)
        ids = [*map(self.known.__getitem__, distinct), np.array([END_ID], self.width).tobytes()]
        _forget_long(self.known, new)
        # The ids of each distinct word once, then a gather by the words of all texts in order.
        flat, size = np.frombuffer(b"".join(ids), self.width), np.fromiter(map(len, ids), np.int64, len(ids)) // self.width.itemsize
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        code = np.insert(coded.indices.to_numpy(), ends[1:], len(distinct))
        n = size[code]
        upto = np.cumsum(n)
        out = flat[np.repeat((np.cumsum(size) - size)[code] - upto + n, n) + np.arange(upto[-1])]
        offsets = np.append(0, upto[ends[1:] + np.arange(len(texts))]) * self.width.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def _forget_long(memory: dict[str, bytes], new: list[str]) -> None:
    for word in new:
        if len(word) > LONGEST:
            del memory[word]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write_store(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Write the ids of all documents, each closed by ``END_ID``, to a store in ``folder``.

    Documents go by ascending id, null ids first, equal ids by the hash of their text. Null texts
    count as empty, so such a document holds the end id alone. Texts are never shuffled: they become
    ids where they are read, and only the ids, a third of the size, are sorted by range.
    """
    where = path or public_tokenizers.path(VOCABULARY)
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(where)
        place, total, parts = TaskContext.get().partitionId() << 33, np.zeros(own.library.get_vocab_size(), np.int64), None
        counted = [pa.list_(pa.int32()), pa.list_(pa.int64())]
        for parts in chunks(batches, "text", STEP_BYTES):
            ids = own.encode(parts.column("text"))
            total += np.bincount(np.frombuffer(ids.buffers()[2], own.width), minlength=len(total))
            n = parts.num_rows
            yield pa.record_batch([parts.column("doc_id"), parts.column("h"), pa.array(np.arange(place, place + n)), ids, *(pa.nulls(n, t) for t in counted)], names)
            place += n
        at = np.flatnonzero(total)
        if len(at):
            nulls = [pa.nulls(1, t) for t in (parts.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary())]
            yield pa.record_batch([*nulls, *(pa.array([c], t) for c, t in zip((at, total[at]), counted, strict=True))], names)

    names = ["doc_id", "h", "place", "ids", "seen", "times"]
    text, plain = text_or_empty(), f"{folder}/plain"
    keyed = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    # The last row of each task holds its counts of ids.
    keyed.mapInArrow(tokenize, f"doc_id {kind}, h long, place long, ids binary, seen array<int>, times array<long>").write.parquet(plain)
    rows = spark.read.parquet(plain)
    counts = rows.filter("seen IS NOT NULL").select(F.explode(F.arrays_zip("seen", "times")).alias("c")).groupBy(F.col("c.seen").alias("id")).agg(F.sum("c.times").alias("n"))
    counts.coalesce(1).write.parquet(f"{folder}/model")
    model, width = _model(spark, folder), tokenizer(where).width

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, doc_ids, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) // width.itemsize for x in ids])
            payload = _coder(model).encode(np.frombuffer(b"".join(ids), width), lengths)
            row = [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()), pa.array([doc_ids], pa.list_(id_type)), pa.array([payload], pa.binary())]
            return pa.record_batch(row, ["file", "block", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                ids.append(found)
                held += len(found) // width.itemsize
                if held >= BLOCK_IDS:
                    yield close()
                    block, doc_ids, ids, held = block + 1, [], [], 0
        if ids:
            yield close()

    # The place in the table parts documents with the same id and text, which may be any number.
    ordered = rows.filter("ids IS NOT NULL").select("doc_id", "h", "place", "ids").repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place")
    blocks = ordered.mapInArrow(encode, f"file int, block int, n_ids long, doc_ids array<{kind}>, payload binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    remove(spark, plain)


def _model(spark: SparkSession, folder: str) -> bytes:
    """The shared frequency table; it has at most as many rows as the vocabulary has ids."""
    rows = spark.read.parquet(f"{folder}/model").toPandas()
    return np.stack((rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))).tobytes()


@lru_cache(maxsize=2)
def _coder(model: bytes) -> RangeCoder:
    ids, counts = np.frombuffer(model, np.int64).reshape(2, -1)
    return RangeCoder(ids, counts)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store, decoded from its files."""
    blocks, model = spark.read.parquet(f"{folder}/blocks"), _model(spark, folder)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, doc_ids, payload in zip(*(batch.column(c) for c in ("file", "block", "doc_ids", "payload")), strict=True):
                ids, lengths = _coder(model).decode(payload.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                n = len(lengths)
                columns = [pa.array([file.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()), doc_ids.values, pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())]
                yield pa.record_batch(columns, ["file", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    found = blocks.select("file", "block", "doc_ids", "payload").mapInArrow(decode, f"file int, block int, doc_id {kind}, inside long, n_tokens long, ids_crc32 long")
    places = blocks.select("file", "block", "n_ids")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = places.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = places.select("file", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("block_start")).join(files, "file")
    return found.join(starts, ["file", "block"]).select("doc_id", (F.col("file_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from a store newly written in the shared folder.

    ``start`` counts the ids of all documents before, ``n_tokens`` includes the end id and
    ``ids_crc32`` is the CRC-32 of the document's ids as little-endian unsigned 32-bit integers.
    Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_store(docs, folder, path)
    return read_store(docs.sparkSession, folder)
