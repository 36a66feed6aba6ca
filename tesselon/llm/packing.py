"""Documents packed into sequences: first-fit decreasing in randomised groups, by a tournament tree.

Documents become ids where they are read and are then dealt at random into groups of bounded size, each
packed by itself. Full sequences are cut off the front of long documents; what remains of each document
is placed whole, the longest first, into the first sequence with enough room. The tournament tree holds
the room of every sequence in its leaves and the greater of its children's in each inner node, so the
first sequence that is large enough is found on one path from the root.

Sequences that are left with more than ``SLACK`` unused places are closed up: the emptiest give tokens to
the fullest, documents being cut where a sequence is full. At most one sequence of a group then has room
left; it is taken apart into sequences whose lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import chunks, shared_dir, text_or_empty
from tesselon.llm.token_files import STEP_BYTES, VOCABULARY, tokenizer

CAPACITY = 4096
#: Documents of a group, on average.
GROUP = 4096
#: Places of a sequence that may be left unused rather than have a document cut for them.
SLACK = 8

Piece = tuple[int, int, int]  # document of the group, start, length


class Tournament:
    """Room of numbered bins; ``place`` finds the first bin with enough of it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        room, at = self.room, 1
        if room[1] < length:
            raise ValueError("no bin has room")
        while at < self.size:
            at *= 2
            if room[at] < length:
                at += 1
        bin_, left = at - self.size, room[at] - length
        room[at] = left
        while at > 1:
            left = max(left, room[at ^ 1])
            at //= 2
            if room[at] == left:
                break
            room[at] = left
        return bin_


def _is_power(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def _taken(pieces: list[Piece], wanted: int) -> list[Piece]:
    """Pieces of ``wanted`` tokens together from the end of ``pieces``; the last one is cut if it must be."""
    out = []
    while wanted:
        doc, start, length = pieces.pop()
        if length > wanted:
            pieces.append((doc, start, length - wanted))
            start, length = start + length - wanted, wanted
        out.append((doc, start, length))
        wanted -= length
    return out


def packed(lengths: list[int], capacity: int = CAPACITY, slack: int = SLACK) -> list[list[Piece]]:
    """The pieces of each sequence of one group of documents, none of which is empty."""
    full = [[(d, at, capacity)] for d, n in enumerate(lengths) for at in range(0, n - n % capacity, capacity)]
    rest = sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(len(rest), capacity), []
    for n, d in rest:
        at = tree.place(n)
        if at == len(bins):
            bins.append([])
        bins[at].append((d, lengths[d] - n, n))
    used = [sum(p[2] for p in b) for b in bins]
    loose = sorted((b for b in range(len(bins)) if capacity - used[b] > slack), key=lambda b: (-used[b], b))
    fill, give = 0, len(loose) - 1
    while fill < give:
        to, of = loose[fill], loose[give]
        moved = min(capacity - used[to], used[of])
        bins[to] += _taken(bins[of], moved)
        used[to], used[of] = used[to] + moved, used[of] - moved
        fill += capacity - used[to] <= slack
        give -= used[of] == 0
    if fill == give and not _is_power(used[loose[fill]]):
        # No padding at powers of two: the highest first.
        last = bins[loose[fill]]
        size = used[loose[fill]]
        bins += [_taken(last, 1 << k) for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]
    return full + [b for b in bins if b]


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row a piece of a document.

    ``path`` is a vocabulary of the kind of ``token_files``; its end id closes every document. Pieces of
    a sequence stand one after the other from ``offset`` 0 on, pieces of a document are told by their
    ``start``. Null texts count as empty: such a document is its end id alone. Rows that repeat an id
    are documents of their own, null ids stay; an empty table gives an empty result; other columns are
    ignored. ``sequence_id`` is the group times 2^32 plus the place in it.
    """
    where = path or public_tokenizers.path(VOCABULARY)
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        for part in chunks(batches, "text", STEP_BYTES):
            ids = tokenizer(where).encode(part.column("text"))
            yield pa.record_batch([part.column("doc_id"), pa.array(np.arange(place, place + part.num_rows)), ids], ["doc_id", "place", "ids"])
            place += part.num_rows

    plain = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"
    docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(tokenize, f"doc_id {kind}, place long, ids binary").write.parquet(plain)
    rows = spark.read.parquet(plain)
    groups = max(1, -(-rows.count() // group))
    width = tokenizer(where).width
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def finish(number: int, doc_ids: list, ids: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
        own = [np.frombuffer(x, width) for x in ids]
        out = []
        for k, sequence in enumerate(packed(list(map(len, own)), capacity, slack)):
            offset = 0
            for d, start, length in sequence:
                crc = zlib.crc32(own[d][start : start + length].astype("<u4"))
                out.append((doc_ids[d], start, length, crc, len(own[d]), (number << 32) + k, offset))
                offset += length
        columns = zip(*out, strict=True)
        return pa.record_batch([pa.array(c, id_type if n == "doc_id" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, doc_ids, ids, id_type = None, [], [], None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for g, doc, found in zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "ids")), strict=True):
                if g != number and ids:
                    yield finish(number, doc_ids, ids, id_type)
                    doc_ids, ids = [], []
                number = g
                doc_ids.append(doc)
                ids.append(found)
        if ids:
            yield finish(number, doc_ids, ids, id_type)

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups))).repartition("group").sortWithinPartitions("group", "place")
    schema = ", ".join(f"{c} {kind if c == 'doc_id' else 'long'}" for c in names)
    return dealt.select("group", "doc_id", "ids").mapInArrow(run, schema)
