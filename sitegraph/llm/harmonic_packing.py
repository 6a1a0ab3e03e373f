"""Packing token sequences by harmonic classes.

Pieces of documents are dealt to classes by the reciprocal of their share of a sequence: class ``k`` holds lengths above
``capacity / (k + 1)`` and at most ``capacity / k``, so a sequence of the class holds exactly ``k`` pieces whatever they are.
No piece needs to know of others, so every task fills the sequences of its own rows while it reads them: there is no
shuffle, and a task holds one open sequence per class.

Plain harmonic packing wastes up to ``1 / (k + 1)`` of a sequence. As documents may be cut, a length that would waste more than
``slack`` tokens gives its head to the class below in length, cut to that class's largest length, and its tail is dealt
anew. What a task has open at its end is laid end to end and cut into full sequences, and the last rest into powers of two,
which need no padding. So padding comes from the slack alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
# Tokens of padding that a sequence may have.
SLACK = 32
OUT_BYTES = 8 << 20
# Sequences of one task have numbers below this, so that numbers of tasks never meet.
TASK_SEQUENCES = 1 << 33
COLUMNS = "start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long"


class RankEncoder:
    """Byte-level encoder of a rank file; the strings of special tokens stand for their ids, as in the vocabulary's library."""

    def __init__(self, ranks: bytes, pattern: str, special: dict[str, int]) -> None:
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")


def class_of(length: int, capacity: int) -> int:
    """How many pieces of this length a sequence holds."""
    return capacity // length


def cuts(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document, in order; each leaves at most ``slack`` tokens in a sequence of its like.

    A head cut for class ``k`` is at least half of what is left, so there are few pieces beside whole sequences.
    """
    pieces = [capacity] * (length // capacity)
    left = length % capacity
    while left:
        k = class_of(left, capacity)
        head = left if capacity - k * left <= slack else capacity // (k + 1)
        pieces.append(head)
        left -= head
    return pieces


def powers(length: int) -> list[int]:
    """Powers of two that sum up to a length, largest first."""
    return [1 << i for i in reversed(range(length.bit_length())) if length >> i & 1]


class Worker:
    """The open sequences of one task. A piece is (row of the key, start, ids, tokens of the document)."""

    def __init__(self, number: int, capacity: int, slack: int) -> None:
        self.capacity, self.slack = capacity, slack
        self.open: dict[int, list[tuple]] = {}
        self.next = number * TASK_SEQUENCES
        self.rows: list[tuple] = []
        self.size = 0

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.rows.append((key, start, len(ids), ids.tobytes(), total, self.next, offset))
            offset += len(ids)
        self.size += 4 * offset
        self.next += 1

    def add(self, key: object, ids: np.ndarray) -> None:
        start = 0
        for length in cuts(len(ids), self.capacity, self.slack):
            k = class_of(length, self.capacity)
            pieces = self.open.setdefault(k, [])
            # A copy, so that an open piece does not hold the ids of a long document.
            pieces.append((key, start, ids[start : start + length].copy(), len(ids)))
            start += length
            if len(pieces) == k:
                self.close(self.open.pop(k))

    def end(self) -> None:
        """Lays what is open end to end and cuts it into full sequences and powers of two."""
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        total = sum(len(piece[2]) for piece in rest)
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        rest.reverse()
        for size in sizes:
            pieces, room = [], size
            while room:
                key, start, ids, total = rest.pop()
                pieces.append((key, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((key, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self.close(pieces)

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"]
        columns = list(zip(*self.rows)) or [()] * len(names)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def pack_documents(
    docs: DataFrame, ranks: bytes, pattern: str, special: dict[str, int], separator: int = 0,
    text: str = "text", capacity: int = CAPACITY, slack: int = SLACK,
) -> DataFrame:
    """One row per piece: (doc_id, start, length, token_ids, doc_tokens, sequence_id, offset).

    The ids of a document are those of its text and ``separator`` at the end; a null or empty text is the separator alone.
    ``token_ids`` are little-endian unsigned 32-bit numbers, ``start`` counts the document's ids before the piece, ``offset`` the
    sequence's. A sequence holds at most ``capacity`` ids; it is within ``slack`` of it or a power of two. A null
    ``doc_id`` stays null, repeated rows are documents of their own, an empty table gives no rows, other columns are not read.
    Numbers of sequences follow from the task: ``docs`` should be a stored table, whose splits a lost task reads again as they were.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, special))
    end = np.array([separator], dtype="<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, worker, kind = RankEncoder(*shared.value), Worker(TaskContext.get().partitionId(), capacity, slack), pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, body in zip(batch.column(0), batch.column(1)):
                ids = encoder.encode(body.as_py() or "").astype("<u4", copy=False)
                worker.add(key.as_py(), np.concatenate([ids, end]))
                if worker.size >= OUT_BYTES:
                    yield worker.batch(kind)
        worker.end()
        if worker.rows:
            yield worker.batch(kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(pack, f"doc_id {kind}, {COLUMNS}")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, token_ids): what a trainer reads. A sequence has no more pieces than tokens, so groups are bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "token_ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda held, part: F.concat(held, part["token_ids"]))
    return whole.select("sequence_id", "length", ids.alias("token_ids"))
