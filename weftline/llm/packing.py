"""Cost-balanced packing: documents into sequences of equal capacity, by linear plus quadratic attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import in_batches, pieces, text_buffer
from weftline.llm.tokens import Encoder

#: Tokens of a group; a group is packed by itself, inside the task that reads its documents.
GROUP = 1 << 21
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512


def pack(lengths: np.ndarray, capacity: int = 1024) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of each piece; pieces of a sequence in the order in which it holds them.

    Whole capacities of a document are sequences of their own.  What is left is assigned in descending order, each piece
    to the sequence of lowest cost that has room; where none has, the piece is cut.  The last tokens, fewer than a
    capacity, fill sequences of powers of two, which need no padding: no token of padding is left over.
    """
    full = lengths // capacity
    out = [(d, k * capacity, capacity) for d in np.flatnonzero(full).tolist() for k in range(int(full[d]))]
    placed = [(*x, i) for i, x in enumerate(out)]
    tails = lengths % capacity
    total = int(tails.sum())
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (total % capacity) >> b & 1]
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    for d in np.argsort(-tails, kind="stable").tolist():
        start, left = int(full[d]) * capacity, int(tails[d])
        while left:
            fits = room >= left
            i = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            n = min(left, int(room[i]))
            placed.append((d, start, n, len(out) + i))
            room[i] -= n
            cost[i] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return placed


def _packed(docs: list, ids: list[np.ndarray], capacity: int, first: int) -> tuple[pa.RecordBatch, int]:
    placed = pack(np.array([len(x) for x in ids], np.int64), capacity)
    placed.sort(key=lambda x: x[3])  # stable: the order within a sequence stays
    d, start, n, seq = (np.array(x, np.int64) for x in zip(*placed, strict=True))
    ends = np.cumsum(n)
    new = np.concatenate([[True], seq[1:] != seq[:-1]])
    offset = ends - n - (ends - n)[np.flatnonzero(new)][np.cumsum(new) - 1]
    crc = [zlib.crc32(ids[i][a : a + k].astype("<u4").tobytes()) for i, a, k in zip(d.tolist(), start.tolist(), n.tolist(), strict=True)]
    columns = [pa.array([docs[i] for i in d.tolist()], pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64()), pa.array([len(ids[i]) for i in d.tolist()], pa.int64()), pa.array(seq + first), pa.array(offset)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), int(seq[-1]) + 1


def _pack(path: str | None, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, docs, ids, have = TaskContext.get().partitionId() << 40, [], [], 0
        encoder = Encoder(path)
        for batch in pieces(batches):
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(*text_buffer(batch.column("text"))), strict=True):
                docs.append(doc)
                ids.append(np.append(found, np.uint32(end)))
                have += len(found) + 1
            if have >= GROUP:
                out, used = _packed(docs, ids, capacity, first)
                yield out
                first, docs, ids, have = first + used, [], [], 0
        if docs:
            yield _packed(docs, ids, capacity, first)[0]

    return run


def pack_documents(docs: DataFrame, capacity: int = 1024, path: str | None = None, end: int = 0) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id long, text string; other columns are ignored) in sequences of ``capacity``.

    Each text is encoded by the tokenizer file ``path`` and followed by the id ``end``; a null or empty text is that id
    alone.  Every id is in exactly one piece.  Returns doc_id, start (ids of the document before the piece), length,
    ids_crc32 (of the piece's ids as little-endian unsigned 32-bit integers), doc_tokens, sequence_id and offset (the
    piece's place in its sequence).  Repeated rows are packed one by one.  Groups of about two million tokens are packed
    inside the tasks that read them, so nothing is shuffled; an empty table gives an empty result.  ``capacity`` must be a
    power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return in_batches(docs, _pack(path, capacity, end), schema)
