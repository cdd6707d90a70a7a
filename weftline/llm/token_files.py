"""Token-id files: canonical length-limited Huffman codes of ids from their global counts.

A file set is a folder with ``shards`` (Parquet, by part) and ``codebook`` (id, length).  A shard holds consecutive
documents in ascending doc_id order: their ids' codes as one bit string, and the bit offset of every 256th id.  The code
is canonical, so the lengths alone give it.  Each stretch of 256 ids can be decoded by itself from its offset; a table of
all bit strings of the longest length gives each code's id and length in one look-up, for many stretches at once.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import in_batches, pieces, scratch_path, settle, text_buffer
from weftline.llm.tokens import Encoder

#: Bits of the longest code, ids between checkpoints, ids of a shard (a longer document is one shard).
LONGEST, STRETCH, SHARD = 20, 256, 1 << 17
#: Parts up to which the table of parts is broadcast when files are read.
BROADCAST_PARTS = 20_000


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The lengths of an optimal prefix code with codes of at most ``longest`` bits, by package-merge; 0 for a count of 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError("too many ids for codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, singles = weights, [np.ones(len(order), bool)]
    for _ in range(longest - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packages])
        by = np.argsort(both, kind="stable")
        level = both[by]
        singles.append(by < len(order))
    take = 2 * len(order) - 2
    for single in reversed(singles):
        n = int(single[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of a canonical prefix code: by length, then id."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.int64)
    top = int(size[-1]) if len(size) else 0
    place = np.cumsum(1 << (top - size)) - (1 << (top - size))
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = place >> (top - size)
    return codes


def encoded(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` as bits, first bit highest, and the bit offset of every ``STRETCH``-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begin = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    word = begin >> 5
    shifted = codes[ids].astype(np.uint64) << (64 - (begin & 31) - size).astype(np.uint64)
    n = (bits >> 5) + 2
    high = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n)  # bits don't overlap: sums are below 2 ** 32
    low = np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return (high + low).astype(np.uint64).astype(">u4").tobytes()[: -(-bits // 8)], begin[::STRETCH]


class Decoder:
    """Decodes bit strings of the code with these ``lengths``."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.top = int(lengths.max()) if len(lengths) else 0
        spread = 1 << (self.top - lengths[order].astype(np.int64))
        self.id = np.zeros(1 << self.top, np.uint32)
        self.size = np.ones(1 << self.top, np.int64)
        self.id[: spread.sum()] = np.repeat(order, spread)
        self.size[: spread.sum()] = np.repeat(lengths[order], spread)

    def decode(self, data: bytes, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of stretches that begin at these bits and have n ids (at most ``STRETCH``) each, one after another."""
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at, out = begin.astype(np.int64).copy(), np.zeros((len(begin), STRETCH), np.uint32)
        for k in range(int(n.max()) if len(n) else 0):
            code = (words[np.minimum(at >> 3, len(words) - 1)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.top)
            out[:, k] = self.id[code]
            at += self.size[code]
        return out[np.arange(STRETCH) < n[:, None]]


def _tokenized(path: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, at, docs, ids, have = TaskContext.get().partitionId(), 0, 0, [], [], 0
        encoder = Encoder(path)

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "at": at, "docs": docs, "sizes": [len(x) for x in ids], "ids": np.concatenate(ids).astype("<u4").tobytes() if max(x.max() for x in ids) > 65535 else b"2" + np.concatenate(ids).astype("<u2").tobytes()}], schema)

        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("at", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary())])
        for batch in pieces(batches):
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(*text_buffer(batch.column("text"))), strict=True):
                if ids and have + len(found) + 1 > SHARD:
                    yield shard()
                    seq, at, docs, ids, have = seq + 1, at + have, [], [], 0
                docs.append(doc)
                ids.append(np.append(found, np.uint32(end)))
                have += len(found) + 1
        if ids:
            yield shard()

    return run


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], "<u2") if len(data) % 2 else np.frombuffer(data, "<u4")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for data in batch.column("ids").to_pylist():
            found = np.bincount(_ids(data))
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


def _coded(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for batch in batches:
            both = [encoded(_ids(data), lengths, codes) for data in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("part", "seq", "at", "docs", "sizes")), pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.list_(pa.int64()))], ["part", "seq", "at", "docs", "sizes", "bits", "checkpoints"]
            )

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end: int = 0) -> None:
    """Write the ids of all rows of ``docs`` (doc_id long, text string) to ``folder``, which Spark must be able to reach.

    Ids are by the tokenizer file ``path``, with the id ``end`` after each document; a null text is that id alone.
    Documents are in ascending doc_id order (null first), repeated doc_ids by a hash of their text.  At most one count for
    each id of the vocabulary comes to the driver.  An empty table gives a file set without documents.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    ids = settle(in_batches(ordered, _tokenized(path, end), "part long, seq long, at long, docs array<long>, sizes array<long>, ids binary"), compression="zstd")
    counts = in_batches(ids.select("ids"), _counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max((r.id for r in counts), default=-1) + 1, np.int64)
    for r in counts:
        total[r.id] = r.n
    lengths = code_lengths(total)
    coded = in_batches(ids, _coded(lengths), "part long, seq long, at long, docs array<long>, sizes array<long>, bits binary, checkpoints array<long>")
    coded.write.option("compression", "zstd").parquet(os.path.join(folder, "shards"))
    book = [(i, int(n)) for i, n in enumerate(lengths.tolist()) if n]
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(os.path.join(folder, "codebook"))


def _decoded(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            bits = batch.column("bits").to_pylist()
            sizes = [np.array(x, np.int64) for x in batch.column("sizes").to_pylist()]
            marks = [np.array(x, np.int64) for x in batch.column("checkpoints").to_pylist()]
            for i in range(batch.num_rows):
                n = int(sizes[i].sum())
                each = np.minimum(STRETCH, n - np.arange(len(marks[i])) * STRETCH)
                ids = decoder.decode(bits[i], marks[i], each)
                cuts = np.concatenate([[0], np.cumsum(sizes[i])])
                parts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                count = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pc.list_flatten(batch.column("docs").slice(i, 1)), pa.array([batch.column("part")[i].as_py()] * count, pa.int64()), pa.array(cuts[:-1] + batch.column("at")[i].as_py(), pa.int64()), pa.array(sizes[i]), pa.array(parts, pa.binary())],
                    ["doc_id", "part", "at", "n_tokens", "ids"],
                )

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document."""
    book = spark.read.parquet(os.path.join(folder, "codebook")).collect()  # one row for each id of the vocabulary at most
    lengths = np.zeros(max((r.id for r in book), default=-1) + 1, np.uint8)
    for r in book:
        lengths[r.id] = r.length
    shards = spark.read.parquet(os.path.join(folder, "shards"))
    sums = shards.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy().orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = settle(sums.select("part", before.alias("before")))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts
    found = in_batches(shards, _decoded(lengths), "doc_id long, part long, at long, n_tokens long, ids binary")
    return found.join(parts, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = pa.array([zlib.crc32(x) for x in batch.column("ids").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), sums], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` to token files in the shared folder, read them back, and return doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = scratch_path(spark)
    write_token_files(docs, folder, path)
    return in_batches(read_token_files(spark, folder), _summed, "doc_id long, start long, n_tokens long, ids_crc32 long")
