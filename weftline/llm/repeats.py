"""Repeated passages by a sparse de Bruijn graph of word k-mers.

1. Every 35-word window has a k-mer of smallest hash, its anchor; equal windows have equal anchors, so the anchors are a
   sparse set of the graph's edges that no repeated window can avoid.
2. Compaction: an anchor occurrence knows the words up to the anchors before and after it, its context.  A grouping
   counts each anchor's occurrences and contexts.  An anchor that is repeated, always in one context, is a nonbranching
   piece of the graph: all words of its context are repeated with it.  Joining that back to the source coordinates and
   merging neighbours gives the repeated nonbranching paths of each document.
3. A window inside such a path around its anchor is repeated, and all its copies are inside the same path.  Only windows
   around branching anchors are left: their hashes are counted, and the source coordinates of those found twice or more
   are joined back.  Both together are exactly the repeated windows; no pairs of documents are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import in_batches, pieces, settle, text_buffer
from weftline.llm.words import U, Words, mixed, running, signed, windows

#: Words of an anchor.
K = 8


class _Anchors:
    """Anchors of the texts of a batch: word positions ``at``, hashes ``value``, contexts ``context``; ``words`` and word hashes."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        raw, off = text_buffer(batch.column("text"))
        self.raw, self.off = raw, off
        self.words, self.size = Words(raw, off), size
        self.hash = self.words.hashes()
        words, first = self.words, self.words.first
        n, w = len(words), size - K + 1
        self.at, self.value, self.context = np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
        self.window = words.alone(size)  # where a window starts
        if len(self.window) == 0:
            return
        kmer = windows(self.hash, np.arange(n - K + 1), K)
        least = running(kmer, w, np.minimum)  # by window start
        valid = np.zeros(n - size + 1, bool)
        valid[self.window] = True
        # chosen: the smallest of some window that holds it whole and is of one text
        reach = np.concatenate([np.zeros(w - 1, U), np.where(valid, least, U(0)), np.zeros(w - 1, U)])
        self.at = np.flatnonzero((running(reach, w, np.maximum) == kmer) & (kmer > 0))
        self.at = self.at[words.doc[self.at] == words.doc[self.at + K - 1]]
        self.value = kmer[self.at]
        of = words.doc[self.at]
        same = np.zeros(len(self.at) + 1, bool)
        same[1:-1] = of[1:] == of[:-1]
        before = np.where(same[:-1], np.roll(self.at, 1), first[of])
        after = np.where(same[1:], np.roll(self.at, -1) + K, first[of + 1])
        left, right = windows(self.hash, before, self.at + K), windows(self.hash, self.at, after)
        self.before, self.after = before, after
        left = mixed(left + same[:-1].astype(U))
        self.context = mixed(left ^ mixed(right + same[1:].astype(U) + U(7)))
        self.least = least

    def anchor_of_windows(self) -> np.ndarray:
        """The index of the leftmost smallest anchor of each window."""
        i = np.searchsorted(self.at, self.window)
        want, out = self.least[self.window], np.full(len(self.window), -1)
        todo = np.arange(len(self.window))
        while len(todo):
            hit = self.value[np.minimum(i[todo], len(self.at) - 1)] == want[todo]
            out[todo[hit]] = i[todo[hit]]
            todo = todo[~hit]
            i[todo] += 1
        return out


def _joined(a: _Anchors, row: int, removed: np.ndarray | None) -> str:
    i, j = a.words.first[row], a.words.first[row + 1]
    keep = np.arange(i, j) if removed is None else np.arange(i, j)[~removed[i:j]]
    text = a.raw[a.off[row] : a.off[row + 1]].tobytes()
    if len(keep) == j - i:
        return hashlib.sha256(b" ".join(text.split())).hexdigest()
    parts = text.split()
    return hashlib.sha256(b" ".join([parts[x] for x in (keep - i).tolist()])).hexdigest()


def _find(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            a = _Anchors(batch, size)
            cuts = np.searchsorted(a.at, a.words.first)
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, kind))  # noqa: B023, E731
            at = a.at - np.repeat(a.words.first[:-1], np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("id"), batch.column("sum"), pa.array(np.diff(a.words.first), pa.int64()), pa.array([_joined(a, i, None) for i in range(batch.num_rows)], pa.string()), lists(signed(a.value), pa.int64()), lists(signed(a.context), pa.int64()), lists(at, pa.int32())],
                ["doc_id", "id", "sum", "n_words", "sha", "anchors", "contexts", "at"],
            )

    return run


def _marked(a: _Anchors, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that are repeated for sure (inside a path around their anchor); windows to be counted; closed paths."""
    closed, open_ = np.zeros(len(a.at), bool), np.zeros(len(a.at), bool)
    for row, marks in enumerate(batch.column("marks").to_pylist()):
        at = np.array([m["at"] for m in marks], np.int64) + a.words.first[row]
        i = np.searchsorted(a.at, at)
        yes = np.array([m["closed"] for m in marks], bool)
        closed[i[yes]] = True
        open_[i[~yes]] = True
    of = a.words.doc[a.at]
    # maximal runs of closed anchors of one text, and the words that they cover
    start = closed & ~np.concatenate([[False], closed[:-1] & (of[1:] == of[:-1])]) if len(closed) else closed
    run = np.cumsum(start) - 1
    low, high = np.zeros(start.sum(), np.int64), np.zeros(start.sum(), np.int64)
    low[run[start]] = a.before[start]
    last = closed.copy()
    last[:-1] &= ~(closed[1:] & (of[1:] == of[:-1]))
    high[run[last]] = a.after[last]
    by = a.anchor_of_windows() if len(a.window) else np.zeros(0, np.int64)
    inside = closed[by]
    where = run[by[inside]]
    inside[inside] = (low[where] <= a.window[inside]) & (a.window[inside] + a.size <= high[where])
    count = (closed[by] | open_[by]) & ~inside
    return inside, count, by


def _doubtful(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            a = _Anchors(batch, size)
            _, count, _ = _marked(a, batch)
            at = a.window[count]
            of = a.words.doc[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(of)), pa.array((at - a.words.first[of]).astype(np.int32)), pa.array(signed(windows(a.hash, at, size)))], ["row", "at", "window"]
            )

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            a = _Anchors(batch, size)
            inside, _, _ = _marked(a, batch)
            more = [np.array(x or [], np.int64) + a.words.first[i] for i, x in enumerate(batch.column("found").to_pylist())]
            starts = np.concatenate([a.window[inside], *more]).astype(np.int64)
            cover = np.zeros(len(a.words) + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + size, -1)
            removed = np.cumsum(cover)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(removed)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(a.words.first), pa.int64()), pa.array(np.diff(total[a.words.first]), pa.int64()), pa.array([_joined(a, i, removed) for i in range(batch.num_rows)], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return run


def remove_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs`` (doc_id long, text string; other columns are ignored).

    A word is removed if a window of ``size`` words of its document covers it whose words also start anywhere else, in
    this document or another; windows are judged on the input.  kept_sha256 is of the kept words joined by one space.
    Words are runs of characters other than space and 0x09 to 0x0D, unchanged.  A null text has no words; texts of fewer
    words than ``size`` have no window.  Repeated rows are repeated text: each loses its windows.  An empty table gives
    an empty result.  ``size`` must be over 8.
    """
    if size <= K:
        raise ValueError(f"size must be over {K}")
    none = F.lit(-(1 << 63))  # stands for a null doc_id in joins
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", none).alias("id"), F.xxhash64("text").alias("sum"), "text")
    found = in_batches(docs, _find(size), "doc_id long, id long, sum long, n_words long, sha string, anchors array<long>, contexts array<long>, at array<int>")
    found = settle(found.withColumn("row", F.monotonically_increasing_id()))  # written once, so a row's number stays
    each = found.select("row", F.explode(F.arrays_zip("anchors", "contexts", "at")).alias("x")).select("row", F.col("x.anchors").alias("v"), F.col("x.contexts").alias("c"), F.col("x.at").alias("at"))
    repeated = each.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("n > 1").select("v", (F.col("low") == F.col("high")).alias("closed"))
    repeated = settle(repeated)  # both sides of the join are then shuffled plainly, so a very frequent anchor is split
    marks = each.select("row", "v", "at").join(repeated, "v").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "closed"))).alias("marks"))
    # rows that are equal in doc_id and text have equal marks: one of them will do for all
    marks = settle(marks.join(found.select("row", "id", "sum"), "row").drop("row").dropDuplicates(["id", "sum"]))

    work = settle(docs.join(marks, ["id", "sum"]).select("doc_id", "marks", "text").withColumn("row", F.monotonically_increasing_id()))
    doubtful = settle(in_batches(work, _doubtful(size), "row long, at int, window long"))
    twice = doubtful.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    twice = settle(twice)  # as above: a very frequent window is split
    extra = doubtful.join(twice, "window", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("found"))
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    cut = in_batches(work.join(extra, "row", "left"), _cut(size), columns)
    rest = found.join(marks.select("id", "sum"), ["id", "sum"], "left_anti")
    return cut.unionByName(rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")))
