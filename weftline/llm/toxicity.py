"""Toxicity by compression distance: two zstandard dictionaries are trained, one on ordinary and one on toxic text.  Each window
of words is compressed with the ordinary one alone and with both, one behind the other; what the toxic one saves, against
thresholds calibrated on folds, scores a document.

1. The ordinary dictionary is trained on windows of ordinary texts; it is large, so that it holds most of the language.
2. The first toxic dictionary is trained on all windows of toxic texts.  Most of what these say is ordinary, so it is trained
   again, on the words to which what it saves is due: those without which a window saves that much less.  Savings are
   measured on folds that the dictionaries have not seen, so that what a text repeats of itself doesn't count.
3. Lengths are compared under zstandard's optimal parser; its greedy parsers give lengths too uneven to tell a word by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import in_batches, pieces, text_buffer
from weftline.llm.words import Words, lowered, spans

#: Words of a window.
WINDOW = 8
#: Training takes at most this many labelled texts of each class, by a hash of doc_id, of at most this many bytes each.
MOST_TEXTS, MOST_BYTES = 1_500, 60_000
#: A dictionary is trained on at most this many bytes of windows.
SAMPLE_BYTES = 6_000_000
#: Bytes of the ordinary dictionary, and of the toxic one by round of training; characters of a segment and of what it must share.
ORDINARY, TOXIC = 131_072, (16_384, 4_096, 4_096)
SEGMENT, SHARED = 12, 6
#: Texts of which training makes windows at a time.
TOGETHER = 50
#: Folds by which the score is calibrated.
FOLDS = 3
#: Bytes saved from which a window of toxic text, and a word in it, is what the toxic dictionary is trained on again.
TELLING = 3
#: Bytes saved from which a window counts as toxic, from weakly to strongly.
SAVED = (1, 2, 3, 4, 6)
#: Columns of a document's features.
FEATURES = 2 * len(SAVED) + 3


@dataclass
class Model:
    """The trained dictionaries and the weights of the calibrated score."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]
    centre: list[float]
    scale: list[float]


def held_out(doc_id: Column) -> Column:
    """Whether a row must not be learnt from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _windows(raw: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct windows of a batch, in lower case and between spaces; the window and the text of each occurrence."""
    raw = lowered(raw)
    words = Words(raw, off)
    place = np.arange(len(words)) - words.first[words.doc]
    first = np.flatnonzero(place % WINDOW == 0)
    last = np.append(first[1:], len(words)) - 1
    start, end = words.start[first], words.end[last]
    code, distinct = pd.factorize(spans(raw, start, end))
    seen = np.zeros(len(distinct), np.int64)
    seen[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    data = raw.tobytes()
    return [b" %b " % data[a:b] for a, b in zip(start[seen].tolist(), end[seen].tolist(), strict=True)], code, words.doc[first]


def _length(dictionary: bytes) -> Callable[[bytes], int]:
    """The compressed length of a window with a trained dictionary; further ones may be behind the first."""
    how = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, strategy=zstandard.STRATEGY_BTULTRA, window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=3, target_length=24, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
    known.precompute_compress(compression_params=how)
    compress = zstandard.ZstdCompressor(compression_params=how, dict_data=known).compress
    return lambda window: len(compress(window))


class Scorer:
    """Features and scores of batches of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.constant = not model.ordinary
        if not self.constant:
            self.ordinary, self.both = _length(model.ordinary), _length(model.ordinary + model.toxic)

    def features(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        found, code, of = _windows(raw, off)
        saved = np.array([self.ordinary(w) - self.both(w) for w in found], np.int64)[code]
        return summed(saved, of, len(off) - 1)

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(off) - 1, 1 / (1 + math.exp(-self.model.weights[0])))
        x = (self.features(raw, off) - np.array(self.model.centre)) / np.array(self.model.scale)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.model.weights[1:]) + self.model.weights[0], -30, 30)))


def summed(saved: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The features of n documents from the bytes saved on each window and its document."""
    count = np.bincount(of, minlength=n)
    columns = []
    for least in SAVED:
        hits = np.bincount(of[saved >= least], minlength=n)
        columns += [np.log1p(hits), np.log((hits + 0.25) / (count + 8.0))]
    most = np.zeros(n)
    np.maximum.at(most, of, saved)
    return np.column_stack([*columns, np.minimum(most, 12), np.log1p(count), np.bincount(of, saved, minlength=n) / np.maximum(count, 1)])


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains on ``samples``, of at most ``size`` bytes and a fourth of theirs."""
    order, taken, total = np.random.default_rng(0).permutation(len(samples)).tolist(), [], 0
    for i in order:
        total += len(samples[i])
        if total > SAMPLE_BYTES:
            break
        taken.append(samples[i])
    return zstandard.train_dictionary(max(512, min(size, sum(map(len, taken)) // 4)), taken, k=SEGMENT, d=SHARED).as_bytes()


def _refined(samples: list[bytes], windows: list[bytes], size: int) -> bytes:
    """A dictionary of ``samples``, or of ``windows`` where those are too few to train on."""
    try:
        return _trained(samples or windows, size)
    except zstandard.ZstdError:
        return _trained(windows, size)


def _due(windows: list[bytes], ordinary: Callable[[bytes], int], both: Callable[[bytes], int]) -> list[bytes]:
    """The words without which a window saves less by ``TELLING`` bytes."""
    out = []
    for window in windows:
        words = window.split()
        saved = ordinary(window) - both(window)
        for i, word in enumerate(words):
            rest = b" %b " % b" ".join(words[:i] + words[i + 1 :])
            if saved - (ordinary(rest) - both(rest)) >= TELLING:
                out.append(word)
    return out


def _weights(features: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, centre and scale of a logistic regression in which both classes weigh the same, by Newton's method."""
    each = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    centre, scale = features.mean(0), features.std(0) + 1e-6
    x = np.column_stack([np.ones(len(y)), (features - centre) / scale])
    weights, penalty = np.zeros(x.shape[1]), np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        weights -= np.linalg.solve((x.T * (each * p * (1 - p))) @ x + penalty, x.T @ (each * (p - y)) + penalty @ weights)
    return weights, centre, scale


def _constant(share: float) -> Model:
    return Model(b"", b"", [math.log(share / (1 - share)), *[0.0] * FEATURES], [0.0] * FEATURES, [1.0] * FEATURES)


def train(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled texts.  With fewer than five of a class, or too little text to train a dictionary on, every
    text is scored by the share of toxic ones."""
    y = np.array(toxic, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if min(y.sum(), len(y) - y.sum()) < 5:
        return _constant(share)
    every: list[bytes] = []
    each = []
    for low in range(0, len(texts), TOGETHER):  # the arrays of many texts at once would be many times their size
        found, code, within = _windows(*text_buffer(pa.array(texts[low : low + TOGETHER], pa.string())))
        every += [found[i] for i in code.tolist()]
        each.append(within + low)
    of = np.concatenate(each)
    fold, label = of % FOLDS, y[of] == 1

    def windows(of_class: bool, in_fold: np.ndarray | bool = True) -> list[bytes]:
        return [every[i] for i in np.flatnonzero((label == of_class) & in_fold).tolist()]

    try:
        bases = [_trained(windows(False, fold != k), ORDINARY) for k in range(FOLDS)]
        plain = [_length(b) for b in bases]
        length = np.zeros(len(every), np.int64)
        for k in range(FOLDS):
            at = np.flatnonzero(fold == k)
            length[at] = [plain[k](every[i]) for i in at.tolist()]
        words: list[list[bytes]] = []  # by fold: those to which savings are due
        for size in TOXIC:
            saved = np.zeros(len(every), np.int64)
            previous, words = words, []
            for k in range(FOLDS):
                both = _length(bases[k] + _refined(_samples(previous, k), windows(True, fold != k), size))
                at = np.flatnonzero(fold == k)
                saved[at] = length[at] - np.array([both(every[i]) for i in at.tolist()], np.int64)
                words.append(_due([every[i] for i in at[label[at] & (saved[at] >= TELLING)].tolist()], plain[k], both))
        weights, centre, scale = _weights(summed(saved, of, len(y)), y)
        return Model(_trained(windows(False), ORDINARY), _refined(_samples(previous), windows(True), TOXIC[-1]), weights.tolist(), centre.tolist(), scale.tolist())
    except zstandard.ZstdError:  # too few samples to train on
        return _constant(share)


def _samples(words: list[list[bytes]], without: int = -1) -> list[bytes]:
    """The words of all folds but one, eight to a sample."""
    flat = [w for k, some in enumerate(words) if k != without for w in some]
    return [b" %b " % b" ".join(flat[i : i + 8]) for i in range(0, len(flat), 8)]


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) whose rows are not held out.

    At most ``MOST_TEXTS`` texts of each class, those of the smallest hash of doc_id, of at most ``MOST_BYTES`` bytes,
    come to the driver.  Null labels, ids and texts teach nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.where(F.octet_length("text").between(1, MOST_BYTES)).select("doc_id").distinct(), "doc_id")
    chosen = [known.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_TEXTS) for k in (0, 1)]
    rows = chosen[0].union(chosen[1])
    # a doc_id may be repeated any number of times: one text of each is taken before anything comes to the driver
    texts = docs.where(F.octet_length("text").between(1, MOST_BYTES)).join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    found = texts.toPandas().sort_values("doc_id")
    return train(found.text.tolist(), found.toxic.astype(int).tolist())


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``) for each row of ``docs`` (doc_id, text).

    The score is from the text alone.  A null or empty text has no window and gets the score of that.  Rows are scored one
    by one over all their windows; repeated rows have equal scores; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.scores(*text_buffer(batch.column("text"))), pa.float64())], ["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = in_batches(docs, run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns.  Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in pieces(batches):
            yield batch.filter(pa.array(scorer.scores(*text_buffer(batch.column("text"))) < threshold))

    return in_batches(docs, run, docs.schema)
