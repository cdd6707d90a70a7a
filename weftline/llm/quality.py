"""Quality rules by repetition coverage: the characters inside duplicated word n-grams of several lengths and inside
duplicated lines, from rolling hashes over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import in_batches, pieces, text_buffer
from weftline.llm.words import U, Words, is_space, mixed, spans, windows

#: n-gram length: the largest share of a text's word characters that duplicated n-grams of it may cover.
COVERAGE = {5: 0.3, 8: 0.25, 13: 0.2}
#: The largest share of word characters in lines that repeat an earlier line.
LINE_COVERAGE = 0.3
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _by_row(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values[cuts[i]:cuts[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more; whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def _covered(words: Words, hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words are inside an n-gram that its text has twice or more."""
    at = words.alone(n)
    twice, _ = _repeated(windows(hashes, at, n) + mixed(words.doc[at].astype(U)))
    step = np.zeros(len(words) + 1, np.int32)
    step[at[twice]] += 1
    step[at[twice] + n] -= 1
    return np.cumsum(step)[:-1] > 0


def measures(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of a batch."""
    words = Words(raw, off)
    hashes = words.hashes()
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = points[words.end] - points[words.start]
    n_words, word_chars = np.diff(words.first), _by_row(chars, words.first)
    # lines: from one newline or text start to the next
    new = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([off[:-1], new + 1]))
    begin = begin[begin < len(raw)]
    stop = np.append(begin[1:], len(raw))
    stop = stop - (raw[stop - 1] == 10)  # a line ends before its newline
    of = np.searchsorted(off, begin, "right") - 1
    dark = np.concatenate([[0], np.cumsum(~is_space(raw))])
    with_word = dark[stop] > dark[begin]
    begin, stop, of = begin[with_word], stop[with_word], of[with_word]
    _, later = _repeated(spans(raw, begin, stop) + mixed(of.astype(U)))
    line_of_word = np.searchsorted(begin, words.start, "right") - 1
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": _by_row(_SYMBOLS[raw], off), "n_dup_lines": np.bincount(of[later], minlength=len(off) - 1)}
    share = lambda x: _by_row(np.where(x, chars, 0), words.first) / np.maximum(word_chars, 1)
    out["dup_line_chars"] = share(later[line_of_word] if len(words) else np.zeros(0, bool))
    for n in COVERAGE:
        inside = _covered(words, hashes, n)
        if n == 5:
            out["n_repeat_words"] = _by_row(inside, words.first)
        out[f"dup_{n}_chars"] = share(inside)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = measures(*text_buffer(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.float64() if k[:4] == "dup_" else pa.int64()) for k, x in found.items())], ["doc_id", *found])


def quality(docs: DataFrame) -> DataFrame:
    """The measures and the verdict for each row of ``docs`` (doc_id long, text string; other columns are ignored).

    n_words, word_chars (code points in words), n_symbols (``#*$%&|<>``), n_dup_lines (lines with a word that are equal
    to an earlier line of the text), n_repeat_words (words in 5-word windows that the text has twice or more);
    dup_line_chars and dup_5_chars, dup_8_chars, dup_13_chars: shares of the word characters inside repeated lines and
    n-grams.  base_failed: fewer than 10 words, or more than a fifth of them in n_repeat_words.  kept: not base_failed, and
    no share over its limit.  A null or empty text has no words and fails.  Rows are judged one by one, so repeated rows
    have equal results; an empty table gives an empty result.  Nothing is shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shares = ["dup_line_chars", *(f"dup_{n}_chars" for n in COVERAGE)]
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    schema = ", ".join(["doc_id long", *(f"{x} long" for x in longs), "dup_line_chars double", "n_repeat_words long", *(f"{x} double" for x in shares[1:])])
    found = in_batches(docs, _measure, schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = F.col("dup_line_chars") <= LINE_COVERAGE
    for n, most in COVERAGE.items():
        within &= F.col(f"dup_{n}_chars") <= most
    return found.select("doc_id", *longs, "n_repeat_words", failed.alias("base_failed"), (~failed & within).alias("kept"), *shares)
