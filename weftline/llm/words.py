"""Words and word windows of many texts at once, with numpy over the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Powers that a worker keeps; those for a longer text are made again.
KEPT_POWERS = 1 << 21
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, or those of its inverse."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, 1 << 16), U(step))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= KEPT_POWERS:
            _powers[base, inverse] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def lowered(raw: np.ndarray) -> np.ndarray:
    """A to Z as a to z; other bytes as they are."""
    return _LOWER[raw]


def is_space(raw: np.ndarray) -> np.ndarray:
    return _SPACE[raw]


class Words:
    """Words of a batch of texts: ``start`` and ``end`` (bytes), ``doc`` (row), ``first`` (n + 1 word offsets by row)."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        inside = ~_SPACE[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = off[(off > 0) & (off < len(raw))]
        before[edges] = False
        after[edges - 1] = False
        self.raw, self.off = raw, off
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return spans(self.raw, self.start, self.end)

    def alone(self, k: int) -> np.ndarray:
        """Word positions at which a window of k words of one text starts."""
        n = len(self) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * powers(_BYTE_BASE, len(raw)), out=sums[1:])
    return mixed((sums[end] - sums[start]) * powers(_BYTE_BASE, len(raw) + 1, True)[start] + (end - start).astype(U))


def windows(words: np.ndarray, start: np.ndarray, end: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of the word hashes ``words[start:end]``, for each window; ``end`` may be a length."""
    end = start + end if isinstance(end, int) else end
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(_WORD_BASE, len(words)), out=sums[1:])
    return mixed((sums[end] - sums[start]) * powers(_WORD_BASE, len(words) + 1, True)[start] + (end - start).astype(U))


def signed(x: np.ndarray) -> np.ndarray:
    """As non-negative Spark longs, in the same order."""
    return (x >> U(1)).view(np.int64)


def running(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each w neighbours of x; len(x) - w + 1 values."""
    out, have = x, 1
    while have * 2 <= w:
        out, have = f(out[:-have], out[have:]), have * 2
    return f(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
