"""Series operators over a stream: one stateful operator for each key, with the state that the operators need and no more.

Rows are numbered as they arrive; inside a micro-batch they are ordered by ``order``.  Row-local functions stay Columns
before and after; a NaN leaves as null, as pandas has one mark for both.  A state is a number, the last rows of a delay or a kernel, or the count of rows.  Output is append-only,
and what several micro-batches give is what one batch gives.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from weftline.operators.frame import IDX

#: Before the name of a column that says where another is null.
NULL = "_null_"
Update = Callable[[np.ndarray, Any, "Step"], tuple[np.ndarray, Any]]


@dataclass(frozen=True)
class Step:
    """One operator: its name, the column it reads, the column it makes, and its parameters."""

    op: str
    value: str
    out: str
    rows: int = 0
    rate: float = 0.0
    other: float = 0.0
    start: float = 0.0
    kernel: tuple[float, ...] = field(default=())
    backfill: bool = False


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


def _fold(step: Callable[[float, float, Step], float], first: float) -> Update:
    """A scan row by row: state, input -> state."""

    def update(x: np.ndarray, state: Any, at: Step) -> tuple[np.ndarray, Any]:
        s, out = first if state is None else state, np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            out[i] = s = step(s, v, at)
        return out, s

    return update


def _accumulate(f: np.ufunc, first: float) -> Update:
    def update(x: np.ndarray, state: Any, at: Step) -> tuple[np.ndarray, Any]:
        out = f.accumulate(np.concatenate([[first if state is None else state], _finite(x)]))[1:]
        return out, float(out[-1]) if len(out) else state

    return update


def _earlier(rows: Callable[[Step], int], use: Callable[[np.ndarray, np.ndarray, Step], np.ndarray]) -> Update:
    """An operator of the last ``rows`` rows: the state is those (NaN before the first)."""

    def update(x: np.ndarray, state: Any, at: Step) -> tuple[np.ndarray, Any]:
        n = rows(at)
        joined = np.concatenate([np.full(n, np.nan) if state is None else state, x])
        return use(joined, x, at), joined[len(joined) - n :]

    return update


def _convolved(joined: np.ndarray, x: np.ndarray, at: Step) -> np.ndarray:
    bad = np.isnan(joined)
    out = np.convolve(np.where(bad, 0.0, joined), np.array(at.kernel))[len(at.kernel) - 1 : len(joined)]
    if at.backfill:
        return out
    seen = np.concatenate([[0], np.cumsum(bad)])
    n = len(at.kernel)
    return np.where(seen[n:] - seen[:-n] > 0, np.nan, out)


def _slow(s: float, x: float, _: Step) -> float:
    x = x if np.isfinite(x) else 0.0
    if abs(s) > 1:
        return s - np.sign(s)
    return x if s == 0 or x * s < 0 else s


def _ratio(joined: np.ndarray, x: np.ndarray, _: Step) -> np.ndarray:
    with np.errstate(all="ignore"):
        return x / joined[:-1]


def _filled(x: np.ndarray, state: Any, _: Step) -> tuple[np.ndarray, Any]:
    """Null is the value before; the state is the last value.  (Nulls come as None in an object array.)"""
    out, s = np.empty(len(x)), np.nan if state is None else state
    for i, v in enumerate(x.tolist()):
        out[i] = s = s if v is None else v
    return out, s


OPERATORS: dict[str, Update] = {
    "input": _filled,
    "delay": _earlier(lambda at: at.rows, lambda joined, x, at: joined[: len(x)]),
    "sub_delta": _earlier(lambda at: 1, lambda joined, x, at: x - joined[:-1]),
    "div_delta": _earlier(lambda at: 1, _ratio),
    "conv": _earlier(lambda at: len(at.kernel) - 1, _convolved),
    "cum_sum": _accumulate(np.add, 0.0),
    "cum_prod": _accumulate(np.multiply, 1.0),
    "cum_log_sum_exp": _accumulate(np.logaddexp, 0.0),
    "monotonify": _accumulate(np.maximum, 0.0),
    "cum_sum_clamped": _fold(lambda s, x, at: max(0.0, s + (x if np.isfinite(x) else 0.0)), 0.0),
    "decaying_sum": _fold(lambda s, x, at: s * (1 - at.rate) + (x if np.isfinite(x) else 0.0) * at.rate, 0.0),
    "fwd_fill_zero": _fold(lambda s, x, at: x if np.isfinite(x) and x != 0 else s, 0.0),
    "slow_pass_zero": _fold(_slow, 0.0),
}


def _hold(x: np.ndarray, state: Any, at: Step) -> tuple[np.ndarray, Any]:
    s, out = at.start if state is None else state, np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        out[i] = s = s if np.isfinite(v) and v != 0 else at.other
    return out, s


OPERATORS["scan_if"] = _hold


def stateful(stream: DataFrame, steps: Sequence[Step], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``stream`` with ``idx`` in each key and a column for each step, in which later steps may read earlier ones' columns.

    ``by`` must be real columns; rows of one key are handled by one task at a time, keys in parallel."""
    fields = [*stream.schema.fields, T.StructField(IDX, T.LongType()), *(T.StructField(s.out, T.DoubleType()) for s in steps)]
    names = [f.name for f in fields]

    def update(_key: Any, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        count, held = pickle.loads(state.get[0]) if state.exists else (0, [None] * len(steps))
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        rows[IDX] = np.arange(count, count + len(rows))
        for i, step in enumerate(steps):
            x = rows[step.value].to_numpy(np.float64)
            if step.op == "input":  # pandas has one mark for null and NaN, so the stream says which rows are null
                x = np.where(rows[f"{NULL}{step.value}"].to_numpy(bool), None, x)
            rows[step.out], held[i] = OPERATORS[step.op](x, held[i], step)
        state.update((pickle.dumps((count + len(rows), held)),))
        yield rows[names]

    marks = {f"{NULL}{s.value}": F.col(s.value).isNull() for s in steps if s.op == "input"}
    stream = stream.withColumns(marks) if marks else stream
    return stream.groupBy(*by).applyInPandasWithState(update, T.StructType(fields), "state binary", "append", GroupStateTimeout.NoTimeout)
