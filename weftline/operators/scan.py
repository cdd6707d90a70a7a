"""Prefix scans.  Non-finite inputs count as 0, but in ``hold_if``.

Scans with an associative step run as windows inside blocks plus a carry from the table of blocks.  Those without run
block by block in Arrow: ``decaying_sum`` and ``log_sum_exp`` from each block's summary, ``slow_pass_zero`` by rounds, in
which each block starts from the state at which the one before ended, until no state changes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.ieee import finite, finite_or_zero
from weftline.operators.frame import BLK, block, carried, each_block, running, settle


def cumulative_sum(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    x = finite_or_zero(F.col(value))
    return carried(df, by, F.sum(x), F.sum).withColumn(out, F.coalesce("_carry", F.lit(0.0)) + F.sum(x).over(running(by))).drop(BLK, "_carry")


def cumulative_product(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """A non-finite input makes this and every later row 0."""
    x = finite_or_zero(F.col(value))
    return carried(df, by, F.product(x), F.product).withColumn(out, F.coalesce("_carry", F.lit(1.0)) * F.product(x).over(running(by))).drop(BLK, "_carry")


def running_maximum(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """The largest value so far, at least 0."""
    x = finite_or_zero(F.col(value))
    return carried(df, by, F.max(x), F.max).withColumn(out, F.greatest(F.lit(0.0), F.coalesce("_carry", F.lit(0.0)), F.max(x).over(running(by)))).drop(BLK, "_carry")


def clamped_sum(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """A sum that never goes below 0: the cumulative sum less its running minimum, where that is negative."""
    summed = settle(cumulative_sum(df, value, "_sum", by))
    least = carried(summed, by, F.min("_sum"), F.min)
    low = F.least(F.lit(0.0), F.coalesce("_carry", F.lit(0.0)), F.min("_sum").over(running(by)))
    return least.withColumn(out, F.col("_sum") - low).drop(BLK, "_carry", "_sum")


def _last_of(df: DataFrame, kept: Column, out: str, by: Sequence[str], start: Column) -> DataFrame:
    held = carried(df.withColumn("_kept", kept), by, F.max_by("_kept", F.when(F.col("_kept").isNotNull(), F.col("idx"))), lambda c: F.last(c, ignorenulls=True))
    return held.withColumn(out, F.coalesce(F.last("_kept", ignorenulls=True).over(running(by)), "_carry", start)).drop(BLK, "_carry", "_kept")


def fill_zeros(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """The last value that is not 0 (and finite); 0 before the first."""
    x = finite_or_zero(F.col(value))
    return _last_of(df, F.when(x != 0, x), out, by, F.lit(0.0))


def hold_if(df: DataFrame, condition: str, other: Column, start: float, out: str, by: Sequence[str] = ()) -> DataFrame:
    """The value of the row before where ``condition`` is finite and not 0, else ``other``; ``start`` before the first row."""
    holds = (F.col(condition) != 0) & finite(F.col(condition))
    return _last_of(df, F.when(~holds, other), out, by, F.lit(float(start)))


def _chain(blocks: DataFrame, by: Sequence[str], step) -> DataFrame:
    """``blocks`` (by, _blk, and a block's summary) with ``_carry``: the state before it.  One row for each 65,536 rows."""
    keys = list(by) or ["_one"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(BLK)
        states, state = [], step(None, None)
        for row in rows.itertuples(index=False):
            states.append(state)
            state = step(state, row)
        return rows.assign(_carry=np.array(states, float))[[*by, BLK, "_carry"]]

    schema = T.StructType([*(blocks.schema[k] for k in by), T.StructField(BLK, T.LongType()), T.StructField("_carry", T.DoubleType())])
    return blocks.withColumn("_one", F.lit(0)).groupBy(*keys).applyInPandas(run, schema)


def decaying_sum(df: DataFrame, value: str, rate: Column, out: str, by: Sequence[str] = ()) -> DataFrame:
    """s * (1 - rate) + value * rate.  A block is an affine map of the state before it, so blocks run in parallel."""
    df = settle(df.withColumns({BLK: block(), "_x": finite_or_zero(F.col(value)), "_r": finite_or_zero(rate)}))
    keys = [*by, BLK]

    def local(x: np.ndarray, r: np.ndarray, state: float) -> np.ndarray:
        result = np.empty(len(x))
        for i, (keep, add) in enumerate(zip((1 - r).tolist(), (x * r).tolist(), strict=True)):
            state = state * keep + add
            result[i] = state
        return result

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        x, r = rows["_x"].to_numpy(), rows["_r"].to_numpy()
        return rows[keys].iloc[:1].assign(scale=float(np.prod(1 - r)), shift=float(local(x, r, 0.0)[-1]))

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("scale", T.DoubleType()), T.StructField("shift", T.DoubleType())])
    blocks = df.select(*keys, "idx", "_x", "_r").groupBy(*keys).applyInPandas(summary, schema)
    carries = _chain(blocks, by, lambda s, row: 0.0 if row is None else s * row.scale + row.shift)
    done = each_block(df.join(carries, keys), keys, ["_x", "_r", "_carry"], out, lambda c: local(c["_x"], c["_r"], float(c["_carry"][0])))
    return done.drop(BLK, "_x", "_r", "_carry")


def log_sum_exp(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """log(1 + sum of exp of the values so far), without overflow."""
    df = settle(df.withColumns({BLK: block(), "_x": finite_or_zero(F.col(value))}))
    keys = [*by, BLK]
    top = df.groupBy(*keys).agg(F.max("_x").alias("_top"))
    blocks = df.join(top, keys).groupBy(*keys).agg((F.first("_top") + F.ln(F.sum(F.exp(F.col("_x") - F.col("_top"))))).alias("log"))
    carries = _chain(blocks, by, lambda s, row: 0.0 if row is None else float(np.logaddexp(s, row.log)))
    done = each_block(df.join(carries, keys), keys, ["_x", "_carry"], out, lambda c: np.logaddexp.accumulate(np.concatenate([c["_carry"][:1], c["_x"]]))[1:])
    return done.drop(BLK, "_x", "_carry")


def slow_pass_zero(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """A state that moves towards 0 by 1 a row, and within 1 of it takes a value of the other sign (at 0 any value)."""
    df = settle(df.withColumns({BLK: block(), "_x": finite_or_zero(F.col(value))}))
    keys = [*by, BLK]

    def local(xs: list[float], s: float) -> list[float]:
        result = []
        for x in xs:
            if s < 0:
                s = s + 1 if s < -1 else x if x > 0 else s
            elif s > 0:
                s = s - 1 if s > 1 else x if x < 0 else s
            else:
                s = x
            result.append(s)
        return result

    def end(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        return rows[keys].iloc[:1].assign(_carry=float(local(rows["_x"].tolist(), float(rows["_carry"].iloc[0]))[-1]))

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("_carry", T.DoubleType())])
    starts = df.select(*keys).distinct().withColumn("_carry", F.lit(0.0))
    while True:
        starts = settle(starts)
        ends = df.select(*keys, "idx", "_x").join(starts, keys).groupBy(*keys).applyInPandas(end, schema)
        after = ends.select(*by, (F.col(BLK) + 1).alias(BLK), F.col("_carry").alias("_next"))
        new = settle(starts.join(after, keys, "left").select(*keys, "_carry", F.coalesce("_next", F.lit(0.0)).alias("_next")))
        changed = new.where("_carry <> _next").limit(1).count()
        starts = new.select(*keys, F.col("_next").alias("_carry"))
        if not changed:
            break
    done = each_block(df.join(starts, keys), keys, ["_x", "_carry"], out, lambda c: np.array(local(c["_x"].tolist(), float(c["_carry"][0]))))
    return done.drop(BLK, "_x", "_carry")


