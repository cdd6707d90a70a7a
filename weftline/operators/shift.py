"""Operators that look at earlier rows: forward fill, delay and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.ieee import nan, divide
from weftline.operators.frame import BLK, carried, inside, running, with_halo


def forward_fill(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``out``: the last ``value`` that is not null, up to this row; NaN before the first.  A NaN value is a value."""
    last = lambda c: F.last(c, ignorenulls=True)
    held = carried(df, by, F.max_by(value, F.when(F.col(value).isNotNull(), F.col("idx"))), last)
    here = F.last(value, ignorenulls=True).over(running(by))
    return held.withColumn(out, F.coalesce(here, "_carry", nan())).drop(BLK, "_carry")


def delay(df: DataFrame, value: str, out: str, rows: int, by: Sequence[str] = ()) -> DataFrame:
    """``out``: ``value`` of ``rows`` rows before; NaN in the first ``rows`` rows."""
    if rows <= 0:
        raise ValueError("a delay must be at least one row")
    if rows > 65_536:  # by an equi-join: one row for each row, however far
        source = df.select(*by, (F.col("idx") + rows).alias("idx"), F.col(value).alias(out))
        return df.join(source, [*by, "idx"], "left").withColumn(out, F.coalesce(out, nan()))
    near = with_halo(df, by, rows)
    return near.withColumn(out, F.coalesce(F.lag(value, rows).over(inside(by)), nan())).where("_own").drop(BLK, "_own")


def difference(df: DataFrame, value: str, out: str, by: Sequence[str] = (), ratio: bool = False) -> DataFrame:
    """``out``: ``value`` minus (or divided by) that of the row before; NaN in the first row."""
    near = with_halo(df, by, 1).withColumn("_lag", F.lag(value, 1).over(inside(by)))
    change = divide(F.col(value), F.col("_lag")) if ratio else F.col(value) - F.col("_lag")
    return near.withColumn(out, F.when(F.col("_lag").isNull(), nan()).otherwise(change)).where("_own").drop(BLK, "_own", "_lag")
