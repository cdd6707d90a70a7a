"""Kernels and causal convolution.

y[i] = sum over k < K of kernel[k] * x[i - k], where NaN and rows before the first count as 0.  Without backfill, y is NaN
in the first K - 1 rows and wherever a NaN is among the K rows.  Up to ``DIRECT`` taps it is a sum of lags inside blocks,
generated as code; beyond, each block and the rows before it that its kernel reaches go through one FFT.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.ieee import nan, divide
from weftline.operators.frame import BLK, BLOCK, IDX, each_block, inside, with_halo

#: Taps up to which a convolution is a sum of lags; rows of the largest block; taps of the largest kernel.
DIRECT, LARGEST_BLOCK, MOST_TAPS = 64, 1 << 22, 1 << 24


def kernel_values(frame: DataFrame, kernel: Column, taps: int, by: Sequence[str] = ()) -> np.ndarray:
    """The first ``taps`` values of ``kernel`` over ``frame``; 0 where the frame has no such row.

    The kernel comes to the driver, as every task needs all of it; its size is bounded by ``MOST_TAPS``."""
    if taps > MOST_TAPS:
        raise ValueError(f"a kernel has at most {MOST_TAPS} taps")
    if by:
        raise ValueError("a kernel must be the same for all series")
    rows = frame.where(F.col(IDX) < taps).select(IDX, kernel.cast("double").alias("k")).toPandas()
    values = np.zeros(taps)
    values[rows[IDX].to_numpy()] = rows["k"].to_numpy()
    return values


def index_frame(spark: SparkSession, rows: int) -> DataFrame:
    """A frame with nothing but ``rows`` indices, for series that need no input."""
    return spark.range(rows).select(F.col("id").alias(IDX))


def convolve(df: DataFrame, value: str, kernel: np.ndarray, out: str, backfill: bool = False, by: Sequence[str] = ()) -> DataFrame:
    taps = len(kernel)
    if taps <= 1:
        raise ValueError("a kernel has at least two taps")
    if taps <= DIRECT:
        near = with_halo(df.withColumn("_x", F.nanvl(F.col(value).cast("double"), F.lit(0.0))), by, taps - 1)
        spec = inside(by)
        total = F.lit(0.0)
        for k, weight in enumerate(kernel.tolist()):
            total = total + F.lit(weight) * F.coalesce(F.lag("_x", k).over(spec) if k else F.col("_x"), F.lit(0.0))
        missing = F.sum(F.when(F.isnan(value), 1).otherwise(0)).over(inside(by, -(taps - 1), 0))
        result = total if backfill else F.when((missing > 0) | (F.col(IDX) < taps - 1), nan()).otherwise(total)
        return near.withColumn(out, result).where("_own").drop(BLK, "_own", "_x")
    size = min(max(BLOCK, 1 << (taps - 1).bit_length()), LARGEST_BLOCK)
    near = with_halo(df, by, taps - 1, size)
    spectrum: dict[int, np.ndarray] = {}

    def filtered(c: dict[str, np.ndarray]) -> np.ndarray:
        bad = np.isnan(c[value])
        x = np.where(bad, 0.0, c[value])
        n = 1 << (len(x) + taps - 2).bit_length()
        if n not in spectrum:
            spectrum[n] = np.fft.rfft(kernel, n)
        y = np.fft.irfft(np.fft.rfft(x, n) * spectrum[n], n)[: len(x)]
        if not backfill:
            seen = np.concatenate([[0], np.cumsum(bad)])
            at = np.arange(len(x))
            y[(seen[at + 1] - seen[np.maximum(at + 1 - taps, 0)] > 0) | (c[IDX] < taps - 1)] = np.nan
        return y

    return each_block(near, [*by, BLK], [IDX, value], out, filtered).where("_own").drop(BLK, "_own")


def normalise(df: DataFrame, value: str, out: str, rows: int, zero_outside: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """``value`` divided by the sum of its first ``rows`` values (by 1 if that is NaN); 0 from there on if ``zero_outside``."""
    if rows <= 0:
        raise ValueError("a size must be at least one row")
    total = df.where(F.col(IDX) < rows).groupBy(*by).agg(F.sum(F.col(value).cast("double")).alias("_total"))
    if by:
        df = df.join(total, list(by), "left")
        factor = F.coalesce("_total", F.lit(0.0))
    else:
        found = total.first()
        factor = F.lit(found[0] if found and found[0] is not None else 0.0)
    factor = F.nanvl(divide(F.lit(1.0), factor), F.lit(1.0))
    y = F.col(value).cast("double") * factor
    return df.withColumn(out, F.when(F.col(IDX) < rows, y).otherwise(F.lit(0.0)) if zero_outside else y).drop("_total")


def sequence(scale: float) -> Column:
    return F.col(IDX).cast("double") * F.lit(float(scale))


def gaussian(wavelength: float) -> Column:
    """exp(-(i / wavelength) ** 2)."""
    return F.exp(-(divide(F.col(IDX).cast("double"), F.lit(float(wavelength))) * divide(F.col(IDX).cast("double"), F.lit(float(wavelength)))))


def listed(values: Sequence[float]) -> Column:
    """values[i], and 0 past their end."""
    return F.when(F.col(IDX) < len(values), F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.least(F.col(IDX) + 1, F.lit(len(values))).cast("int"))).otherwise(F.lit(0.0))


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Sum of products, from left to right."""
    if len(a) != len(b):
        raise ValueError("both sides of a dot product must be equally long")
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + x * y
    return total


def drawn(df: DataFrame, points: DataFrame, out: str) -> DataFrame:
    """Linear interpolation at ``idx`` of ``points`` (x, y); NaN before the first and after the last.

    Each point is joined to the next; a segment covers its indices by blocks of 65,536, so the join is an equi-join."""
    nxt = W.partitionBy().orderBy("x")
    segments = points.select("x", "y", F.lead("x").over(nxt).alias("x2"), F.lead("y").over(nxt).alias("y2")).where("x2 is not null")
    segments = segments.withColumn(BLK, F.explode(F.sequence(F.floor(F.col("x") / BLOCK), F.floor(F.col("x2") / BLOCK))))
    joined = df.withColumn(BLK, F.expr(f"{IDX} div {BLOCK}")).alias("d").join(segments.alias("s"), (F.col(f"d.{BLK}") == F.col(f"s.{BLK}")) & (F.col(f"d.{IDX}") >= F.col("s.x")) & (F.col(f"d.{IDX}") <= F.col("s.x2")), "left")
    y = F.col("s.y") + (F.col("s.y2") - F.col("s.y")) * divide(F.col(f"d.{IDX}") - F.col("s.x"), F.col("s.x2") - F.col("s.x"))
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], F.coalesce(y, nan()).alias(out)).dropDuplicates(df.columns)
