"""Sinks: JSON lines, binary rows, and samples for plots."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.ieee import finite
from weftline.operators.frame import IDX


def json_lines(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """idx and ``value``: a JSON object of ``names`` for each row; numbers that are not finite are null."""
    fields = F.struct(*[F.when(finite(F.col(n)), F.col(n)).alias(n) for n in names])
    return df.select(IDX, F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, names: Sequence[str], path: str) -> None:
    """JSON lines in row order, in as many files as Spark has partitions; their names follow the order."""
    json_lines(df, names).repartitionByRange(IDX).sortWithinPartitions(IDX).select("value").write.text(path)


def binary_rows(df: DataFrame, names: Sequence[str], kind: str = "doubles") -> DataFrame:
    """idx (first of the batch) and ``data``: rows of native floats or doubles one after another; NaN stays."""
    dtype = {"floats": np.float32, "doubles": np.float64}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(dtype) for n in names])
                yield pa.RecordBatch.from_arrays([batch.column(IDX).slice(0, 1), pa.array([np.ascontiguousarray(rows).tobytes()], pa.binary())], [IDX, "data"])

    ordered = df.select(IDX, *[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))).alias(n) for n in names]).repartitionByRange(IDX).sortWithinPartitions(IDX)
    return ordered.mapInArrow(run, f"{IDX} long, data binary")


def sample(df: DataFrame, low: int, high: int, points: int = 4096) -> DataFrame:
    """Rows low, low + stride, ... below ``high``, about ``points`` of them: what a line plot of that range shows."""
    stride = max(1, (high - low) // points)
    return df.where((F.col(IDX) >= low) & (F.col(IDX) < high) & ((F.col(IDX) - low) % stride == 0))


def fitted_range(df: DataFrame, name: str) -> tuple[float, float]:
    """The least and largest value with a margin of a tenth of half the span, which is at least 1e-9."""
    low, high = df.where(~F.isnan(name)).agg(F.min(name), F.max(name)).first()
    if low is None:
        return math.nan, math.nan
    centre, half = (low + high) / 2, max((high - low) / 2, 1e-9) * 1.1
    return centre - half, centre + half


def value_at(df: DataFrame, name: str, x: float) -> float:
    """The value at a place between two rows, linearly interpolated; NaN outside."""
    at = int(x // 1)
    rows = df.where(F.col(IDX).isin([at, at + 1])).select(IDX, name).toPandas().set_index(IDX)[name]
    if at not in rows.index or (x > at and at + 1 not in rows.index):
        return math.nan
    return float(rows[at] if x == at else rows[at] + (x - at) * (rows[at + 1] - rows[at]))

