"""Row index, blocks of rows, and carries between blocks.

A frame's order is its ``idx``.  No operator sorts a whole series in one task: rows are cut into blocks of ``BLOCK``
consecutive indices, windows run inside blocks, and what a block needs from the blocks before it comes from a table with
one row for each block, or from rows that are copied into the next block.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 65_536
IDX, BLK = "idx", "_blk"

_own: list[str] = []


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Where that is unset, a local folder serves a local master; a cluster's executors wouldn't share one, so it is an error."""
    spark: SparkSession = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="weftline-frame-"))
        base = f"file://{_own[0]}"
    path = os.path.join(base, f"frame-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def indexed(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``idx``: the place of each row by ``order``, from 0.

    Rows are range-partitioned and sorted, numbered inside their partition, and offset by the rows of the partitions before:
    no task sees more than its part.  With ``by``, the place of a key's first row is taken off.
    """
    order = [*by, *order]
    placed = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_m", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy().orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    low = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    found = placed.withColumn("_part", part).join(offsets, "_part").withColumn(IDX, (F.col("_before") + low).cast("long")).drop("_part", "_m", "_before")
    if not by:
        return found
    firsts = found.groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(by)]).agg(F.min(IDX).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(by)])
    return found.join(firsts, same).withColumn(IDX, F.col(IDX) - F.col("_first")).drop("_first", *[f"_key_{i}" for i in range(len(by))])


def block(size: int = BLOCK) -> Column:
    return F.expr(f"{IDX} div {size}")


def inside(by: Sequence[str], start: int | None = None, end: int | None = None) -> WindowSpec:
    """The window over a block's rows by index; with ``start`` and ``end`` a frame of rows."""
    spec = W.partitionBy(*by, BLK).orderBy(IDX)
    return spec if start is None else spec.rowsBetween(start, end)


def running(by: Sequence[str]) -> WindowSpec:
    return inside(by, W.unboundedPreceding, W.currentRow)


def carried(df: DataFrame, by: Sequence[str], summary: Column, carry, name: str = "_carry") -> DataFrame:
    """``df`` with its block ``_blk`` and ``name``: ``carry`` of the ``summary`` of all blocks before (null if none).

    ``carry`` is a function of a Column, such as ``F.sum``.  The table of blocks has a row for each 65,536 rows of ``df``.
    """
    df = df.withColumn(BLK, block())
    blocks = df.groupBy(*by, BLK).agg(summary.alias("_s"))
    before = W.partitionBy(*by).orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*by, BLK, carry(F.col("_s")).over(before).alias(name))
    return df.join(blocks, [*by, BLK])


def with_halo(df: DataFrame, by: Sequence[str], rows: int, size: int = BLOCK) -> DataFrame:
    """``df`` in blocks, in which each block also has the ``rows`` rows before it (``_own`` is false for those)."""
    reach = -(-rows // size)
    targets = F.sequence(block(size), F.expr(f"({IDX} + {rows}) div {size}")) if reach else F.array(block(size))
    return df.withColumn(BLK, F.explode(targets)).withColumn("_own", F.col(BLK) == block(size))


def each_block(df: DataFrame, keys: Sequence[str], needs: Sequence[str], out: str, f: Callable[[dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    """``df`` with ``out``: f of the columns ``needs`` of each group of ``keys``, in order of idx.

    Arrow tables, not pandas: pandas has one mark for null and NaN, so other columns would lose their NaN."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(IDX).to_numpy(), kind="stable")
        result = np.empty(table.num_rows)
        result[order] = f({c: table.column(c).to_numpy()[order] for c in needs})
        return table.append_column(out, pa.array(result))

    return df.groupBy(*keys).applyInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
