"""Helpers that the operators share: scratch tables in the cluster's shared folder and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of characters other than these: space, and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a task handles at a time; a longer document is handled alone.
PIECE_BYTES = 500_000
#: Bytes of an Arrow batch that Spark gives to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20

_own_dir: list[str] = []
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; where that is unset, a local one if the master is local too."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="weftline-"))
    return "file://" + _own_dir[0]


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which ``sweep`` deletes."""
    _written.append(os.path.join(scratch_dir(spark), f"weftline-{uuid.uuid4().hex}"))
    return _written[-1]


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete every scratch table of this process.  Frames that still read them can't be used afterwards."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as make it differ from ``columns`` (upper and lower case are one)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n + 1 offsets; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about ``most`` bytes of text; no row is dropped."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of about ``BATCH_BYTES``: by default a batch is 10,000 rows, however long.

    The limit is a setting of the session, which stays as it is where it is lower already."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    said = (spark.conf.get(name) or "").rstrip("b")
    if not said.isdigit() or int(said) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``: label is the smallest node that can be reached.

    Each round gives every node the smallest label among its neighbours and then the label of that label, so a chain
    of n links takes about log n rounds; every round is a join and a grouping, and is written to the shared folder.
    """
    both = settle(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = settle(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("best"))
        hop = labels.select(F.col("node").alias("best"), F.col("label").alias("far"))
        new = settle(moved.join(hop, "best", "left").select("node", "label", F.least("best", F.coalesce("far", "best")).alias("next")))
        changed = new.where("next <> label").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
