"""Records as JSON lines.

An object is a row, even an empty one.  A line that is not JSON, or not an object, is dropped and is no row.  A number is a
value, a JSON null is NaN, and a key that is missing or has another kind of value is null: the value before it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.ieee import nan
from weftline.operators.frame import IDX, indexed


def value_of(record: Column, key: str) -> Column:
    """The value of ``key`` in a record (variant): a double, NaN for a JSON null, null if it is missing or no number."""
    path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
    found = F.try_variant_get(record, path, "variant")
    kind = F.schema_of_variant(found)
    number = F.try_variant_get(record, path, "double")
    return F.when(F.is_variant_null(found), nan()).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), number)


def records(lines: DataFrame, keys: Sequence[str], line: str = "value") -> DataFrame:
    """``lines`` with a column for each key; lines that are no JSON object are left out.  Works on streams too."""
    parsed = lines.withColumn("_record", F.try_parse_json(line)).where(F.schema_of_variant("_record").startswith("OBJECT"))
    return parsed.withColumns({k: value_of(F.col("_record"), k) for k in keys}).drop("_record", line)


def read(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """A frame of the files at ``path``: ``idx`` in the order of file names and lines, and the keys' columns.

    A key that no record has raises, as no row of it could ever be made."""
    lines = spark.read.text(path).withColumns({"_file": F.input_file_name(), "_line": F.monotonically_increasing_id()})
    frame = indexed(records(lines, keys), ["_file", "_line"]).drop("_file", "_line")
    seen = frame.agg(*[F.count(F.col(f"`{k}`")).alias(k) for k in keys]).first()
    missing = [k for k in keys if not seen[k]]
    if missing and frame.limit(1).count():
        raise ValueError(f"no record has {', '.join(missing)}")
    return frame


def keys_of(spark: SparkSession, path: str) -> list[str]:
    """The keys that the records at ``path`` have."""
    found = spark.read.text(path).select(F.explode(F.expr("json_object_keys(value)")).alias("k")).distinct().collect()
    return sorted(r.k for r in found)


def from_table(df: DataFrame, order: Sequence[str], inputs: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """A frame from any DataFrame (Parquet, a table): rows by ``order``, inputs as named."""
    picked = df.select(*by, *[c for c in order if c not in by], *[c.cast("double").alias(f"_in_{k}") for k, c in inputs.items()])
    frame = indexed(picked, order, by)
    return frame.select(*by, IDX, *[F.col(f"_in_{k}").alias(k) for k in inputs])
