"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import secrets, toxicity
from weftline.llm.common import settle, unused
from weftline.llm.mixing import mix
from weftline.llm.near_dedup import near_duplicates
from weftline.llm.packing import pack_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train_on(docs, labels))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of row keys, which are written once so that they stay, and the column's name."""
    row = unused(docs.columns, "_row")
    return settle(docs.withColumn(row, F.monotonically_increasing_id())), row


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest doc_id (null last), then the first."""
    rows, row = keyed(docs)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), size=5, similarity=80)
    groups = found.select(F.col("doc_id").alias(row), F.col("component_id").alias("_group")).join(rows.select(row, "doc_id"), row)
    least = groups.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row)))[row].alias(row))
    return rows.join(least.select(row), row, "left_semi").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, and n_chars follows; every document stays."""
    clean = secrets.redact(docs, secrets.train(secrets.labelled_samples(spark)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 3 times.  Of each source's stream only the last can be taken in part."""
    rows, row = keyed(docs)
    taken = mix(rows, cap=3, keep=(row,)).where("taken > 0").select(F.col(row).alias("_key"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    time = unused(docs.columns, "_time")
    found = rows.join(taken, rows[row] == taken._key)
    return found.select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), taken._times)).alias(time)).drop(time)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens."""
    return pack_documents(docs, capacity=1024)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack)]
#: SQL can't express the trained classifier or the tokenizer; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
