"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import licenses, oracles, secrets, toxicity
from weftline.llm.fingerprints import fingerprints
from weftline.llm.mixing import mix
from weftline.llm.near_dedup import near_duplicates
from weftline.llm.packing import pack_documents
from weftline.llm.quality import quality
from weftline.llm.repeats import remove_repeats
from weftline.llm.token_files import token_digest


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir), secrets.train(secrets.labelled_samples(spark)))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir)
    return toxicity.score(docs, toxicity.train_on(docs, _table(spark, sf_dir, "labels")), threshold=0.7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": lambda spark, d: mix(_table(spark, d), cap=3),
        "op2_near_dedup": lambda spark, d: near_duplicates(_table(spark, d), size=4, similarity=80),
        "op3_quality": lambda spark, d: quality(_table(spark, d)),
        "op4_secrets": _secrets,
        "op5_toxicity": _toxicity,
        "op6_packing": lambda spark, d: pack_documents(_table(spark, d), capacity=1024),
        "op7_token_files": lambda spark, d: token_digest(_table(spark, d)),
        "op8_fingerprints": lambda spark, d: fingerprints(_table(spark, d)),
        "op9_repeats": lambda spark, d: remove_repeats(_table(spark, d), size=35),
        "op10_licenses": lambda spark, d: licenses.scan(_table(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": oracles.near_dedup(4, 80), "op3_quality": oracles.quality(), "op9_repeats": oracles.repeats(35)}
