"""From raw documents to a mix for training: five stages, each written and read again as Parquet.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import stages
from tickloom.session import shared_dir

STAGES = [
    ("quality rules", stages.quality_rules),
    ("near duplicates", stages.near_duplicates),
    ("benchmark decontamination", stages.decontamination),
    ("secret scans", stages.secret_scans),
    ("mixing to target weights", stages.mixing),
]

#: Tokenisers and drawn blocks are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is a table in the shared folder before the next one reads it."""
    folder = stages.fresh_folder(shared_dir(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
