"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilcell.llm import stages
from veilcell.workspace import Workspace

STAGES = [
    ("language_id", stages.language),
    ("exact_dedup", stages.exact_duplicates),
    ("ngram_join", stages.near_duplicates),
    ("decontamination", stages.decontaminate),
    ("mixing", stages.mix),
]

# Near duplicates, fitted language models and budget fitting have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.cut(stage(spark, docs, sf_dir), name)
    return docs
