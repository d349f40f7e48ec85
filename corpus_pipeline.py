"""From raw documents to token files: each stage reads what its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakelens.llm import chosen_path, decontamination, mixing, quality, token_output
from lakelens.plans.session import checkpoint_root

STAGES = [
    ("quality classifier", quality.stage),
    ("n-gram Jaccard join", chosen_path.stage),
    ("benchmark decontamination", decontamination.stage),
    ("mixing sources to target weights", mixing.stage),
    ("token-ID output", token_output.stage),
]

# The classifier and the tokenizer have no SQL form; tests/llm compares the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
